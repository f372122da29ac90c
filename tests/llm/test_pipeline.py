"""The pipeline on a small corpus whose outcome is known, stage by stage and as a whole."""

import random

import plain
import pytest

import corpus_pipeline as cp
from sparkfeat.llm import bpe, toxicity
from sparkfeat.llm.ngram_join import N, THRESHOLD

INSULTS = ["grulk", "snarfid", "blorgh"]


def corpus():
    r = random.Random(7)
    vocab = ["".join(r.choice(["th", "er", "on", "an", "re", "ing", "ea", "st"]) for _ in range(r.randint(2, 4))) for _ in range(3000)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    docs, labels, gone = [], [], set()
    bench = [text(30) for _ in range(5)]
    for k in range(150):
        w = text(60)
        toxic = k % 5 == 0
        if toxic:
            w[30] = INSULTS[k % 3]
        if k % 5 == 1 and k < 40:
            w[10:10] = bench[k % 5]
            gone.add(k)
        if k % 5 == 2 and k < 40:
            w[20] = f"ann{k}@mail.example.com"
        if toxic:
            gone.add(k)
        labels.append((k, 1, int(toxic)))
        docs.append((k, " ".join(w), "en", "s", 0))
    for k in (3, 8):  # near copies of clean documents
        w = docs[k][1].split()
        w[5] = "changed"
        docs.append((200 + k, " ".join(w), "en", "s", 0))
        docs.append((300 + k, docs[k][1], "en", "s", 0))
        gone |= {200 + k, 300 + k}
    docs += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, "no name here at all", "en", "s", 19)]
    return docs, labels, [(i, " ".join(b)) for i, b in enumerate(bench)], gone


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels, bench, _ = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_whole_pipeline(spark, folder):
    docs, _, _, gone = corpus()
    got = {r.doc_id: r for r in cp.run(spark, folder).collect()}
    assert set(got) == {d[0] for d in docs} - gone
    codec = bpe.Codec.load(bpe.TOKENIZER)
    for i, text, *_ in docs:
        if i not in got:
            continue
        if text and "@" in text:
            assert "@" not in got[i].text and "[EMAIL]" in got[i].text
        else:
            assert got[i].text == text
        assert got[i].token_ids == codec.tok.encode(text and got[i].text or "", add_special_tokens=False).ids and got[i].round_trip


def test_every_stage_against_brute_force(spark, folder):
    docs, labels, bench, _ = corpus()
    rows = [(d[0], d[1]) for d in docs]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [x for x in rows if plain.toxic_score(x[1], model) <= model.cut]
    first = plain.classes(rows, THRESHOLD, N)
    rows = [x for x in rows if x[0] is None or first[x[0]][0] == x[0]]
    bad = {r for r, _ in plain.contaminated(rows, bench)}
    rows = [x for r, x in enumerate(rows) if r not in bad]
    rows = [(i, t) for (i, _), t in zip(rows, plain.sanitised(rows))]
    tok = bpe.Codec.load(bpe.TOKENIZER).tok
    want = sorted(((i, t, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text, list(r.token_ids)) for r in cp.run(spark, folder).collect()), key=str) == want and len(want) < len(docs)


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii_sanitisation", "bpe_encoding"]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
