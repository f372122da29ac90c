"""The folded table against the plain kernel sum, held-out accuracy, and edge cases."""

import random

import numpy as np
import plain
import pyarrow as pa

from sparkfeat.llm import textscan as ts
from sparkfeat.llm import toxicity as tx


def plain_kernel(s, t):
    """The normalised gap-weighted kernel straight from its definition."""

    def phi(w):
        out = {}
        code = [int(tx.CODE[b]) for b in w]
        for i in range(len(code)):
            for j in range(i + 1, len(code)):
                for k in range(j + 1, min(len(code), i + tx.SPAN)):
                    u = (code[i], code[j], code[k])
                    if 31 not in u and 0 not in u:
                        out[u] = out.get(u, 0) + tx.DECAY ** (k - i + 1)
        return out

    a, b = phi(s), phi(t)
    norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(u, 0) for u, v in a.items()) / norm if norm else 0.0


def sentences(n, seed):
    r = random.Random(seed)
    syl = ["th", "er", "on", "an", "re", "ing", "ea", "st", "nd", "ti"]
    bad = ["grulk", "snarfid", "blorgh"]
    texts, y = [], []
    for k in range(n):
        w = ["".join(r.choice(syl) for _ in range(r.randint(1, 4))) for _ in range(40)]
        toxic = k % 3 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(bad) + r.choice(["", "s", "!"])
        texts.append(" ".join(w) + ".")
        y.append(int(toxic))
    return texts, y


def test_kernel_and_folding():
    words = [b"idiot", b"id-iot", b"stupid", b"thering", "über".encode(), b"ab"]
    k = tx.kernel(words, words)
    assert np.allclose(k, [[plain_kernel(a, b) for b in words] for a in words], atol=1e-5)
    texts, y = sentences(300, 1)
    m = tx.train(texts, y)
    assert m.landmarks
    for w in words[:5]:
        got = m.score(*ts.text_buffer(pa.array([w.decode()])))[0][0]
        assert abs(max(m.value(w), m.bias) - got) < 1e-4


def test_held_out_accuracy_and_gaps():
    m = tx.train(*sentences(600, 1))
    texts, y = sentences(300, 2)
    got = m.score(*ts.text_buffer(pa.array(texts)))[0] > m.cut
    assert (got == np.array(y, dtype=bool)).mean() > 0.98
    bent = ["so s n a r f i d they", "a snar-fid is", "the snarxfid on", "GRULK it"]
    assert (m.score(*ts.text_buffer(pa.array(bent)))[0] > m.cut).all()


def test_queries_on_odd_rows(spark):
    texts, y = sentences(300, 1)
    rows = [(k, t, "old") for k, t in enumerate(texts)] + [(None, "snarfid here", "x"), (900, None, "x"), (901, "", "x"), (902, "the " * 60000 + "grulk", "x"), (903, "the snarfid on", "x"), (903, "the snarfid on", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, v, None) for k, v in enumerate(y)] + [(None, 1, 1), (5, None, 1), (3, 0, 1)], "doc_id long, toxic int, quality int")
    m = tx.fit(docs, labels)
    got = [(r.doc_id, r.toxic, r.sentence) for r in tx.score(docs, m).collect()]
    assert len(got) == len(rows)
    odd = sorted((i is None, i or 0, t) for i, t, _ in got if i is None or i >= 900)
    assert odd == [(False, 900, 0), (False, 901, 0), (False, 902, 1), (False, 903, 1), (False, 903, 1), (True, 0, 1)]
    assert all(bool(s) == bool(t) for _, t, s in got)
    kept = tx.drop_toxic(docs, m)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for _, t, _ in got if not t)


def test_scores_match_brute_force(spark):
    texts, y = sentences(300, 1)
    m = tx.train(texts, y)
    more, _ = sentences(60, 3)
    rows = [*enumerate(more), (100, "so s n a r f i d they a.b c! d"), (101, "GRU-LK it"), (102, None), (103, ""), (104, "über grülk blo\x00rgh 7 8 9"), (105, "a b c"), (106, more[0]), (None, more[1])]
    got = {(r.doc_id, round(r.score, 3), r.toxic) for r in tx.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    want = {(i, round(plain.toxic_score(t, m), 3), int(plain.toxic_score(t, m) > m.cut)) for i, t in rows}
    assert {(i, t) for i, _, t in got} == {(i, t) for i, _, t in want}
    key = lambda x: (x[0] is None, x[0] or 0)
    assert all(abs(a[1] - b[1]) < 2e-3 for a, b in zip(sorted(got, key=key), sorted(want, key=key)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    m = tx.fit(docs, labels)
    assert tx.score(docs, m).count() == 0
    some = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [r.toxic for r in tx.score(some, m).collect()] == [0]


def test_rare_insults_are_learnt_from_all_labels(spark):
    r = random.Random(5)
    texts, y = sentences(6000, 4)
    clean = [t for t, bad in zip(texts, y) if not bad]
    rare = [t.replace(" ", " vuxquop ", 1) for t in clean[:20]]
    rows = [*zip(texts, y), *((t, 1) for t in rare)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, bad) for k, (_, bad) in enumerate(rows)], "doc_id long, toxic int")
    m = tx.fit(docs, labels)
    got = m.score(*ts.text_buffer(pa.array(["the vuxquop on", "there vuxquop"])))[0]
    assert (got > m.cut).all()
