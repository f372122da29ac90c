"""Both ways of finding repeated passages against brute force over all windows, and edge cases."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkfeat.llm import substring_dedup as sub
from sparkfeat.llm import suffix_dedup as suf
from sparkfeat.llm.anchors import LENGTH


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 130, 260)]
    docs = []
    for k in range(40):
        w = [word() for _ in range(r.choice([0, 5, 60, 200]))]
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        docs.append((k, " ".join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in w)))
    docs.append((99, docs[5][1]))
    return docs


def covered_by_brute(docs):
    seen = defaultdict(list)
    for i, t in docs:
        w = t.lower().split()
        for k in range(len(w) - LENGTH + 1):
            seen[tuple(w[k : k + LENGTH])].append((i, k))
    out = set()
    for places in seen.values():
        if len(places) > 1:
            out |= {(i, k + j) for i, k in places for j in range(LENGTH)}
    return out


@pytest.mark.parametrize("find", [sub.repeated_spans, suf.repeated_passages])
def test_against_brute_force(spark, find):
    docs = corpus(4)
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, part string")
    rows = find(df).collect()
    got = {(r.doc_id, k) for r in rows for k in range(r.start_word, r.end_word)}
    assert got == covered_by_brute(docs)
    spans = sorted((r.doc_id, r.start_word, r.end_word) for r in rows)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert any(r.first for r in rows) and not all(r.first for r in rows)


def test_levels_double(spark):
    r = random.Random(0)
    text = " ".join(str(r.random())[2:] for _ in range(450))
    rows = sub.repeated_spans(spark.createDataFrame([(1, "a b " + text), (2, text + " c")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start_word, x.end_word, x.longest, x.first) for x in rows) == [(1, 2, 452, 400, True), (2, 0, 450, 400, False)]


@pytest.mark.parametrize("find", [sub.repeated_spans, suf.repeated_passages])
def test_odd_rows(spark, find):
    r = random.Random(1)
    p = " ".join(f"v{r.randrange(10**6)}" for _ in range(60))
    same = "tick " * 3000
    rows = [(1, None), (2, ""), (None, p), (3, p), (3, p), (4, "few words"), (5, same)]
    got = {(x.doc_id, x.start_word, x.end_word) for x in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 0, 60), (5, 0, 3000)}
    assert find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def variants(seed):
    """Texts that share different stretches around the same words: edits of one text, moved parts, repeats within a text."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(r.choice([3, 30, 300])))
    base = [[word() for _ in range(r.choice([50, 60, 70, 140]))] for _ in range(2)]
    docs = []
    for k in range(r.choice([3, 8, 25])):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            at = r.randrange(len(w))
            kind = r.randrange(4)
            if kind == 0:
                w[at] = word()
            elif kind == 1:
                w[at:at] = [word() for _ in range(r.randrange(1, 20))]
            elif kind == 2:
                del w[at : at + r.randrange(1, 15)]
            else:
                w = w[at:] + w[:at]
        w = [word() for _ in range(r.randrange(0, 60))] + w + [word() for _ in range(r.randrange(0, 60))]
        docs.append((k, " ".join(w)))
    docs.append((100, " ".join(["tick"] * r.choice([49, 50, 51, 120]))))
    return docs


def firsts(docs):
    """(doc_id, word): whether it is the first occurrence, for each start of a run of LENGTH words that repeats."""
    seen = defaultdict(list)
    for i, t in docs:
        w = t.lower().split()
        for k in range(len(w) - LENGTH + 1):
            seen[tuple(w[k : k + LENGTH])].append((i, k))
    return {x: x == min(v) for v in seen.values() if len(v) > 1 for x in v}


class Sent:
    def __init__(self, *value):
        self.value = value


def locally(docs, n_tasks, hot=False):
    """The suffix sort's functions, one after another, with filters that let everything pass."""
    every = np.full(1 << 13, 255, np.uint8)
    sent = Sent(every, every if hot else None, every if hot else None)
    made = []
    for k in range(n_tasks):
        mine = docs[k::n_tasks]
        made += suf._segments(sent)(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in mine], pa.int64()), pa.array([t for _, t in mine])], names=["doc_id", "text"])]))
    if not made:
        return []
    by_key = pa.Table.from_batches(made).sort_by("key")
    found = list(suf._matches(iter(by_key.to_batches(max_chunksize=7))))
    return [r for b in suf._union(iter(pa.Table.from_batches(found).sort_by("doc_id").to_batches(max_chunksize=5))) for r in b.to_pylist()] if found else []


@pytest.mark.parametrize("seed", range(60))
def test_suffix_sort_loses_nothing(seed, monkeypatch):
    docs = variants(seed)
    want, first = covered_by_brute(docs), firsts(docs)
    for n_tasks, lot, hot in ((1, 2_000_000, False), (3, 500, False), (2, 500, True)):
        monkeypatch.setattr(suf, "LOT", lot)
        rows = locally(docs, n_tasks, hot)
        assert {(r["doc_id"], k) for r in rows for k in range(r["start_word"], r["end_word"])} == want
        for r in rows:
            assert r["first"] == all(first.get((r["doc_id"], k), True) for k in range(r["start_word"], r["end_word"] - LENGTH + 1))


def test_suffix_sort_splits_hot_anchors(spark):
    docs = variants(11) + [(200 + k, f"x{k} " + " ".join(f"line{j}" for j in range(45)) + f" y{k} z{k} " + " ".join(f"u{k}v{j}" for j in range(30))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (3, 20, 10_000):
        rows = suf.repeated_passages(df, hot=hot).collect()
        assert {(r.doc_id, k) for r in rows for k in range(r.start_word, r.end_word)} == covered_by_brute(docs)


def test_mergesort_is_lexicographic():
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(300)]
    bucket = np.sort(np.array([r.randrange(9) for _ in texts]))
    n = np.array([len(t) for t in texts])
    x = suf.Extensions(np.frombuffer(b"".join(texts), np.uint8))
    order = suf.sort_suffixes((x, np.cumsum(n) - n, n), bucket)
    assert order.tolist() == sorted(range(300), key=lambda k: (bucket[k], texts[k], k))
