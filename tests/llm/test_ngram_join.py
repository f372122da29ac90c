"""The join against brute force over Python sets, and its edge cases."""

import random

import numpy as np
import plain
from pyspark.sql import functions as F

from sparkfeat.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, sig string, jaccard double"


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([1, 2, 5, 40, 80]))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(r.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(r.choice([0, 1, 3, 8])):
                v[r.randrange(len(v))] = r.choice(vocab)
            rows.append((len(rows), ", ".join(v)))
    return rows


def joined(spark, rows, **how):
    df = spark.createDataFrame([(a, b, "x", 0.5) for a, b in rows], SCHEMA)
    got = nj.ngram_join(df, **how).collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: (r.class_id, r.links) for r in got}


def test_against_brute_force(spark):
    rows = corpus()
    for t, n, block, orders in ((0.6, 3, 4096, 3), (0.4, 2, 3, 4), (0.5, 1, 2, 2), (1.0, 3, 4096, 3)):
        assert joined(spark, rows, threshold=t, n=n, block=block, orders=orders) == plain.classes(rows, t, n), (t, n, block)


def test_a_large_group_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(130):
        w = list(base)
        for _ in range(r.choice([0, 2, 4, 7, 12])):
            w[r.randrange(60)] = f"x{r.randrange(400)}"
        rows.append((k, " ".join(w)))
    want = plain.classes(rows, 0.5, 3)
    assert max(links for _, links in want.values()) > 60 and len({c for c, _ in want.values()}) > 1
    for block in (4096, 20):
        assert joined(spark, rows, block=block) == want
    monkeypatch.setattr(nj, "CELLS", 500)
    monkeypatch.setattr(nj, "WORK", 50)
    gram = [sorted({hash(x) & (2**64 - 1) for x in plain.grams(t, 3)}) for _, t in rows]
    flat = np.array([x for g in gram for x in g], np.uint64)
    at = np.repeat(np.arange(len(rows)), [len(g) for g in gram])
    size = np.array([len(g) for g in gram])
    links, root = nj.linked(at, flat, size, np.ones(len(rows)), None, 0.5, 3)
    assert links.astype(int).tolist() == [want[k][1] for k in range(len(rows))] and root.tolist() == [want[k][0] for k in range(len(rows))]
    whole, _ = nj.linked(at, flat, size, np.ones(len(rows)), None, 0.5, 3)
    cross, _ = nj.linked(at, flat, size, np.ones(len(rows)), 50, 0.5, 3)
    for lo, hi in ((0, 50), (50, 130)):
        own, _ = nj.linked(at[(at >= lo) & (at < hi)] - lo, flat[(at >= lo) & (at < hi)], size[lo:hi], np.ones(hi - lo), None, 0.5, 3)
        assert (own + cross[lo:hi] == whole[lo:hi]).all()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " ,. "), (4, "a b c d"), (4, "a b c d"), (5, "A, b c d"), (None, "a b c d"), (6, "a"), (7, "a!"), (8, "long " * 50000)]
    assert joined(spark, rows) == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1), 8: (8, 0)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = nj.keep_one(df.withColumn("root", F.lit(1)))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 6), (False, 8), (True, 0)]
    assert kept.columns == ["doc_id", "text", "root"]


def test_several_texts_of_one_doc_id(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "p q r s t"), (2, "p q r s t"), (3, "u v w x y"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.links) for r in nj.ngram_join(df).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 3, 0), (3, 3, 0)]
    assert sorted((r.doc_id, r.text or "") for r in nj.keep_one(df).collect()) == [(1, "a b c d e"), (1, "p q r s t"), (3, ""), (3, "u v w x y")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.ngram_join(df).count() == 0
    assert nj.keep_one(df).count() == 0


def test_one_repeated_doc_many_ids(spark):
    rows = [(k, "the same few words again and again") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.class_id, r.links) for r in nj.ngram_join(df).collect()} == {(0, 199)}
    assert [r.doc_id for r in nj.keep_one(df).collect()] == [0]


def test_default_threshold_joins_edited_copies(spark):
    w = [f"w{k}" for k in range(60)]
    edited = [f"new{k}" if k % 12 == 6 else x for k, x in enumerate(w)]
    assert joined(spark, [(1, " ".join(w)), (2, " ".join(edited))]) == {1: (1, 1), 2: (1, 1)}
