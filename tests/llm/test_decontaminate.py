"""Latent retrieval against brute-force containment, the subspace against an exact SVD, edge cases."""

import random
import time

import numpy as np
import plain

from sparkfeat.llm import decontaminate as dc


def corpus(seed=3, n=120, items=12):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6))) for _ in range(1500)]
    common = vocab[:30]
    text = lambda k: [r.choice(common) if r.random() < 0.4 else r.choice(vocab) for _ in range(k)]
    bench = [text(r.randint(15, 50)) for _ in range(items)]
    docs, truth = [], set()
    for k in range(n):
        w = text(r.choice([20, 100, 400]))
        if k % 4 == 0:
            i = r.randrange(items)
            leak = list(bench[i])
            if k % 8 == 0:  # a paraphrase: some words replaced, some put in
                for _ in range(len(leak) // 8):
                    leak[r.randrange(len(leak) * 3 // 4)] = r.choice(vocab)
                leak.insert(5, r.choice(vocab))
            at = r.randrange(len(w))
            w[at:at] = leak
            truth.add((k, i))
        docs.append((k, " ".join(w)))
    return docs, [(i, " ".join(b)) for i, b in enumerate(bench)], truth


def test_finds_leaks_and_paraphrases_only(spark):
    docs, bench, truth = corpus()
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    assert got <= truth and len(got) >= 0.95 * len(truth)
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in got}


def test_whole_query_against_brute_force(spark):
    docs, bench, _ = corpus(5, 60, 8)
    docs += [(900, docs[0][1]), (0, docs[0][1]), (901, ""), (902, None), (None, bench[2][1])]
    bench += [(2, "another text of the same item and a few more words to it"), (3, None), (None, "no name")]
    want = plain.contaminated(docs, bench)
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    name = lambda rows: sorted((-1 if d is None else d, i, round(x, 9), round(a, 9)) for d, i, x, a in rows)
    assert name((r.doc_id, r.item_id, r.lcs, r.answer) for r in got) == name((docs[r][0], i, x, a) for (r, i), (x, a) in want.items())
    assert len(got) > 12


def test_basis_spans_the_leading_singular_vectors():
    rng = np.random.default_rng(0)
    u, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    c = (u * (2.0 ** -np.arange(60))) @ u.T
    omega = rng.standard_normal((60, 20))
    v = dc.nystrom_basis(c @ omega, omega, 8)
    assert np.linalg.norm(v.T @ u[:, :4], ord=-2) > 0.999


def test_lcs():
    r = random.Random(0)
    for _ in range(50):
        a, b = [r.randrange(5) for _ in range(12)], [r.randrange(5) for _ in range(15)]
        m = [[0] * 16 for _ in range(13)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        assert dc.lcs(a, b) == m[12][15]


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "zeta eta theta iota kappa lambda mu nu"), (1, "zeta eta theta iota kappa lambda mu nu"), (2, None), (None, "x y"), (3, ""), (4, " !? ")], "item_id long, text string")
    long = "pad " * 30000 + "zeta eta theta iota kappa lambda mu nu " + "pad " * 30000
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "zeta eta theta iota kappa lambda mu nu"), (3, long), (4, "zeta mu"), (5, "zeta eta theta iota kappa lambda mu nu"), (5, "zeta eta theta iota kappa lambda mu nu")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.lcs) for r in dc.contaminated(docs, bench).collect())
    assert got == [(-1, 1, 1.0), (3, 1, 1.0), (5, 1, 1.0), (5, 1, 1.0)]
    none = bench.limit(0)
    assert dc.contaminated(docs, none).count() == 0 and dc.drop_contaminated(docs, none).count() == 7
    assert dc.contaminated(docs.limit(0), bench).count() == 0


def test_long_items_and_paraphrases_without_their_rare_words(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    common = [f"c{k}" for k in range(40)]
    pad = lambda k: [r.choice(common) for _ in range(k)]
    items = [[word() for _ in range(m)] for m in (150, 400, 1200)]
    items.append([word() if k in (0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 38, 39) else common[k] for k in range(40)])
    docs, want = [], set()
    for i, ws in enumerate(items):
        leaks = [ws, [word() if k % 4 == 1 else w for k, w in enumerate(ws)]] if i < 3 else [ws, [word() if w not in common and k < 38 else w for k, w in enumerate(ws)]]
        for leak in leaks:
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(pad(45) + leak + pad(77))))
    docs += [(k, " ".join(pad(200))) for k in range(len(docs), 400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in dc.contaminated(d, b).collect()} == want


def entries(rng, sizes, terms):
    p = np.repeat(np.arange(len(sizes)) * 2, sizes)
    return p, rng.integers(0, terms, len(p)), rng.random(len(p)) * (rng.random(len(p)) < 0.9)


def test_sparse_products_are_exact_and_cost_little_more_than_their_entries():
    rng = np.random.default_rng(4)
    for sizes in ([], [0, 0], [1], [3, 0, 700, 1, 2], [5] * 40, rng.integers(0, 30, 300), [2000, *[1] * 9, 900]):
        p, t, w = entries(rng, sizes, 50)
        dense = rng.standard_normal((50, 16)).astype(np.float32)
        rows, got = dc.times(p, t, w, dense)
        assert rows.tolist() == np.unique(p[w > 0]).tolist() and got.dtype == np.float32
        want = np.zeros((2 * len(sizes) + 1, 16))
        np.add.at(want, p, w[:, None] * dense[t])
        assert np.allclose(got, want[rows], atol=1e-3, rtol=1e-4)
    p, t, w = entries(rng, rng.integers(0, 12, 8000), 3000)
    dense = rng.standard_normal((3000, 128)).astype(np.float32)
    w = w.astype(np.float32)

    def cost(f):
        took = []
        for _ in range(7):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert cost(lambda: dc.times(p, t, w, dense)) < 2.5 * cost(lambda: dense[t] * w[:, None])


def test_words_are_found_whatever_leading_bits_they_share():
    rng = np.random.default_rng(5)
    some = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1)
    near = np.uint64(77 << 56) + np.arange(40, dtype=np.uint64)
    for words in (some, near, np.concatenate([some, near, near >> np.uint64(40), ~near]), near[:1], np.array([0], np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        words = np.unique(words)
        h = rng.permutation(np.concatenate([words, words + np.uint64(1), words - np.uint64(1), some, np.array([0, 2**64 - 1], np.uint64)]))
        at, word = dc.find(h, dc.lexicon(words))
        assert at.tolist() == np.flatnonzero(np.isin(h, words)).tolist() and (words[word] == h[at]).all()
        assert not len(dc.find(h[:0], dc.lexicon(words))[0])


def test_bits_are_counted_the_same_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    full = rng.random((9, 37)) < 0.4
    i, col = rng.integers(0, 9, 200), rng.integers(0, 37, 500)
    lo, size = rng.integers(0, 400, 200), rng.integers(0, 100, 200)
    want = [int(full[r, col[a : a + n]].sum()) for r, a, n in zip(i, lo, size)]
    for block in (1, 64, 1000, dc.BLOCK):
        monkeypatch.setattr(dc, "BLOCK", block)
        assert dc.count_bits(np.packbits(full, axis=1), i, col, lo, size).tolist() == want
