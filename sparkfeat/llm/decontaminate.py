"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of ``PASSAGE`` words that overlap by half.  Passages and benchmark
items are TF-IDF vectors over the terms of the benchmark (other terms have no weight in any
cosine with an item), without those that most passages share.  A randomised SVD finds the
passages' leading right singular vectors: every task adds its part of Y = A'(A Omega) for a random
Omega, the parts are summed in a shuffle, and the Nystroem form Y (Omega' Y)^-1 Y' of A'A gives
them (Halko et al., 2011; Tropp et al., 2017).  A passage is a candidate for an item if their cosine
in that latent space is high enough.  An item longer than a passage is sought by its stretches, cut
evenly, each a vector of its own.  Candidates are verified on the words: the longest common
subsequence of item and passage must cover the item, and that of its answer, the last quarter
of its words, the answer.  So reordered neighbours, inserted and replaced words are still found, as far as they lie
within twice the item's number of words, around the stretch that holds most of its words: what is spread further is no copy.

Three scans of the text; what is broadcast grows with the benchmark (a bit for each item and term) and never with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import ceil_tol, table, tidy

PASSAGE, RANK, MAX_DF, COSINE, LCS, ANSWER = 64, 112, 0.01, 0.2, 0.7, 0.5
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double"
#: Bits that are looked up at once.
BLOCK = 1 << 20


class Lexicon(NamedTuple):
    """Sorted word hashes, and where among them those with the same leading bits are."""

    words: np.ndarray
    at: np.ndarray  # by leading bits: the number of the one word that has them, 0 if there is none, -1 if there are more


class Plan(NamedTuple):
    """What a scan needs: the benchmark's words and terms, their weights, the latent basis and the items."""

    lexicon: Lexicon  # of all items' words
    term: np.ndarray  # each word's term, -1 for those that too many passages hold
    idf: np.ndarray
    basis: np.ndarray  # terms x rank
    latent: np.ndarray  # stretches x rank, unit rows
    items: list[tuple[int, list[int]]]  # item_id and word hashes
    of: np.ndarray  # each stretch's item
    holds: np.ndarray  # stretches x terms, packed bits
    total: list[int]  # each item's number of distinct terms, summed over its stretches
    has: np.ndarray  # items x words, packed bits
    known: np.ndarray  # each item's number of distinct words


def bit(packed: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """The bits at columns j of rows i."""
    return (packed[i, j >> 3] >> (7 - (j & 7)).astype(np.uint8) & 1).astype(bool)


def count_bits(packed: np.ndarray, i: np.ndarray, col: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the bits at columns col[lo[k]] .. col[lo[k]+size[k]-1] of row i[k] are set, for all k."""
    out = np.zeros(len(i), np.int64)
    stop = np.cumsum(size)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(stop, stop[a] - size[a] + BLOCK, side="right")))
        n = size[a:b]
        end = np.cumsum(n)
        got = np.concatenate([[0], np.cumsum(bit(packed, np.repeat(i[a:b], n), col[ts.ranges(lo[a:b], n)]))])
        out[a:b] = got[end] - got[end - n]
        a = b
    return out


def lexicon(words: np.ndarray) -> Lexicon:
    bits = min(20, max(8, (16 * len(words)).bit_length()))
    slot = (words >> ts.U64(64 - bits)).astype(np.int64)
    at = np.zeros(1 << bits, np.int32)
    at[slot] = np.arange(len(words))
    at[slot[1:][slot[1:] == slot[:-1]]] = -1
    return Lexicon(words, at)


def find(h: np.ndarray, known: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``h`` of the words of the lexicon, their numbers); a binary search only where leading bits are shared."""
    k = known.at[(h >> ts.U64(65 - len(known.at).bit_length())).view(np.int64)]
    open_ = np.flatnonzero(k < 0)
    k[open_] = np.minimum(np.searchsorted(known.words, h[open_]), len(known.words) - 1)
    hit = np.flatnonzero(known.words[k] == h)
    return hit, k[hit].astype(np.int64)


def rows_of(c: pa.RecordBatch, known: Lexicon, term_of: np.ndarray, passage: int):
    """(passage number, term number, count) of a chunk, passage rows, passage starts, its words, and which of them the lexicon has."""
    h, _, _, rows, _ = ts.words(c)
    half = passage // 2
    n = np.bincount(rows, minlength=c.num_rows)
    first = np.cumsum(n) - n
    blocks = -(-n // half)
    many = np.maximum(blocks - 1, (n > 0).astype(np.int64))
    base = np.cumsum(many) - many
    inside, word = find(h, known)
    term = term_of[word]
    hit, term = inside[term >= 0], term[term >= 0]
    r = rows[hit]
    block = (hit - first[r]) // half
    own, before = block < many[r], block > 0
    p = np.concatenate([(base[r] + block)[own], (base[r] + block - 1)[before]])
    t = np.concatenate([term[own], term[before]])
    code, count = np.unique(p * len(term_of) + t, return_counts=True)
    row_of = np.repeat(np.arange(c.num_rows), many)
    start = first[row_of] + (np.arange(len(row_of)) - base[row_of]) * half
    return code // len(term_of), code % len(term_of), count, row_of, start, h, first, n, inside, word


def weights(p: np.ndarray, t: np.ndarray, count: np.ndarray, idf: np.ndarray, m: int) -> np.ndarray:
    w = (1 + np.log(count)) * idf[t]
    norm = np.sqrt(np.bincount(p, weights=w * w, minlength=m))
    return w / np.maximum(norm[p], 1e-12)


def times(p: np.ndarray, t: np.ndarray, w: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, sparse rows times a dense matrix), rows ascending.

    The k-th entries of all rows that have so many are added at once, longest rows first; when few rows are left, each by itself.
    """
    keep = w > 0
    p, t, w = p[keep], t[keep], w[keep].astype(np.float32)
    if not len(p):
        return p, np.zeros((0, dense.shape[1]), np.float32)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    sizes = np.diff(np.append(first, len(p)))
    out = np.empty((len(first), dense.shape[1]), np.float32)
    step = 4096
    for row in range(0, len(first), step):
        by = row + np.argsort(-sizes[row : row + step], kind="stable")
        at, size = first[by], sizes[by]
        total = dense[t[at]] * w[at, None]
        k, m = 1, int((size > 1).sum())
        while m >= 8:
            total[:m] += dense[t[at[:m] + k]] * w[at[:m] + k, None]
            k += 1
            m = int(np.searchsorted(-size, -k))
        for r, (lo, hi) in enumerate(zip((at[:m] + k).tolist(), (at[:m] + size[:m]).tolist())):
            total[r] += w[lo:hi] @ dense[t[lo:hi]]
        out[by] = total
    return p[first], out


def _counts(words: np.ndarray, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, every = lexicon(words), np.arange(len(words))
        df, total = np.zeros(len(words), np.int64), 0
        for b in batches:
            for c in ts.chunks(b):
                _, t, _, row_of, *_ = rows_of(c, known, every, passage)
                df += np.bincount(t, minlength=len(words))
                total += len(row_of)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], total))], names=["term", "n"])

    return run


def _range(sent, passage: int):
    """This task's part of A'(A Omega), a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, term, idf, omega = sent.value
        y = np.zeros(omega.shape, np.float64)
        for b in batches:
            for c in ts.chunks(b):
                p, t, count, row_of, *_ = rows_of(c, known, term, passage)
                w = weights(p, t, count, idf, len(row_of))
                rows, ao = times(p, t, w, omega)
                keep = w > 0
                p, t, w = p[keep], t[keep], w[keep]
                by = np.argsort(t, kind="stable")
                some, part = times(t[by], np.searchsorted(rows, p[by]), w[by], ao)
                y[some] += part
        live = np.flatnonzero(np.abs(y).max(axis=1) > 0)
        for lo in range(0, len(live), 500):
            k = live[lo : lo + 500]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([y[i].tobytes() for i in k], pa.binary())], names=["term", "v"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.float64) for x in t.column("v")], axis=0)
    return pa.table({"term": t.column("term")[:1], "v": pa.array([total.tobytes()], pa.binary())})


def nystrom_basis(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of the positive semi-definite matrix sketched as y = C omega."""
    shift = 1e-6 * max(1e-12, np.linalg.norm(y))
    y = y + shift * omega
    m = omega.T @ y
    val, vec = np.linalg.eigh((m + m.T) / 2)
    half = y @ (vec / np.sqrt(np.maximum(val, shift * 1e-3)))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, : min(rank, int((s > s.max(initial=0) * 1e-7).sum()))]


def words_of_items(benchmark: DataFrame) -> list[tuple[int, list[int]]]:
    """The benchmark's items, which the driver and every task hold; repeated items count once."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().collect()
    rows.sort()
    out = []
    if rows:
        c = pa.RecordBatch.from_arrays([pa.array([r["item_id"] for r in rows]), pa.array([r["text"] for r in rows])], names=["item_id", "text"])
        h, _, _, at, _ = ts.words(c)
        cut = np.searchsorted(at, np.arange(len(rows) + 1))
        out = [(r["item_id"], h[cut[k] : cut[k + 1]].tolist()) for k, r in enumerate(rows) if cut[k + 1] > cut[k]]
    return out


def plan(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, rank: int = RANK, max_df: float = MAX_DF, seed: int = 7) -> Plan | None:
    """The latent space of the documents' passages; None if there is no benchmark item."""
    spark = docs.sparkSession
    items = words_of_items(benchmark)
    if not items:
        return None
    words = np.unique(np.array([w for _, ws in items for w in ws], dtype=ts.U64))
    text = docs.select(F.lit(0).alias("k"), F.col("text").cast("string").alias("text"))
    counted = {r["term"]: r["n"] for r in text.mapInArrow(tidy(_counts(words, passage)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counted.pop(-1, 0) or 0
    df = np.zeros(len(words))
    df[list(counted)] = list(counted.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    live = df <= max_df * total
    of = [np.unique(np.searchsorted(words, np.array(ws, dtype=ts.U64))) for _, ws in items]
    for own in of:  # every item keeps its rarest terms
        live[own[np.argsort(df[own], kind="stable")[:5]]] = True
    known, term = lexicon(words), np.where(live, np.cumsum(live) - 1, -1)
    terms, idf = words[live], idf[live]
    omega = np.random.default_rng(seed).standard_normal((len(terms), min(rank + 16, len(terms)))).astype(np.float32)
    sent = spark.sparkContext.broadcast((known, term, idf, omega))
    parts = text.mapInArrow(tidy(_range(sent, passage)), "term long, v binary").groupBy("term").applyInArrow(_add, "term long, v binary").collect()
    y = np.zeros(omega.shape)
    for r in parts:
        y[r["term"]] = np.frombuffer(r["v"], np.float64)
    sent.unpersist()
    basis = nystrom_basis(y, omega.astype(np.float64), rank).astype(np.float32)
    cut = [(k, part) for k, (_, ws) in enumerate(items) for part in stretches(ws, passage)]
    latent = np.zeros((len(cut), basis.shape[1]), np.float32)
    holds = np.zeros((len(cut), -(-len(terms) // 8)), dtype=np.uint8)
    many = np.zeros(len(cut))
    for j, (_, part) in enumerate(cut):
        mine = np.array(part, dtype=ts.U64)
        t, n = np.unique(np.searchsorted(terms, mine[np.isin(mine, terms)]), return_counts=True)
        v = ((1 + np.log(n)) * idf[t]).astype(np.float32) @ basis[t]
        holds[j] = packed(t, len(terms))
        many[j] = len(t)
        latent[j] = v / max(float(np.linalg.norm(v)), 1e-12)
    item = np.array([k for k, _ in cut])
    has = np.stack([packed(own, len(words)) for own in of])
    distinct = np.array([len(own) for own in of])
    return Plan(known, term, idf, basis, latent, items, item, holds, np.bincount(item, weights=many).astype(int).tolist(), has, distinct)


def packed(at: np.ndarray, n: int) -> np.ndarray:
    row = np.zeros(n, dtype=bool)
    row[at] = True
    return np.packbits(row)


def stretches(ws: list[int], passage: int) -> list[list[int]]:
    """An item's words in as few even stretches of at most a passage as they take."""
    c = -(-len(ws) // passage)
    return [ws[k * len(ws) // c : (k + 1) * len(ws) // c] for k in range(c)]


def window(n: int) -> int:
    """Words of the region in which an item of ``n`` words is verified."""
    return -(-3 * n // 2) + 2 * (n // 4)


def least_held(n: int, total: int, passage: int, least: float) -> int:
    """Distinct terms that some stretch of a verified item has in some passage, at the least.

    At most ``lost`` of the item's ``n`` words have no match, and the region of the others is
    covered by so many pairs of a stretch and a passage that follow each other.
    """
    lost = n - ceil_tol(least * n)
    pairs = (window(n) + -(-n // passage) * (passage // 2 - 1 + passage - 1)) // passage
    return max(1, -(-(total - lost) // pairs))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a`` (Hyyro, 2004)."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def matches(c: pa.RecordBatch, plan: Plan, passage: int, cosine: float, least: float, answer: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item_id, cosine, lcs, answer) of the pairs of a chunk that are verified, best passage each."""
    p, t, count, row_of, start, h, first, n, inside, word = rows_of(c, plan.lexicon, plan.term, passage)
    w = weights(p, t, count, plan.idf, len(row_of))
    rows, v = times(p, t, w, plan.basis)
    if not len(rows):
        return []
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    long = np.array([len(ws) for _, ws in plan.items])
    need = np.array([least_held(m, total, passage, least) for m, total in zip(long.tolist(), plan.total)])
    lost = long - np.array([ceil_tol(least * m) for m in long.tolist()])
    known = plan.known
    begin, end = np.searchsorted(p, rows), np.searchsorted(p, rows, side="right")
    for lo in range(0, len(rows), 4096):
        cos = v[lo : lo + 4096] @ plan.latent.T
        i_all, j_all = np.nonzero(cos >= cosine)
        # what the longest common subsequence implies: of the stretch's distinct terms in the passage,
        size = end[lo + i_all] - begin[lo + i_all]
        enough = count_bits(plan.holds, j_all, t, begin[lo + i_all], size) >= need[plan.of[j_all]]
        i_all, j_all = i_all[enough], j_all[enough]
        # and of the item's words in the region around it
        k_all = plan.of[j_all]
        own = row_of[rows[lo + i_all]]
        a_all = np.maximum(first[own], start[rows[lo + i_all]] - long[k_all])
        e_all = np.minimum(first[own] + n[own], start[rows[lo + i_all]] + passage + long[k_all])
        b_all, f_all = np.searchsorted(inside, a_all), np.searchsorted(inside, e_all)
        many = count_bits(plan.has, k_all, word, b_all, f_all - b_all)
        enough = np.flatnonzero((many >= least * long[k_all]) & (many >= known[k_all] - lost[k_all]))
        for i, j, k, a, e, b, f in zip(*(x[enough].tolist() for x in (i_all, j_all, k_all, a_all, e_all, b_all, f_all))):
            w_in = word[b:f]
            if len(set(w_in[bit(plan.has, k, w_in)].tolist())) < known[k] - lost[k]:
                continue
            r = int(row_of[rows[lo + i]])
            item_id, ws = plan.items[k]
            if best.get((r, item_id), (0, 0, 0))[1] >= 1.0:
                continue
            region = h[a:e].tolist()
            full, share, said = set(ws), 0.0, 0.0
            # the densest stretch, of 1.5 times the item's length
            width = -(-3 * len(ws) // 2)
            hits = np.concatenate([[0], np.cumsum([x in full for x in region])])
            stops = np.minimum(np.arange(len(region)) + width, len(region))
            at = int(np.argmax(hits[stops] - hits[:-1]))
            lo_w, hi_w = max(0, at - len(ws) // 4), min(len(region), at + width + len(ws) // 4)
            near = region[lo_w:hi_w]
            share = lcs(ws, near) / len(ws)
            tail = ws[-max(1, -(-len(ws) // 4)) :]
            said = lcs(tail, near) / len(tail)
            if share >= least and said >= answer:
                key = (r, item_id)
                got = (float(cos[i, j]), share, said)
                best[key] = max(best.get(key, got), got, key=lambda x: (x[1], x[2], x[0]))
    return [(r, item, *x) for (r, item), x in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, rank: int = RANK, max_df: float = MAX_DF, cosine: float = COSINE, least: float = LCS, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): documents that hold a benchmark item or a paraphrase of it.

    Null, empty and wordless texts and items hold nothing; a null doc_id stays null; repeated rows
    are reported each; an item_id with several texts stands for any of them; other columns are not
    read.  Without items there are no rows.
    """
    found = plan(docs, benchmark, passage, rank, max_df)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ts.chunks(b):
                got = matches(c, sent.value, passage, cosine, least, answer)
                if got:
                    r, item, cos, share, said = zip(*got)
                    yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(r)), pa.array(item, pa.int64()), pa.array(cos), pa.array(share), pa.array(said)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, rank: int = RANK, max_df: float = MAX_DF, cosine: float = COSINE, least: float = LCS, answer: float = ANSWER) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns and all other rows stay."""
    found = plan(docs, benchmark, passage, rank, max_df)
    if found is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ts.chunks(b):
                stay = np.ones(c.num_rows, dtype=bool)
                stay[[x[0] for x in matches(c, sent.value, passage, cosine, least, answer)]] = False
                yield c.filter(pa.array(stay))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_benchmark_decontamination": op7_decontamination}
SQL: dict[str, str] = {}
