"""N-gram Jaccard self-join by prefix filters under several global token orders.

Two n-gram sets with Jaccard similarity of at least t share a token among the first
``n - ceil(t n) + 1`` tokens of each, whatever global order sorts the tokens (Chaudhuri et al.,
2006; Xiao et al., 2008).  So a pair must pass that test under *every* order, and the pairs that
pass under all of them are few.

* Order 1 sorts tokens by how often they occur, counted over all documents (equal sets once for each lot
  of documents that a task packs).  Tokens go
  to the partitions that count them as packed, compressed columns of keys just long enough to tell
  them apart (equal keys only move a token within the order), and back to their lots.  Those that occur
  once come first in the order and link nothing, so a document in which they fill the prefix
  has no partner and is done; of the others the rest of the prefix is joined by token.
* Linked documents are brought together with their texts, each once; a component of more than
  ``block`` documents, or of as many tokens as they have, is tiled into pairs of blocks.  There the prefixes under further
  orders, of rising frequency as well, are intersected, and what is left is verified by exact counts.

Documents with equal sets are one vertex of all this.  A tile gives each set's number of links and its
group, so what is written grows with the documents, never with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bloom
from . import textscan as ts
from .common import components, discard, parts, shared_folder, stored, table, tidy

N, THRESHOLD, ORDERS, BLOCK = 3, 0.5, 3, 4096
SPARE_BITS, FLUSH = 8, 3_000_000
#: Tokens a set of a full block has on average at most; cells of a comparison, and places in lists, at a time.
WORDS, CELLS, WORK = 400, 1 << 21, 1 << 21
PACKED = "part int, packed binary"
LOTS = "part int, lot long, head boolean, packed binary"


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def signatures(rows: np.ndarray, g: np.ndarray, n_rows: int) -> np.ndarray:
    """A 64-bit hash of each row's set; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, ts.U64), np.cumsum(ts.mix(g ^ ts.U64(0xD6E8FEB86659FD93)), dtype=ts.U64)])
    n = np.bincount(rows, minlength=n_rows)
    end = np.cumsum(n)
    sig = ts.mix(total[end] - total[end - n] + n.astype(ts.U64))
    return np.where(n > 0, np.where(sig == 0, ts.U64(1), sig), ts.U64(0))


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ts.chunks(b):
                h, _, _, rows, _ = ts.words(c)
                r, g = ts.shingles(h, rows, c.num_rows, n)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(signatures(r, g, c.num_rows).view(np.int64)), pa.array(np.bincount(r, minlength=c.num_rows))], names=["doc_id", "sig", "n"])

    return run


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers as one compressed string; high bytes of small numbers vanish."""
    out = [np.array([len(columns), *(len(c) for c in columns)], dtype=np.int64).tobytes()]
    out += [np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, k, 8)
    at, out = 8 * (k + 1), []
    for m in sizes.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * m, at).reshape(8, m).T).view(np.int64).ravel())
        at += 8 * m
    return out


def _packed_rows(cut: np.ndarray, make) -> pa.RecordBatch:
    """One packed row for each non-empty range of sorted rows between neighbours in ``cut``."""
    keep = np.flatnonzero(np.diff(cut) > 0)
    return pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array([make(int(cut[k]), int(cut[k + 1])) for k in keep], pa.binary())], names=["part", "packed"])


def _lot_rows(part: np.ndarray, lot: np.ndarray, head: bool, packed: list[bytes]) -> pa.RecordBatch:
    n = len(packed)
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(lot.astype(np.int64)), pa.array([head] * n), pa.array(packed, pa.binary())], names=["part", "lot", "head", "packed"])


def _tokens(n: int, n_parts: int, bits: int):
    """The tokens of a lot of sets, each set once, to the partitions of their keys, keys sorted and as differences; and the lot's sets.

    A lot is named by its task and number; both come out the same if the task runs again.
    """

    def flush(lot: int, g: list[np.ndarray], d: list[np.ndarray], sig: list[np.ndarray], size: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, doc = np.concatenate(g), np.concatenate(d)
        g.clear(), d.clear()
        key >>= ts.U64(64 - bits)
        sigs, first = np.unique(np.concatenate(sig), return_index=True)
        sizes_all = np.concatenate(size)
        sizes = sizes_all[first]
        own = np.full(int(doc.max()) + 1, -1, dtype=np.int32)
        own[first[first < len(own)]] = np.flatnonzero(first < len(own))
        doc = own[doc]
        if len(sigs) < len(sizes_all):
            key, doc = key[doc >= 0], doc[doc >= 0]
        by = np.argsort(key)
        key, doc = key[by].view(np.int64), doc[by]
        del by
        cut = np.searchsorted(key, [((k << bits) + n_parts - 1) // n_parts for k in range(n_parts + 1)])
        some = np.flatnonzero(np.diff(cut) > 0)
        yield _lot_rows(some, np.full(len(some), lot), False, [pack(np.diff(key[cut[k] : cut[k + 1]], prepend=0), doc[cut[k] : cut[k + 1]]) for k in some.tolist()])
        yield _lot_rows(np.array([lot % n_parts]), np.array([lot]), True, [pack(sigs, sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 24
        g_all, d_all, s_all, n_all, docs, held = [], [], [], [], 0, 0
        for b in batches:
            for c in ts.chunks(b):
                h, _, _, rows, _ = ts.words(c)
                r, g = ts.shingles(h, rows, c.num_rows, n)
                if not len(g):
                    continue
                g_all.append(g)
                d_all.append((r + docs).astype(np.int32))
                s_all.append(signatures(r, g, c.num_rows).view(np.int64))
                n_all.append(np.bincount(r, minlength=c.num_rows))
                docs += c.num_rows
                held += len(g)
                if held >= FLUSH:
                    yield from flush(lot, g_all, d_all, s_all, n_all)
                    g_all, d_all, s_all, n_all, docs, held, lot = [], [], [], [], 0, 0, lot + 1
        if held:
            yield from flush(lot, g_all, d_all, s_all, n_all)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition of keys: the tokens of two sets or more, with the number of lots' sets that hold them, back to their lots."""
    for group in ts.grouped(batches, "part"):
        key, who, lots = [], [], []
        for lot, head, x in zip(group.column("lot").to_pylist(), group.column("head").to_pylist(), group.column("packed")):
            if head:
                yield _lot_rows(np.zeros(1), np.array([lot]), True, [x.as_py()])
                continue
            k, at = unpack(x.as_py())
            key.append(np.cumsum(k))
            who.append(at + (len(lots) << 32))
            lots.append(lot)
        if not key:
            continue
        key, who = np.concatenate(key), np.concatenate(who)
        by = np.argsort(key, kind="stable")  # a key's sets stay in the order of their lots
        key, who = key[by], who[by]
        more = np.zeros(len(key), dtype=bool)
        more[1:] = key[1:] == key[:-1]
        more[:-1] |= more[1:].copy()
        key, who = key[more], who[more]
        if not len(key):
            continue
        by = np.lexsort((who, key))
        key, who = key[by], who[by]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[first], who[first]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df = np.diff(np.append(start, len(key)))
        df = np.repeat(df, df)
        keep = df > 1
        key, who, df = key[keep], who[keep], df[keep]
        by = np.argsort(who >> 32, kind="stable")
        key, who, df = key[by], who[by], df[by]
        cut = np.searchsorted(who >> 32, np.arange(len(lots) + 1))
        some = np.flatnonzero(np.diff(cut) > 0)
        if len(some):
            yield _lot_rows(np.zeros(len(some)), np.array(lots)[some], False, [pack(np.diff(key[cut[k] : cut[k + 1]], prepend=0), who[cut[k] : cut[k + 1]] & 0xFFFFFFFF, df[cut[k] : cut[k + 1]]) for k in some.tolist()])


def _prefix_rows(t: float):
    """Order 1: the part of each set's prefix that other sets may share, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in ts.grouped(batches, "lot"):
            sigs = sizes = None
            key, at, df = [], [], []
            for head, x in zip(group.column("head").to_pylist(), group.column("packed")):
                if head:
                    sigs, sizes = unpack(x.as_py())
                else:
                    k, a, f = unpack(x.as_py())
                    key.append(np.cumsum(k))
                    at.append(a.astype(np.int32))
                    df.append(f)
            if not key:
                continue
            key, at, df = np.concatenate(key), np.concatenate(at), np.concatenate(df)
            by = np.lexsort((ts.mix(key.view(ts.U64)), df, at))
            key, at = key[by], at[by]
            count = np.bincount(at, minlength=len(sigs))
            take = prefix_length(sizes, t) - (sizes - count)
            keep = np.arange(len(at)) - (np.cumsum(count) - count)[at] < take[at]
            if not keep.any():
                continue
            # within the lot sets that share a token are joined at once; one of each group carries its tokens on
            key, at = key[keep], at[keep].astype(np.int64)
            group, spans = grouped_by(key, at, len(sigs))
            by = np.lexsort((group[at], key))
            key, at = key[by], group[at[by]]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(key[once]), pa.array(sigs[at[once]]), pa.nulls(int(once.sum()), pa.int64())], names=["token", "sig", "other"])
            if len(spans):
                yield pa.RecordBatch.from_arrays([pa.array(sigs[spans]), pa.array(sigs[spans]), pa.array(sigs[group[spans]])], names=["token", "sig", "other"])

    return run


def grouped_by(key: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each of n vertices that share keys in a row, named by its least one; the vertices that are not their group's name)."""
    by = np.lexsort((at, key))
    k, v = key[by], at[by]
    same = np.flatnonzero((k[1:] == k[:-1]) & (v[1:] != v[:-1]))
    code = np.unique(v[same] * n + v[same + 1])
    group = joined(n, code // n, code % n)
    return group, np.flatnonzero(group != np.arange(n))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that span the groups of vertices that share tokens, and those that came along."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    token, sig = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
    other = pa.chunked_array([b.column(2) for b in held])
    edge = pa.compute.is_valid(other).to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_arrays([pa.array(sig[edge]), other.filter(pa.array(edge)).combine_chunks()], names=["a", "b"])
    del held, other
    names, at = np.unique(sig[~edge], return_inverse=True)
    group, spans = grouped_by(token[~edge], at.astype(np.int64), len(names))
    yield pa.RecordBatch.from_arrays([pa.array(names[spans]), pa.array(names[group[spans]])], names=["a", "b"])


class Side(NamedTuple):
    """Token sets of one side of a comparison: their tokens as (row, token), rows ascending, and how many sets there are."""

    rows: np.ndarray
    g: np.ndarray
    m: int


def shared_counts(a: Side, b: Side, lo: int, hi: int) -> np.ndarray:
    """How many tokens each set of ``a`` from lo to hi shares with each of ``b``.

    Tokens in many sets of ``b`` are counted by a matrix product, the others through the lists of their sets.
    """
    out = np.zeros((hi - lo) * b.m, np.float32)
    i, j = np.searchsorted(a.rows, [lo, hi])
    by = np.argsort(b.g, kind="stable")
    gb, rb = b.g[by], b.rows[by]
    start = np.flatnonzero(np.concatenate([[True], gb[1:] != gb[:-1]])) if len(gb) else np.zeros(0, np.int64)
    if i == j or not len(start):
        return out.reshape(hi - lo, b.m)
    df = np.diff(np.append(start, len(gb)))
    at = np.minimum(np.searchsorted(gb[start], a.g[i:j]), len(start) - 1)
    hit = gb[start[at]] == a.g[i:j]
    at, row = at[hit], a.rows[i:j][hit] - lo
    heavy = df > max(8, b.m // 8)
    big = heavy[at]
    if big.any():
        col = np.cumsum(heavy) - 1
        which = np.flatnonzero(heavy)
        x, y = (at[big], row[big])
        for k in range(0, len(which), 2048):
            some = which[k : k + 2048]
            xb = np.zeros((b.m, len(some)), np.float32)
            xb[rb[ts.ranges(start[some], df[some])], np.repeat(np.arange(len(some)), df[some])] = 1
            mine = (col[x] >= k) & (col[x] < k + 2048)
            xa = np.zeros((hi - lo, len(some)), np.float32)
            xa[y[mine], col[x[mine]] - k] = 1
            out += (xa @ xb.T).ravel()
    at, row = at[~big], row[~big]
    work = np.cumsum(df[at])
    k = 0
    while k < len(at):
        end = max(k + 1, int(np.searchsorted(work, (work[k - 1] if k else 0) + WORK, side="right")))
        n = df[at[k:end]]
        flat = np.repeat(row[k:end] * b.m, n) + rb[ts.ranges(start[at[k:end]], n)]
        if len(flat) * 8 > len(out):
            out += np.bincount(flat, minlength=len(out)).astype(np.float32)
        else:
            np.add.at(out, flat, np.float32(1))
        k = end
    return out.reshape(hi - lo, b.m)


def split(rows: np.ndarray, g: np.ndarray, first: int | None, m: int) -> tuple[Side, Side]:
    """The sets before ``first`` and those from it on; both are all sets if it is None."""
    if first is None:
        return (one := Side(rows, g, m)), one
    k = int(np.searchsorted(rows, first))
    return Side(rows[:k], g[:k], first), Side(rows[k:] - first, g[k:], m - first)


def linked(rows: np.ndarray, g: np.ndarray, size: np.ndarray, weight: np.ndarray, first: int | None, t: float, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of sets given as (row, token), rows ascending; all meet, or only those before ``first`` the others.

    The prefixes are taken under further orders: by the number of these sets that hold a token, and
    by that number times a random one, of hashes.  Tokens of one set come first in each
    and link nothing.  What shares a prefix token under every order is verified by its exact count.
    ``links`` adds up the weights of the similar sets; ``root`` is the least row of a set's group.
    """
    m = len(size)
    links, root = np.zeros(m), np.arange(m)
    while True:
        by = np.argsort(g, kind="stable")
        new = np.concatenate([[True], g[by][1:] != g[by][:-1]]) if len(g) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        df = np.empty(len(g), np.int64)
        df[by] = np.repeat(np.diff(np.append(start, len(g))), np.diff(np.append(start, len(g))))
        common = np.bincount(rows[df > 1], minlength=m)
        take = np.where(size > 0, prefix_length(size, t), 0) - (size - common)
        keep = (df > 1) & (take[rows] > 0)
        if keep.all():
            break
        rows, g = rows[keep], g[keep]
    if not len(g):
        return links, root
    count = np.bincount(rows, minlength=m)
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    prefix = []
    for order in range(1, orders):
        h = ts.mix(g ^ ts.U64(0xA0761D6478BD642F * order & (2**64 - 1)))
        key = df if order == 1 else df * -np.log((h >> ts.U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        by = np.lexsort((h, key, rows))
        by = np.sort(by[rank < take[rows]])
        prefix.append(split(rows[by], g[by], first, m))
    del by, new, start, df, keep, rank, h, key  # each as long as the tokens; the comparison needs none
    a, b = split(rows, g, first, m)
    off = first or 0
    size_a, size_b, w_a, w_b = size[:first], size[off:], weight[:first], weight[off:]
    step = max(1, CELLS // max(1, b.m))
    ends: list[np.ndarray] = []
    for lo in range(0, a.m, step):
        hi = min(a.m, lo + step)
        likely = np.ones((hi - lo, b.m), bool)
        for x, y in prefix:
            likely &= shared_counts(x, y, lo, hi) > 0
        if first is None:
            likely[np.arange(hi - lo), np.arange(lo, hi)] = False
        live = np.flatnonzero(likely.any(axis=1))
        if not len(live):
            continue
        lo_live, hi_live = lo + int(live[0]), lo + int(live[-1]) + 1
        n = shared_counts(a, b, lo_live, hi_live)
        ok = likely[lo_live - lo : hi_live - lo] & (n >= (t - 1e-12) * (size_a[lo_live:hi_live, None] + size_b[None, :] - n))
        links[lo_live:hi_live] += ok @ w_b
        if first is not None:
            links[first:] += w_a[lo_live:hi_live] @ ok
        i, j = np.nonzero(ok)
        # of a set's similar sets its first is enough to tell its group, and each set names its own
        head = ok.argmax(axis=1)
        heads = head[i] + off
        ends.append(np.unique(np.concatenate([(i + lo_live) * m + heads, (j + off) * m + heads])))
    if ends:
        code = np.concatenate(ends)
        root = joined(m, code // m, code % m)
    return links, root


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each number's group, of n numbers joined by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, root[a], new[b])
        np.minimum.at(new, root[b], new[a])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _verify(n: int, t: float, orders: int):
    """(sig, links, root) of a tile's sets that are similar to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in ts.grouped(batches, "block"):
            cross = group.column("cross")[0].as_py()
            group = group.select(["sig", "text", "w", "side"])
            r_all, g_all, base = [], [], 0
            sig = []
            for b in group.to_batches():
                for c in ts.chunks(b):
                    h, _, _, rows, _ = ts.words(c)
                    r, g = ts.shingles(h, rows, c.num_rows, n)
                    sig.append(signatures(r, g, c.num_rows).view(np.int64))
                    r_all.append(r + base)
                    g_all.append(g)
                    base += c.num_rows
            want, sig, weight = group.column("sig").to_numpy(), np.concatenate(sig), group.column("w").to_numpy()
            side = group.column("side").to_numpy()
            del group, b, c, h, r  # the texts: a tile's tokens are all that the rest needs
            rows, r_all = np.concatenate(r_all), []
            g, g_all = np.concatenate(g_all), []
            # a doc_id may have come with other texts or twice: each set counts once, one side after the other
            order = np.lexsort((sig, side, sig != want))
            good = sig[order] == want[order]
            good[1:] &= (sig[order][1:] != sig[order][:-1]) | ~good[:-1]
            use = order[good]
            place = np.full(base, -1)
            place[use] = np.arange(len(use))
            keep = place[rows] >= 0
            rows, g = place[rows[keep]], g[keep]
            by = np.argsort(rows, kind="stable")
            rows, g = rows[by], g[by]
            del by, keep
            size = np.bincount(rows, minlength=len(use))
            first = int((side[use] == 0).sum()) if cross else None
            links, root = linked(rows, g, size, weight[use].astype(np.float64), first, t, orders)
            at = np.flatnonzero(links > 0)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(sig[use[at]]), pa.array(np.rint(links[at]).astype(np.int64)), pa.array(sig[use[root[at]]])], names=["sig", "links", "root"])

    return run


def maybe_in(d: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``d`` whose doc_id a Bloom filter does not rule out of ``some``, so that few texts are shuffled; and the others.

    The others are those with null doc_id, and those that are surely not in ``some``.
    """
    bits = bloom.build(some.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null"))
    sent = d.sparkSession.sparkContext.broadcast(bits)
    where = d.columns.index("doc_id")

    def of(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(where)
                hit = bloom.passes(sent.value, pa.compute.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
                hit &= ~pa.compute.is_null(ids).to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == inside))

        return run

    return d.mapInArrow(tidy(of(True)), d.schema), d.mapInArrow(tidy(of(False)), d.schema)


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """(doc_id, sig, root, class_id, links): the class and the number of similar documents of each document.

    A document is a doc_id and one of its word n-gram sets, named by ``sig``; two are linked if their sets are as similar
    as ``threshold``, copies included.  Links in a row make a class, named by its least doc_id; ``root`` is one of its sets.

    A text of fewer than n words has one n-gram, all its words.  Null, empty and wordless texts
    have no n-grams: sig 0, no links, each a class of its own.  Rows with null doc_id are left out.
    Repeated rows count once; a doc_id with several different texts has a row for each.  Other columns are not read.
    """
    if not 0 < threshold <= 1 or orders < 2:
        raise ValueError("threshold must be above 0 and at most 1, orders at least 2")
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    shared_folder(spark)
    sets = stored(every.mapInArrow(tidy(_profile(n)), "doc_id long, sig long, n long").distinct())
    d = every.where("text is not null")
    vertex = stored(sets.where("sig <> 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"), F.first("n").alias("n")))
    k = parts(spark)
    total = vertex.agg(F.sum("n")).first()[0] or 1
    bits = min(63, max(24, int(total).bit_length() + SPARE_BITS))
    # a table in between, so that the tokens' files are gone when the prefixes are shuffled
    shared = stored(d.mapInArrow(tidy(_tokens(n, k, bits)), LOTS).repartition("part").sortWithinPartitions("part").mapInArrow(tidy(_frequencies), LOTS))
    prefix = shared.repartition("lot").sortWithinPartitions("lot").mapInArrow(tidy(_prefix_rows(threshold)), "token long, sig long, other long")
    comps = components(prefix.repartition("token").mapInArrow(tidy(_links), "a long, b long"))
    discard(shared)
    member = vertex.join(comps, vertex.sig == comps.node).select("sig", "rep", "w", "n", "root")
    sizes = member.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("all") / (block * WORDS))).cast("int")
    member = stored(member.join(sizes, "root").select(F.col("rep").alias("doc_id"), "sig", "w", "root", blocks.alias("blocks")))
    home = F.expr("cast(pmod(sig, blocks) as int)")
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.xxhash64("root", F.least(home, k), F.greatest(home, k)).alias("block"), F.when(home > k, 1).otherwise(0).alias("side"), (home != k).alias("cross")))
    rows = maybe_in(d, member.select("doc_id").distinct())[0].join(member, "doc_id")
    rows = rows.select("sig", "text", "w", "blocks", F.explode(tile).alias("x")).select("sig", "text", "w", "x.block", "x.side", "x.cross")
    near = stored(rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_verify(n, threshold, orders)), "sig long, links long, root long"))
    found = near.groupBy("sig").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    # a group within one tile is whole; those of several tiles join where they share a set
    many = near.join(member.where("blocks > 1").select("sig"), "sig", "left_semi").select(F.col("sig").alias("a"), F.col("root").alias("b"))
    if not many.isEmpty():
        wide = components(many)
        found = found.join(wide.withColumnRenamed("root", "whole"), F.col("sig") == F.col("node"), "left").select("sig", "links", F.coalesce("whole", "root").alias("root"))
    vertex = vertex.join(found.select("sig", "links", "root"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    least = vertex.groupBy("root").agg(F.min("rep").alias("class_id"))
    vertex = vertex.join(least, "root").select("sig", "root", "class_id", "links")
    return sets.join(vertex, "sig", "left").select("doc_id", "sig", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def ngram_join(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, links): one row for each document, as ``classes`` describes them and with its parameters."""
    return classes(docs, **how).select("doc_id", "class_id", "links")


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ts.chunks(b):
                h, _, _, rows, _ = ts.words(c)
                r, g = ts.shingles(h, rows, c.num_rows, n)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(signatures(r, g, c.num_rows).view(np.int64))], names=[*c.schema.names, "__sig"])

    return run


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class that the join finds: that of the least doc_id, and of its texts that of the least set.

    Rows with null doc_id or without words stay.  Of repeated rows of one doc_id and text one
    stays.  All columns are kept.
    """
    n = how.get("n", N)
    found = classes(docs, **how).where("sig <> 0")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "sig")).alias("x"))
    gone = stored(found.join(first, "root").where("doc_id <> x.doc_id or sig <> x.sig").select("doc_id", "sig"))
    some, rest = maybe_in(docs, gone)
    signed = some.mapInArrow(tidy(_signed(n)), StructType([*docs.schema.fields, StructField("__sig", LongType())]))
    left = rest.unionByName(signed.join(gone.select(F.col("doc_id").alias("__doc"), F.col("sig").alias("__gone")), (F.col("doc_id") == F.col("__doc")) & (F.col("__sig") == F.col("__gone")), "left_anti").select(*docs.columns))
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    some, once = maybe_in(left, again)
    once = once.unionByName(some.join(again, "doc_id", "left_anti").select(*docs.columns))
    return once.unionByName(some.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_join}
SQL: dict[str, str] = {}
