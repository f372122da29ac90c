"""Repeated passages by a hash-compared suffix sort.

A suffix can share ``LENGTH`` words with another only if the least run of words among its first LENGTH
(its anchor) occurs elsewhere.  Suffixes whose anchor repeats go to their anchor's bucket, those
of neighbouring words as one segment of text; equal segments are one, with a list of their places.
Within a bucket suffixes whose anchors lie equally deep are sorted by a mergesort whose comparisons are logarithmic:
prefix polynomial hashes of the text and a binary search give the common extension of
two suffixes, and one byte decides.  All comparisons of a merge round are made at once in NumPy.
In that order a suffix that shares LENGTH words with any other shares them with a neighbour.  Such
matches are verified byte by byte before they count.

Buckets are read in lots of bounded size from rows that Spark has sorted.  An anchor that occurs more than
``HOT`` times would fill a bucket without bound; its suffixes are bucketed by all their LENGTH words,
those alone that a count of these finds twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from . import textscan as ts
from .anchors import GRAM, LENGTH, SPREAD, anchor_counts, window_hashes
from .common import discard, shared_folder, stored, table, tidy

SEGMENTS = "key long, depth int, text binary, docs array<long>, places array<int>"
SPANS = "doc_id long, start_word long, end_word long, first boolean"
#: Bytes of segments that are searched for equal ones, and sorted, at a time; occurrences from which an anchor is split.
FLUSH, LOT, HOT = 3_000_000, 2_000_000, 10_000


def words_text(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded words, each with one blank after it, end to end; and where each begins."""
    n = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(n)])
    out = low[np.minimum(ts.ranges(starts, n), len(low) - 1)] if len(starts) else low[:0].copy()
    out[at[1:] - 1] = 32
    return out, at


def sliding_least(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in every window."""
    done, out = 1, np.arange(len(g))
    pick = lambda a, b: np.where(g[b] < g[a], b, a)
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def suffixes(c: pa.RecordBatch, twice: np.ndarray, hot: np.ndarray | None):
    """(word hashes, starts, ends, first word and row of each, first words of suffixes, their anchors' places and hashes, whether hot)."""
    h, starts, ends, rows, _ = ts.words(c)
    z = np.zeros(0, np.int64)
    if len(h) < LENGTH:
        return h, starts, ends, rows, z, z, z.view(ts.U64), z.astype(bool)
    g = window_hashes(h, GRAM)
    q = sliding_least(g, SPREAD)
    new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    n = np.diff(np.append(new, len(q)))
    known = bloom.passes(twice, g[q[new]])
    split = bloom.passes(hot, g[q[new]]) if hot is not None else np.zeros(len(new), bool)
    p = np.flatnonzero(np.repeat(known, n) & (rows[: len(q)] == rows[LENGTH - 1 :]))
    return h, starts, ends, rows, p, q[p], g[q[p]], np.repeat(split, n)[p]


def _hot_windows(sent):
    """Hashes of all LENGTH words of the suffixes at hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, hot, _ = sent.value
        for b in batches:
            for c in ts.chunks(b):
                h, _, _, _, p, _, _, split = suffixes(c, twice, hot)
                if split.any():
                    yield pa.RecordBatch.from_arrays([pa.array(window_hashes(h, LENGTH)[p[split]].view(np.int64))], names=["key"])

    return run


def alike(key: np.ndarray, depth: np.ndarray, text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows sorted so that equal ones are neighbours, and where another one begins; verified byte by byte."""
    n = np.diff(offs)
    h = ts.word_hashes(text, offs[:-1], offs[1:])
    by = np.lexsort((n, h, depth, key))
    a, b = by[:-1], by[1:]
    same = (key[a] == key[b]) & (depth[a] == depth[b]) & (h[a] == h[b]) & (n[a] == n[b])
    at = np.flatnonzero(same)
    same[at] = exact(text, offs[a[at]], offs[b[at]], n[a[at]])
    return by, np.concatenate([[True], ~same])


def _segments(sent):
    """The segments of suffixes with a repeated anchor, each once with its places."""

    def flush(held: list) -> pa.RecordBatch:
        key, depth, doc, place, n = (np.concatenate([x[k] for x in held]) for k in range(5))
        text, offs = np.concatenate([x[5] for x in held]), np.concatenate([[0], np.cumsum(n)])
        by, new = alike(key, depth, text, offs)
        first = by[new]
        cut = pa.array(np.append(np.flatnonzero(new), len(by)).astype(np.int32))
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(text)])
        return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(depth[first].astype(np.int32)), whole.take(pa.array(first)).cast(pa.binary()), pa.ListArray.from_arrays(cut, pa.array(doc[by])), pa.ListArray.from_arrays(cut, pa.array(place[by].astype(np.int32)))], names=["key", "depth", "text", "docs", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, hot, repeat = sent.value
        held, size = [], 0
        for b in batches:
            for c in ts.chunks(b):
                h, starts, ends, rows, p, q, key, split = suffixes(c, twice, hot)
                if split.any():
                    w = window_hashes(h, LENGTH)[p]
                    keep = ~split | bloom.passes(repeat, w)
                    key = np.where(split, ts.mix(w), key)
                    p, q, key, split = p[keep], q[keep], key[keep], split[keep]
                if not len(p):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1) | split[1:]]))
                lo, hi = p[new], p[np.append(new[1:], len(p)) - 1] + LENGTH
                data, _ = ts.text_buffer(c.column(1))
                text, at = words_text(ts.fold(data), starts, ends)
                first = np.searchsorted(rows, rows[lo])
                n = at[hi] - at[lo]
                held.append((key[new], q[new] - lo, c.column(0).to_numpy()[rows[lo]], lo - first, n, text[ts.ranges(at[lo], n)]))
                size += int(n.sum())
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


class Extensions:
    """Common extensions of places of a text by prefix polynomial hashes and binary search."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = np.append(text, np.uint8(0))
        self.fwd, _ = ts._Powers.upto(len(text) + 2)
        self.acc = np.concatenate([np.zeros(1, ts.U64), np.cumsum(ts._BYTE_CODE[text] * self.fwd[: len(text)], dtype=ts.U64)])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        return (self.acc[low + n] - self.acc[low]) * self.fwd[high - low] == self.acc[high + n] - self.acc[high]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from a and b on agree, at most ``most``."""
        lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.equal(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


Side = tuple[Extensions, np.ndarray, np.ndarray]


def less(side: Side, i: np.ndarray, j: np.ndarray, then: Side | None = None) -> np.ndarray:
    """Whether suffix i comes before suffix j; ``then`` orders equal ones, at last their numbers do."""
    x, s, n = side
    most = np.minimum(n[i], n[j])
    c = x.common(s[i], s[j], most)
    ended = c == most
    a, b = x.text[s[i] + np.where(ended, 0, c)], x.text[s[j] + np.where(ended, 0, c)]
    tie = np.flatnonzero(ended & (n[i] == n[j]))
    out = np.where(ended, n[i] < n[j], a < b)
    if len(tie):
        out[tie] = less(then, i[tie], j[tie]) if then is not None else i[tie] < j[tie]
    return out


def sort_suffixes(side: Side, bucket: np.ndarray, then: Side | None = None) -> np.ndarray:
    """The order of suffixes within each bucket (buckets ascending): bottom-up mergesort.

    In a round every suffix finds its place in the run beside its own by binary search, all at once;
    buckets that are one run already take no part.
    """
    order = np.arange(len(bucket))
    size = np.bincount(bucket)
    start = np.cumsum(size) - size
    width = 1
    while width < size.max(initial=0):
        p = np.flatnonzero(size[bucket] > width)
        b0, m = start[bucket[p]], size[bucket[p]]
        q = p - b0
        run = q // width
        other = run ^ 1
        o0 = b0 + other * width
        on = np.clip(m - other * width, 0, width)
        lo, hi = np.zeros(len(p), np.int64), on.copy()
        while True:
            act = np.flatnonzero(lo < hi)
            if not len(act):
                break
            mid = (lo[act] + hi[act]) // 2
            before = less(side, order[o0[act] + mid], order[p[act]], then)
            lo[act], hi[act] = np.where(before, mid + 1, lo[act]), np.where(before, hi[act], mid)
        place = b0 + (run // 2) * 2 * width + (q - run * width) + lo
        new = order.copy()
        new[place] = order[p]
        order = new
        width *= 2
    return order


def exact(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes from a and b on really agree: no hash collision gets past this."""
    ok = np.ones(len(a), dtype=bool)
    for lo in range(0, len(a), 8192):
        m = n[lo : lo + 8192]
        diff = text[ts.ranges(a[lo : lo + 8192], m)] != text[ts.ranges(b[lo : lo + 8192], m)]
        total = np.concatenate([[0], np.cumsum(diff)])
        stop = np.cumsum(m)
        ok[lo : lo + 8192] = total[stop] == total[stop - m]
    return ok


def lots(batches: Iterator[pa.RecordBatch], key: str, size) -> Iterator[pa.Table]:
    """Tables of whole keys, from batches sorted by key, each with ``size`` of its rows just above LOT."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held:
            last = held[-1].column(b.schema.get_field_index(key))[-1].as_py()
            end = int(np.argmax(k != last)) if (k != last).any() else len(k)
            if end:
                held.append(b.slice(0, end))
                total += size(held[-1])
            if end == len(k):
                continue
            if total >= LOT:
                yield pa.Table.from_batches(held)
                held, total = [], 0
            b, k = b.slice(end), k[end:]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        lo = 0
        for at in starts[1:].tolist():
            if (at - lo) * size(b) >= LOT * b.num_rows:
                yield pa.Table.from_batches([*held, b.slice(lo, at - lo)])
                held, total, lo = [], 0, at
        held.append(b.slice(lo))
        total += size(held[-1])
    if held:
        yield pa.Table.from_batches(held)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its n+1 offsets into them."""
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def matches(t: pa.Table) -> pa.RecordBatch | None:
    """(doc_id, start_word, end_word, first) of the repeated suffixes of some whole buckets, neighbours united."""
    t = t.combine_chunks()
    col = lambda name: t.column(name).chunk(0)
    key, depth = col("key").to_numpy(), col("depth").to_numpy().astype(np.int64)
    text, offs = bytes_of(col("text"))
    docs, places = col("docs"), col("places")
    many = pc.list_value_length(docs).to_numpy().astype(np.int64)
    doc, place = docs.flatten().to_numpy(), places.flatten().to_numpy().astype(np.int64)
    by, new = alike(key, depth, text, offs)
    seg_of = np.empty(len(by), np.int64)
    seg_of[by] = np.cumsum(new) - 1
    own = by[new]
    # occurrences by segment, the first of each at its head
    seg = np.repeat(seg_of, many)
    o = np.lexsort((place, doc, seg))
    seg, doc, place = seg[o], doc[o], place[o]
    count = np.bincount(seg, minlength=len(own))
    head = np.cumsum(count) - count
    # suffixes: a segment's words but its last LENGTH - 1 each begin one
    begin = np.flatnonzero(np.concatenate([[True], text[:-1] == 32])) if len(text) else np.zeros(0, np.int64)
    w0 = np.searchsorted(begin, offs[own])
    m = np.searchsorted(begin, offs[own + 1]) - w0 - LENGTH + 1
    of = np.repeat(np.arange(len(own)), m)
    j = ts.ranges(np.zeros(len(own), np.int64), m)
    word = w0[of] + j
    start, stop = begin[word], np.append(begin, len(text))[word + LENGTH]
    deep = depth[own][of] - j
    by = np.lexsort((of, deep, key[own][of]))
    of, j, start, stop, deep = of[by], j[by], start[by], stop[by], deep[by]
    k = key[own][of]
    bucket = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (deep[1:] != deep[:-1])])) if len(k) else k
    order = sort_suffixes((Extensions(text), start, stop - start), bucket)
    a, b = order[:-1], order[1:]
    n = stop - start
    same = np.flatnonzero((bucket[a] == bucket[b]) & (n[a] == n[b]))
    same = same[exact(text, start[a[same]], start[b[same]], n[a[same]])]
    run = np.ones(len(order), bool)
    run[same + 1] = False
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(run) - 1
    total = np.bincount(name, weights=count[of], minlength=int(run.sum()))
    # the run's first occurrence in the corpus, by doc_id and place
    f = np.lexsort((place[head[of]] + j, doc[head[of]], name))
    lead = np.zeros(len(f), bool)
    lead[f[np.concatenate([[True], name[f][1:] != name[f][:-1]])] if len(f) else f] = True
    hit = np.flatnonzero(total[name] > 1)
    hit = hit[np.lexsort((j[hit], of[hit]))]
    if not len(hit):
        return None
    of, j, lead = of[hit], j[hit], lead[hit]
    cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (j[1:] != j[:-1] + 1)]))
    end = np.append(cut[1:], len(of)) - 1
    lead = np.logical_and.reduceat(lead, cut)
    each = count[of[cut]]
    at = ts.ranges(head[of[cut]], each)
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(place[at] + np.repeat(j[cut], each)), pa.array(place[at] + np.repeat(j[end] + LENGTH, each)), pa.array(np.repeat(lead, each) & (at == np.repeat(head[of[cut]], each)))], names=["doc_id", "start_word", "end_word", "first"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in lots(batches, "key", lambda b: int(pc.sum(pc.binary_length(b.column(2))).as_py() or 0)):
        found = matches(t)
        if found is not None:
            yield found


def united(t: pa.Table) -> pa.RecordBatch:
    """The stretches of some documents, those that overlap or touch as one."""
    doc, s, e, f = (t.column(k).to_numpy() for k in range(4))
    by = np.lexsort((e, s, doc))
    doc, s, e, f = doc[by], s[by], e[by], f[by]
    row = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    wide = int(e.max()) + 1
    reach = np.maximum.accumulate(e + row * wide) - row * wide
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] > reach[:-1])]))
    last = np.append(cut[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(s[cut]), pa.array(reach[last]), pa.array(np.logical_and.reduceat(f, cut))], names=["doc_id", "start_word", "end_word", "first"])


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in lots(batches, "doc_id", lambda b: 20 * b.num_rows):
        yield united(t)


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, first): stretches of LENGTH words or more, all of them in runs of LENGTH words that occur elsewhere too.

    Words count from 0, ``end_word`` is exclusive; ``first`` says that every repeated run of LENGTH words in the stretch is
    the corpus's first by doc_id and place.  Null, empty and short texts have none; rows with null
    doc_id are left out; repeated rows are copies of each other; a passage repeated within one text counts; other columns are not read.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    counts = stored(anchor_counts(d))
    twice, split, repeat = bloom.build(counts.select("key")), None, None
    often = counts.where(F.col("n") > hot)
    if not often.isEmpty():
        split = bloom.build(often.select("key"))
        sent = spark.sparkContext.broadcast((twice, split, None))
        repeat = bloom.build(d.mapInArrow(tidy(_hot_windows(sent)), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        sent.unpersist()
    discard(counts)
    sent = spark.sparkContext.broadcast((twice, split, repeat))
    found = d.mapInArrow(tidy(_segments(sent)), SEGMENTS).repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_matches), SPANS)
    return found.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(tidy(_union), SPANS)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_array_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
