"""Repeated substrings by level-wise doubling.

Windows of ``LENGTH`` words are counted over the whole corpus, all of them whose anchor repeats.
Windows that repeat survive; where a survivor begins right where another ends, the two make a window
of twice the length, which is counted at the next level under the pair of their names.  No other
window is extended, and the levels end when none survives.

Windows travel between the partitions that count them and those that hold their documents as
packed columns (keys as sorted differences), two shuffles a level.  Windows are the same if two hashes of them are, 95 bits
in all; names of later levels are numbers given to the windows of the one before, so no error adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .anchors import GRAM, LENGTH, SPREAD, repeated_anchors, sliding, window_hashes
from .bloom import passes
from .common import parts, shared_folder, stored, table, tidy
from .ngram_join import _packed_rows, pack, unpack

PACKED = "part int, packed binary"
SPANS = "doc_id long, start_word long, end_word long, longest long, first boolean"
FLUSH = 3_000_000


def to_keys(key: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """Windows (key, check, document, first word) to the partitions of their keys."""
    by = np.argsort(key)
    key, check, doc, pos = key[by], check[by], doc[by], pos[by]
    edges = np.array([(k << 64) // n_parts for k in range(n_parts)], dtype=ts.U64)
    cut = np.append(np.searchsorted(key, edges), len(key))

    def make(lo: int, hi: int) -> bytes:
        ids, at = np.unique(doc[lo:hi], return_inverse=True)
        return pack(np.diff(key[lo:hi], prepend=ts.U64(0)).view(np.int64), ids, at, pos[lo:hi], check[lo:hi])

    return _packed_rows(cut, make)


def second_hash(x: np.ndarray) -> np.ndarray:
    """31 bits of another hash of the same thing."""
    return (ts.mix(x ^ ts.U64(0x2545F4914F6CDD1D)) >> ts.U64(33)).astype(np.int64)


def _windows(bits, n_parts: int):
    """All windows of LENGTH words whose least run of GRAM words occurs elsewhere as an anchor too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for c in ts.chunks(b):
                h, _, _, rows, _ = ts.words(c)
                g = window_hashes(h, LENGTH)
                if not len(g):
                    continue
                # the least run of a window is an anchor in all its copies; neighbours mostly share it
                low = sliding(window_hashes(h, GRAM), SPREAD, np.minimum)
                new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                twice = np.repeat(passes(bits.value, low[new]), np.diff(np.append(new, len(low))))
                i = np.flatnonzero((rows[: len(g)] == rows[LENGTH - 1 :]) & twice)
                first = np.searchsorted(rows, np.arange(c.num_rows))
                check = second_hash(window_hashes(ts.mix(h ^ ts.U64(0xA0761D6478BD642F)), LENGTH)[i])
                held.append((g[i], check, c.column(0).to_numpy()[rows[i]], i - first[rows[i]]))
                size += len(i)
                if size >= FLUSH:
                    yield to_keys(*map(np.concatenate, zip(*held)), n_parts)
                    held, size = [], 0
        if size:
            yield to_keys(*map(np.concatenate, zip(*held)), n_parts)

    return run


def repeated(same: np.ndarray) -> np.ndarray:
    """Of rows in order, which are the same as a neighbour; ``same`` compares each with the one before it."""
    more = np.zeros(len(same) + 1, dtype=bool)
    more[1:] = same
    more[:-1] |= same
    return more


def _repeated(n_parts: int):
    """Per partition of keys: the windows that occur twice or more, named, to the partitions of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in ts.grouped(batches, "part"):
            part = group.column("part")[0].as_py()
            key, doc, pos, check = [], [], [], []
            for x in group.column("packed"):
                k, ids, at, p, other = unpack(x.as_py())
                key.append(np.cumsum(k.view(ts.U64), dtype=ts.U64))
                doc.append(ids[at])
                pos.append(p.astype(np.int32))
                check.append(other.astype(np.int32))
            key, doc, pos, check = map(np.concatenate, (key, doc, pos, check))
            by = np.argsort(key)
            by = by[repeated(key[by][1:] == key[by][:-1])]
            by = by[np.lexsort((pos[by], doc[by], check[by], key[by]))]
            key, doc, pos, check = key[by], doc[by], pos[by], check[by]
            keep = repeated((key[1:] == key[:-1]) & (check[1:] == check[:-1]))
            key, doc, pos, check = key[keep], doc[keep], pos[keep], check[keep]
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
            name = (np.cumsum(new) - 1).astype(np.int64) * n_parts + part
            home = (ts.mix(doc.view(ts.U64)) % ts.U64(n_parts)).astype(np.int64)
            by = np.lexsort((pos, doc, home))
            doc, pos, name, new, home = doc[by], pos[by], name[by], new[by], home[by]

            def make(lo: int, hi: int) -> bytes:
                start = np.flatnonzero(np.concatenate([[True], doc[lo + 1 : hi] != doc[lo : hi - 1]]))
                return pack(doc[lo + start], np.diff(np.append(start, hi - lo)), pos[lo:hi], name[lo:hi], new[lo:hi])

            yield _packed_rows(np.searchsorted(home, np.arange(n_parts + 1)), make)

    return run


def merged(group: pa.Table) -> tuple[np.ndarray, ...]:
    """(document, first word, name, first occurrence) of a document partition's windows, sorted."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for x in group.column("packed"):
        ids, n, pos, name, new = unpack(x.as_py())
        for col, v in zip(cols, (np.repeat(ids, n), pos, name, new)):
            col.append(v)
    doc, pos, name, new = map(np.concatenate, cols)
    by = np.lexsort((pos, doc))
    return doc[by], pos[by], name[by], new[by]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in ts.grouped(batches, "part"):
        doc, pos, name, new = merged(group)
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        packed = pack(doc[start], np.diff(np.append(start, len(doc))), pos, name, new)
        yield pa.RecordBatch.from_arrays([group.column("part")[:1].combine_chunks().cast(pa.int32()), pa.array([packed], pa.binary())], names=["part", "packed"])


def _doubled(length: int, n_parts: int):
    """Windows of twice the length: a survivor and the survivor that follows it in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in ts.grouped(batches, "part"):
            doc, pos, name, _ = merged(group)
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
            doc, pos, name = doc[new], pos[new], name[new]
            code = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(pos.max(initial=0)) + 2 * length + 1) + pos
            at = np.searchsorted(code, code + length)
            ok = at < len(code)
            ok[ok] = code[at[ok]] == code[ok] + length
            if ok.any():
                key = ts.mix(ts.mix(name[ok].view(ts.U64) + ts.U64(length)) * ts.U64(3) + name[at[ok]].view(ts.U64))
                check = second_hash(name[ok].view(ts.U64) * ts.U64(0x9E3779B97F4A7C15) + ts.mix(name[at[ok]].view(ts.U64)))
                yield to_keys(key, check, doc[ok], pos[ok], n_parts)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each document's surviving windows as maximal spans, with the longest window inside."""
    for group in ts.grouped(batches, "part"):
        levels = {}
        for level in sorted(set(group.column("level").to_pylist())):
            levels[level] = merged(group.filter(pa.compute.equal(group.column("level"), level)))
        base = min(levels)
        doc, pos, _, new = levels[base]
        cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + base)])
        start = np.flatnonzero(cut)
        last = np.append(start[1:], len(doc)) - 1
        longest = np.full(len(start), base)
        for level, (d, p, *_) in levels.items():
            if level == base:
                continue
            ids = np.unique(np.concatenate([doc, d]))
            wide = int(max(pos.max(), p.max())) + 2
            own = np.searchsorted(ids, doc[start]) * wide + pos[start]
            k = np.searchsorted(own, np.searchsorted(ids, d) * wide + p, side="right") - 1
            longest[k] = level
        yield pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array(pos[start].astype(np.int64)), pa.array(pos[last].astype(np.int64) + base), pa.array(longest), pa.array(new[start].astype(bool))], names=["doc_id", "start_word", "end_word", "longest", "first"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, longest, first): the maximal stretches covered by repeated windows of LENGTH words.

    Words are counted from 0, ``end_word`` is exclusive; ``longest`` is the greatest length of the
    doubling at which a window that begins in the stretch still repeats; ``first`` says that the
    stretch begins with the corpus's first occurrence, by doc_id and place.  Null, empty and short texts
    have no windows; rows with null doc_id are left out; repeated rows are copies of each other;
    a passage repeated within one text counts; other columns are not read.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    k = parts(spark)
    bits = spark.sparkContext.broadcast(repeated_anchors(d))
    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    settle = lambda keyed: stored(by_part(by_part(keyed).mapInArrow(tidy(_repeated(k)), PACKED)).mapInArrow(tidy(_gather), PACKED))
    state, length = settle(d.mapInArrow(tidy(_windows(bits, k)), PACKED)), LENGTH
    every = state.withColumn("level", F.lit(length))
    while not state.isEmpty():
        state = settle(state.mapInArrow(tidy(_doubled(length, k)), PACKED))
        length *= 2
        every = every.unionByName(state.withColumn("level", F.lit(length)))
    return by_part(every).mapInArrow(tidy(_spans), SPANS)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
SQL: dict[str, str] = {}
