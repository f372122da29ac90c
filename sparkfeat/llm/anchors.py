"""Content-defined anchors: where two texts share enough words, they share an anchor.

Among the hashes of all runs of ``GRAM`` words, those that are least in some window of ``SPREAD``
neighbours are anchors (winnowing; Schleimer et al., 2003).  Any ``GRAM + SPREAD - 1`` = 50 words
hold one at least, at the same place in every copy.  Anchors that occur once in the corpus rule out
the windows around them; a Bloom filter carries those that repeat back to the texts, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textscan as ts
from .common import tidy

GRAM, SPREAD = 12, 39
LENGTH = GRAM + SPREAD - 1


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` word hashes, whatever rows they lie in."""
    m = len(h) - length + 1
    if m <= 0:
        return np.zeros(0, ts.U64)
    fwd, inv = ts._Powers.upto(len(h) + 1)
    acc = np.concatenate([np.zeros(1, ts.U64), np.cumsum(h * fwd[: len(h)], dtype=ts.U64)])
    return ts.mix((acc[length:] - acc[:m]) * inv[:m])


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every window of ``width`` values."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors of a buffer of rows of words."""
    g = window_hashes(h, GRAM)
    if not len(g):
        return np.zeros(0, np.int64), g
    inside = rows[: len(g)] == rows[GRAM - 1 :]
    if len(g) < SPREAD:
        least = inside.copy()
    else:
        low = sliding(g, SPREAD, np.minimum)
        pad = np.zeros(SPREAD - 1, ts.U64)
        least = (sliding(np.concatenate([pad, low, pad]), SPREAD, np.maximum)[: len(g)] == g) & inside
    at = np.flatnonzero(least)
    return at, g[at]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in ts.chunks(b):
            h, _, _, rows, _ = ts.words(c)
            yield pa.RecordBatch.from_arrays([pa.array(anchors(h, rows)[1].view(np.int64))], names=["key"])


def anchor_counts(d: DataFrame) -> DataFrame:
    """(key, n) of the anchors that occur more than once in (doc_id, text)."""
    return d.mapInArrow(tidy(_keys), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def repeated_anchors(d: DataFrame) -> np.ndarray:
    """The Bloom filter of the anchors that occur more than once in (doc_id, text).

    What uses it counts again, so results never depend on what passes by chance.
    """
    return bloom.build(anchor_counts(d).select("key"))
