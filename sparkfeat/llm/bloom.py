"""Bloom filters over 64-bit keys, sized by their number, built in the tasks and broadcast.

A filter has ten bits or more a key up to ``MAX_BITS`` (128 MB); beyond that it fills up and lets more
keys pass.  What uses a filter drops false passes later, so results never depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .common import discard, stored, tidy

MIN_BITS, MAX_BITS, SLICES = 16, 30, 64
PACKED = "part int, packed binary"


def places(key: np.ndarray, bits: int) -> np.ndarray:
    h = ts.mix(key.view(ts.U64))
    return np.stack([h >> ts.U64(64 - bits), h & ts.U64((1 << bits) - 1)]).astype(np.int64)


def passes(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; keys that are in it always pass."""
    at = places(key, len(filter_).bit_length() + 2)
    return ((filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = np.unique(places(b.column(0).to_numpy(), bits))
            np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        own = own.reshape(SLICES, -1)
        for k in np.flatnonzero(own.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(own[k].tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["part", "packed"])

    return run


def _either(bits: int):
    size = (1 << bits) // 8 // SLICES

    def run(t: pa.Table) -> pa.Table:
        both = np.zeros(size, np.uint8)
        for x in t.column("packed"):
            both |= np.frombuffer(pa.decompress(x.as_py(), decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
        return pa.table({"part": t.column("part")[:1].cast(pa.int32()), "packed": pa.array([both.tobytes()], pa.binary())})

    return run


def build(keys: DataFrame) -> np.ndarray:
    """The filter of a frame's only column, a bigint without nulls."""
    keys = stored(keys)
    bits = min(MAX_BITS, max(MIN_BITS, (10 * keys.count()).bit_length()))
    out = np.zeros((SLICES, (1 << bits) // 8 // SLICES), np.uint8)
    for r in keys.mapInArrow(tidy(_mark(bits)), PACKED).groupBy("part").applyInArrow(_either(bits), PACKED).collect():
        out[r["part"]] = np.frombuffer(r["packed"], np.uint8)
    discard(keys)
    return out.ravel()
