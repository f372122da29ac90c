"""Columnar text kernels shared by the operators of this subpackage.

An Arrow string column is scanned as one byte buffer with NumPy: word spans, 64-bit word
hashes and word n-gram hashes come from whole-array operations, never from a Python loop over
words.  A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes of the UTF-8
form; ASCII and Latin-1 capitals are folded.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that scatters nearby values."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64))
_GRAM_CODE = mix(np.arange(1001, 1001 + 256, dtype=U64)) | U64(1)


class _Powers:
    """Growing tables of the hash base's powers and inverse powers."""

    fwd = np.ones(1, dtype=U64)
    inv = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.fwd) < n:
            size = 1 << int(n - 1).bit_length()
            cls.fwd = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE)]), dtype=U64)
            cls.inv = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE_INV)]), dtype=U64)
        return cls.fwd, cls.inv


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``size`` bytes of text each, whole rows always."""
    n = batch.num_rows
    if not n:
        return
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes: ASCII, and the capitals U+00C0 to U+00DE."""
    low = _LOWER[data]
    if len(low) > 1:
        cap = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        if cap.any():
            low[1:][cap] |= 0x20
    return low


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``member`` bytes, broken at row ends."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = inside[0]
    edge[-1] = inside[-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    starts_ends = np.flatnonzero(edge)
    if len(cut):
        starts_ends = np.sort(np.concatenate([starts_ends, cut, cut]))
    starts, ends = starts_ends[0::2], starts_ends[1::2]
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes."""
    n = len(data)
    fwd, inv = _Powers.upto(n + 1)
    acc = np.empty(n + 1, dtype=U64)
    acc[0] = 0
    np.cumsum(_BYTE_CODE[data] * fwd[:n], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts])


def words(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row, first): each word's hash, byte span and row, and each row's first byte."""
    data, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
    low = fold(data)
    starts, ends, rows = spans(data, offs)
    return word_hashes(low, starts, ends), starts, ends, rows, offs


def gram_hashes(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of one row, and the number of each run's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = h[:m] * _GRAM_CODE[0]
    for j in range(1, n):
        g = g + h[j : j + m] * _GRAM_CODE[j]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(g[at]), at


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word n-grams, sorted; a row of 1 to n-1 words has one, of all its words."""
    g, at = gram_hashes(h, rows, n)
    r = rows[at]
    count = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.full(len(short), 0x5851F42D4C957F2D, dtype=U64)
        for j in range(n - 1):
            more = count[short] > j
            extra[more] = extra[more] * U64(3) + h[first[more] + j] * _GRAM_CODE[128 + j]
        g, r = np.concatenate([g, mix(extra)]), np.concatenate([r, short])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    if len(g):
        keep = np.ones(len(g), dtype=bool)
        keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[keep], r[keep]
    return r, g


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if held and k[lo] != last:
                yield pa.Table.from_batches([held.pop(0) for _ in range(len(held))])  # nothing of it is held here meanwhile
            held.append(b.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held)


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The integers lo[i] .. lo[i]+n[i]-1 of all i, one after another."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    stop = np.cumsum(n)
    return np.arange(total, dtype=np.int64) + np.repeat(lo - (stop - n), n)
