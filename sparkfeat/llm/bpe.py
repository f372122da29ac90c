"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding runs the tokenizers library on each distinct *unit* of a batch.  Units are cut before
every single blank that stands between two non-blank characters: the pre-tokeniser splits there
whatever surrounds the place, so the ids of a text are its units' ids in sequence.  A worker
remembers units it has met.  Byte-level BPE loses nothing, so token lengths in bytes
give every token's byte span; a running count of UTF-8 lead bytes maps it to characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import table, tidy

#: The tokenizer file, unless the session sets ``spark.sparkfeat.tokenizer``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ENCODED = "doc_id long, token_ids array<int>, char_starts array<int>, mid_char array<int>, n_tokens int, n_bytes long, round_trip boolean"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return out


class Codec:
    """A tokenizer file with its byte table; one per Python worker."""

    MEMO = 1 << 19
    _loaded: dict[str, "Codec"] = {}

    @classmethod
    def load(cls, path: str) -> "Codec":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        symbols = byte_symbols()
        special = {i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        pieces = [b""] * size
        for word, i in vocab.items():
            pieces[i] = word.encode() if i in special else bytes(symbols[c] for c in word)
        self.len = np.array([len(p) for p in pieces], dtype=np.int64)
        self.off = np.cumsum(self.len) - self.len
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, ts.U64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count): all units' ids one after another, and how many each unit has."""
        h = ts.word_hashes(data, starts, ends)
        keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[near] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            if len(self.keys) + len(new) > self.MEMO:
                self.forget()
                new = np.arange(len(keys))
            raw = data.tobytes()
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))])
            keys_all, at_all, n_all = np.concatenate([self.keys, keys[new]]), np.concatenate([self.at, at]), np.concatenate([self.n, n])
            order = np.argsort(keys_all)
            self.keys, self.at, self.n = keys_all[order], at_all[order], n_all[order]
        where = np.searchsorted(self.keys, keys)[inv]
        return self.ids[ts.ranges(self.at[where], self.n[where])], self.n[where]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets into them) of the rows of a text buffer."""
        n_rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_rows + 1, np.int64)
        cut = units(data)
        starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cut]))
        ends = np.append(starts[1:], len(data))
        ids, count = self.encode_units(data, starts, ends)
        row = np.searchsorted(offs, starts, side="right") - 1
        per_row = np.bincount(row, weights=count, minlength=n_rows).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """Decoding: the bytes of the ids, end to end, from the byte table."""
        return self.flat[ts.ranges(self.off[ids], self.len[ids])]

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        """The text of a sequence of ids; bytes that form no whole character become U+FFFD."""
        if ids is None:
            return None
        a = np.asarray(ids, dtype=np.int64)
        a = a[(a >= 0) & (a < len(self.len))]
        return self.bytes_of(a).tobytes().decode("utf-8", "replace")


def units(data: np.ndarray) -> np.ndarray:
    """Places at which the pre-tokeniser splits whatever stands around them.

    Before a single blank between characters that are surely not white space, and between a
    letter or digit and ASCII punctuation either way round (not after an apostrophe, which may
    open a contraction).
    """
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    solid = (before > 32) & (before != 127) & (after > 32) & (after != 127)
    solid &= ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3)) & ~((before >= 0x80) & ((data[at - 2] == 0xC2) | np.isin(data[at - 3], (0xE1, 0xE2, 0xE3))))
    kind = _KIND[data]
    latin = np.zeros(len(data), dtype=bool)  # ends a letter of U+00C0 to U+00FF
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    sign = np.flatnonzero((kind[1:] == 2) & ((kind[:-1] == 1) | latin[:-1])) + 1
    word = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 2) & (data[:-1] != 39)) + 1
    return np.concatenate([at[solid], sign, word])


_KIND = np.zeros(256, dtype=np.uint8)  # 1: ASCII letter or digit, 2: ASCII punctuation
_KIND[33:127] = 2
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _KIND[_lo:_hi] = 1


def encode_batch(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
    data, offs = ts.text_buffer(batch.column(1))
    ids, rows = codec.encode(data, offs)
    size = codec.len[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    ok = np.ones(len(offs) - 1, dtype=bool)
    back = codec.bytes_of(ids)
    if len(back) != len(data) or not np.array_equal(back, data):
        fixed: list[np.ndarray] = []
        raw = data.tobytes()
        for k in range(len(offs) - 1):
            mine = ids[rows[k] : rows[k + 1]]
            want = raw[offs[k] : offs[k + 1]]
            if codec.bytes_of(mine).tobytes() != want:
                mine = np.array(codec.tok.encode(want.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.int32)
                ok[k] = codec.bytes_of(mine).tobytes() == want
            fixed.append(mine)
        ids = np.concatenate(fixed) if fixed else ids
        rows = np.concatenate([[0], np.cumsum([len(f) for f in fixed])]).astype(np.int64)
        size = codec.len[ids]
        total = np.concatenate([[0], np.cumsum(size)])
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    n = np.diff(rows)
    row_of = np.repeat(np.arange(len(n)), n)
    begin = np.minimum(total[:-1] - total[rows[:-1]][row_of] + offs[:-1][row_of], max(len(data) - 1, 0))
    inside = ~lead[begin] if len(begin) else np.zeros(0, bool)
    char_at = chars[begin] - chars[offs[:-1]][row_of] - inside
    mid = np.flatnonzero(inside)
    mid_rows = np.searchsorted(mid, rows)
    as_list = lambda v, o: pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).cast(pa.int64()), as_list(ids, rows), as_list(char_at, rows), as_list(mid - rows[:-1][row_of[mid]] if len(mid) else mid, mid_rows), pa.array(n.astype(np.int32)), pa.array(np.diff(offs)), pa.array(ok)],
        names=["doc_id", "token_ids", "char_starts", "mid_char", "n_tokens", "n_bytes", "round_trip"],
    )


def encode(docs: DataFrame, path: str = TOKENIZER, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): ids, offsets and the outcome of decoding them.

    ``char_starts[i]`` is the character in which token i begins; ``mid_char`` lists the tokens that
    begin inside a character that the token before them left unfinished.  Token i ends where token
    i+1 begins.  ``round_trip`` says that decoding the ids gives the very bytes of the text;
    ``with_text`` adds that decoded text, null for a null one.  Null and empty texts have no tokens and pass the round
    trip; a null doc_id stays null; repeated rows are encoded each; other columns are not read.
    """
    schema = ENCODED + (", text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for b in batches:
            for c in ts.chunks(b):
                out = encode_batch(c, codec)
                if with_text:
                    back = codec.bytes_of(out.column(1).flatten().to_numpy())
                    ends = np.concatenate([[0], np.cumsum(codec.len[out.column(1).flatten().to_numpy()])])[out.column(1).offsets.to_numpy()]
                    out = out.append_column("text", pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(back)]).cast(pa.string()))
                    if c.column(1).null_count:
                        text = pa.compute.if_else(pa.compute.is_null(c.column(1)), pa.scalar(None, pa.string()), out.column("text"))
                        out = out.set_column(out.schema.get_field_index("text"), "text", text)
                yield out

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, ids: str = "token_ids", out: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``df`` with ``out`` (replaced if there) decoded from the array ``ids``; null ids give null text.

    Cut sequences may begin or end inside a character: its bytes decode to U+FFFD.  Ids outside
    the vocabulary are skipped.
    """

    @F.pandas_udf("string")
    def text_of(col: pd.Series) -> pd.Series:
        codec = Codec.load(path)
        lists = pa.array(col, pa.list_(pa.int64()))
        ids_, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        ok = (ids_ >= 0) & (ids_ < len(codec.len))
        ids_, row = ids_[ok].astype(np.int64), row[ok]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=codec.len[ids_], minlength=len(lists)).astype(np.int64))])
        raw = codec.bytes_of(ids_).tobytes()
        return pd.Series([None if gone else raw[a:b].decode("utf-8", "replace") for a, b, gone in zip(ends[:-1].tolist(), ends[1:].tolist(), pa.compute.is_null(lists).to_pylist())], index=col.index, dtype=object)

    return df.withColumn(out, text_of(F.col(ids)))


def tokenizer_of(spark: SparkSession) -> str:
    return spark.conf.get("spark.sparkfeat.tokenizer", TOKENIZER)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_of(spark))


QUERIES = {"op5_bpe_encode_decode": op5_bpe}
SQL: dict[str, str] = {}
