"""Ids and offsets against the tokenizers library on whole texts, exact round trips, split characters."""

import os
import random

import pyarrow as pa
import pytest

from sparkfeat.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no tokenizer file")
HARD = ["", " a  b  c  \n\n x é 日本語 \U0001f600 don't 's", "　 x  y z", "a,b 'll 12.5%\t\tq", "<|endoftext|> is text", "é.É,×÷ x", "\x00\x7f ", "x" * 3000, " " * 500]


def random_texts():
    r = random.Random(0)
    alphabet = "ab cd  .,'\n\t1é日\U0001f600 ’-ÅßИ"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(300)]


def test_ids_and_offsets_match_the_library():
    codec = bpe.Codec.load(bpe.TOKENIZER)
    texts = HARD + random_texts()
    out = bpe.encode_batch(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]), codec)
    for k, t in enumerate(texts):
        want = codec.tok.encode(t, add_special_tokens=False)
        ids, starts, mid = (out.column(c)[k].as_py() for c in (1, 2, 3))
        assert ids == want.ids and starts == [a for a, _ in want.offsets], k
        assert codec.decode(ids) == t and out.column(6)[k].as_py()
        at, lead = 0, []
        raw = t.encode()
        for i in ids:
            lead.append(at < len(raw) and (raw[at] & 0xC0) == 0x80)
            at += int(codec.len[i])
        assert mid == [i for i, x in enumerate(lead) if x]


def test_byte_table_is_a_bijection():
    assert sorted(bpe.byte_symbols().values()) == list(range(256))


def test_frames(spark):
    rows = [(1, "a 日 b", 5), (None, "x y", 5), (2, None, 5), (3, "", 5), (4, "same", 5), (4, "same", 5), (5, "long word " * 20000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode(df, with_text=True).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == sorted(((str(a), b) for a, b, _ in rows), key=str)
    cut = spark.createDataFrame([(1, bpe.Codec.load(bpe.TOKENIZER).tok.encode("é日").ids[:2] + [10**7]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    back = {r.doc_id: r.text for r in bpe.decode(cut).collect()}
    assert back[2] is None and back[3] == "" and back[1].startswith("é")
    assert bpe.encode(df.limit(0)).count() == 0
