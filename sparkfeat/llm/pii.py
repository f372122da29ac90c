"""Information-theoretic sanitisation of personal data.

Protected entities (mail and network addresses, telephone, card and account numbers, keys and
passwords) are found by pattern and always generalised to their kind.  Words near them may give
them away as well.  Following Sanchez and Batet (2013), the corpus tells how strongly: with N
documents, c(t) of them holding term t, c(e) distinct contexts of entity e and c(t, e) of these
holding t,

    PMI(t; e) = log2(N c(t, e) / (c(t) c(e)))        IC(e) = log2(N / c(e))

and t discloses the share PMI / IC of what there is to know about e: 1 if t never occurs without
it.  A term that stands in at least ``support`` distinct contexts of e and whose share reaches
``remove`` is removed from the contexts of e, from ``generalise`` on it becomes ``[TERM]``.
A context is the ``WINDOW`` words on either side; copies of a context count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import discard, shared_folder, stored, table, tidy

WINDOW, SUPPORT, GENERALISE, REMOVE, FLUSH = 8, 2, 0.6, 0.9, 4_000_000
KINDS = {
    "SECRET": rb"(?<![\w])(?:[Tt]oken|TOKEN|[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Za-z+/_\-]{8,}[\"']?",
    "KEY": rb"(?<![\w])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "EMAIL": rb"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,128}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}",
    "IP": rb"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w])(?!\.\d)",
    "PHONE": rb"(?<![\w])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "ID": rb"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])|(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])",
    "CARD": rb"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w])",
}
ENTITY = re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), p) for k, p in KINDS.items()))
SEEN = "doc_id long, entity long, context long, terms array<long>, term long, n long"
CLEAN = "doc_id long, text string, n_entities int, n_terms int, kinds array<string>"


def entities(row: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the protected entities in a text's UTF-8 bytes, left to right."""
    return [(m.start(), m.end(), m.lastgroup) for m in ENTITY.finditer(row)]


def suspicious(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that may hold an entity: all kinds need a digit, an @, or a sign after a secret's name."""
    mark = (data >= 48) & (data <= 58) | (data == 61) | (data == 64)
    count = np.concatenate([[0], np.cumsum(mark)])
    return np.flatnonzero(count[offs[1:]] > count[offs[:-1]])


def contexts(data: np.ndarray, offs: np.ndarray, window: int) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
    """(row, start, end, kind, word numbers) of each entity, with the words around it that are in no entity."""
    starts, ends, rows = ts.spans(data, offs)
    raw = data.tobytes()
    for r in suspicious(data, offs).tolist():
        base = int(offs[r])
        found = entities(raw[base : offs[r + 1]])
        if not found:
            continue
        lo, hi = np.searchsorted(rows, [r, r + 1])
        free = np.ones(hi - lo, dtype=bool)
        edges = []
        for s, e, _ in found:
            i = lo + np.searchsorted(ends[lo:hi], base + s, side="right")
            j = lo + np.searchsorted(starts[lo:hi], base + e, side="left")
            free[i - lo : j - lo] = False
            edges.append((i, j))
        for (s, e, kind), (i, j) in zip(found, edges):
            near = np.concatenate([np.arange(max(lo, i - window), i), np.arange(j, min(hi, j + window))])
            yield r, base + s, base + e, kind, near[free[near - lo]]


def value_of(kind: str, text: bytes) -> int:
    """The entity's 64-bit name: of its value without blanks and signs, in lower case."""
    bare = np.frombuffer(kind.encode() + re.sub(rb"[^0-9A-Za-z@.]", b"", text).lower(), dtype=np.uint8)
    return int(ts.word_hashes(bare, np.array([0]), np.array([len(bare)])).view(np.int64)[0])


def _observe(window: int):
    def counts(hashes: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        h, r = np.concatenate(hashes), np.concatenate(rows)
        by = np.lexsort((r, h))
        h, r = h[by], r[by]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
        h = h[once]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        k = len(first)
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h))))], schema=_SEEN_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, rs, held, base = [], [], 0, 0
        for b in batches:
            for c in ts.chunks(b):
                data, offs = ts.text_buffer(c.column(1))
                h, _, _, rows, _ = ts.words(c)
                hs.append(h)
                rs.append(rows + base)
                held, base = held + len(h), base + c.num_rows
                ids = c.column(0).to_pylist()
                raw = data.tobytes()
                out = []
                for r, s, e, kind, near in contexts(data, offs, window):
                    terms = sorted(set(h[near].view(np.int64).tolist()))
                    mark = ts.mix(h[near] * ts.U64(3) + np.arange(len(near), dtype=ts.U64)) if len(near) else np.zeros(0, ts.U64)
                    out.append((ids[r], value_of(kind, raw[s:e]), int(np.bitwise_xor.reduce(mark).view(np.int64)) if len(mark) else 0, terms))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())], schema=_SEEN_ARROW)
                if held >= FLUSH:
                    yield counts(hs, rs)
                    hs, rs, held, base = [], [], 0, 0
        if held:
            yield counts(hs, rs)

    return run


_SEEN_ARROW = pa.schema([("doc_id", pa.int64()), ("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(pa.int64())), ("term", pa.int64()), ("n", pa.int64())])


def disclosure(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shares, observations, table): how much each term discloses of each entity, where they were seen, and the stored table that both read.

    ``shares`` has (entity, term, c_te, c_t, c_e, share) for terms in ``support`` distinct contexts.
    All counts are over all rows; rows with null text hold nothing.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    shared_folder(docs.sparkSession)
    seen = stored(d.mapInArrow(tidy(_observe(window)), SEEN))
    at = seen.where("entity is not null").select("doc_id", "entity", "context", "terms")
    distinct = at.groupBy("entity", "context").agg(F.first("terms").alias("terms"))
    c_e = distinct.groupBy("entity").agg(F.count("*").alias("c_e")).where(F.col("c_e") >= support)
    c_te = distinct.join(c_e.select("entity"), "entity", "left_semi").select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("c_te")).where(F.col("c_te") >= support)
    c_t = seen.where("term is not null").groupBy("term").agg(F.sum("n").alias("c_t"))
    total = d.where("text <> ''").count()
    ratio = F.log2(F.lit(float(total)) * F.col("c_te") / (F.greatest("c_t", "c_te") * F.col("c_e")))
    shares = c_te.join(c_e, "entity").join(c_t, "term").withColumn("share", F.when(F.col("c_e") >= total, F.lit(0.0)).otherwise(ratio / F.log2(F.lit(float(total)) / F.col("c_e"))))
    return shares, at, seen


def _sanitise(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ts.chunks(b):
                data, offs = ts.text_buffer(c.column(1))
                told = c.column(2).to_pylist()
                cuts: dict[int, list[tuple[int, int, bytes]]] = {}
                kinds: dict[int, set[str]] = {}
                terms: dict[int, int] = {}
                raw = data.tobytes()
                starts, ends, h = None, None, None
                for r, s, e, kind, near in contexts(data, offs, window):
                    cuts.setdefault(r, []).append((s, e, b"[%s]" % kind.encode()))
                    kinds.setdefault(r, set()).add(kind)
                    if told[r]:
                        if h is None:
                            h, starts, ends, _, _ = ts.words(c)
                        name = value_of(kind, raw[s:e])
                        act = {x["term"]: x["gone"] for x in told[r] if x["entity"] == name}
                        for k in near.tolist():
                            gone = act.get(int(h[k].view(np.int64)))
                            if gone is not None:
                                terms[r] = terms.get(r, 0) + 1
                                cuts[r].append((int(starts[k]), int(ends[k]), b"" if gone else b"[TERM]"))
                texts, text = [], c.column(1)
                for r, spans in cuts.items():
                    out, at = [], int(offs[r])
                    last = -1
                    for s, e, by in sorted(spans):
                        if s < last:
                            terms[r] = terms.get(r, 0) - (by in (b"", b"[TERM]"))
                            continue
                        out += [raw[at:s], by]
                        at = last = e
                    out.append(raw[at : offs[r + 1]])
                    texts.append((r, b"".join(out).decode("utf-8", "replace")))
                if texts:
                    fixed = text.to_pylist()
                    for r, x in texts:
                        fixed[r] = x
                    text = pa.array(fixed, pa.string())
                n = c.num_rows
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), text.cast(pa.string()), pa.array([sum(1 for x in cuts.get(r, ()) if x[2] not in (b"", b"[TERM]")) for r in range(n)], pa.int32()), pa.array([terms.get(r, 0) for r in range(n)], pa.int32()), pa.array([sorted(kinds.get(r, ())) for r in range(n)], pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_entities", "n_terms", "kinds"],
                )

    return run


def _told(docs: DataFrame, window: int, support: int, generalise: float, remove: float) -> DataFrame:
    """(key, told): per document the (entity, term, gone) that its contexts hold."""
    shares, at, seen = disclosure(docs, window, support)
    risky = stored(shares.where(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("gone")))
    held = at.where("doc_id is not null").join(risky.select("entity").distinct(), "entity", "left_semi").select("doc_id", "entity", F.explode("terms").alias("term"))
    told = stored(held.join(risky, ["entity", "term"]).groupBy(F.col("doc_id").alias("key")).agg(F.collect_set(F.struct("entity", "term", "gone")).alias("told")))
    discard(seen)
    discard(risky)
    return told


def sanitise(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, text, n_entities, n_terms, kinds): every row of ``docs`` with its text sanitised.

    Null texts stay null and empty ones empty; a row with null doc_id loses its entities but no
    terms; repeated rows are sanitised each and count as so many documents, though their contexts
    count once; other columns are not read.
    """
    told = _told(docs, window, support, generalise, remove)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.join(told, d.doc_id == told.key, "left").select("doc_id", "text", "told").mapInArrow(tidy(_sanitise(window)), CLEAN)


def sanitised_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``text`` sanitised and ``n_chars``, if there, its new length; all other columns and rows stay."""
    window = how.get("window", WINDOW)
    told = _told(docs, window, how.get("support", SUPPORT), how.get("generalise", GENERALISE), how.get("remove", REMOVE))
    rest = [c for c in docs.columns if c != "text"]
    d = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), F.struct(*rest).alias("__rest") if rest else F.lit(None).alias("__rest"))
    d = d.join(told, d["__id"] == told.key, "left").select("__id", "__text", "told", "__rest")
    schema = d.select(F.col("__text").alias("text"), "__rest").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = _sanitise(window)
        for b in batches:
            for c in ts.chunks(b, "__text"):
                small = pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2)], names=["doc_id", "text", "told"])
                for done in clean(iter([small])):
                    yield pa.RecordBatch.from_arrays([done.column(1), c.column(3).slice(0, done.num_rows)], names=["text", "__rest"])

    out = d.mapInArrow(tidy(run), schema)
    length = F.when(F.col("text").isNull(), F.col("__rest.n_chars")).otherwise(F.length("text")) if "n_chars" in rest else None
    cols = [F.col("text") if c == "text" else length.cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii_sanitisation": op2_pii}
SQL: dict[str, str] = {}
