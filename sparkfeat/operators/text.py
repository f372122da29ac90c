"""Text features: statistics, pattern counts, label codes, TF-IDF with SVD, and pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr as E
from ..sources.shared import stored
from ..spec import FeatureSet, FeatureSpec, FeatureType, columns_of
from .tabular import label_codes, label_encode

POSITIVE = {"good", "great", "excellent", "love", "best", "happy", "nice", "perfect", "amazing", "wonderful"}
NEGATIVE = {"bad", "poor", "terrible", "hate", "worst", "sad", "awful", "broken", "horrible", "disappointing"}


def text_columns(df: DataFrame, min_length: float = 10, min_distinct: int = 10) -> list[str]:
    """String columns whose mean length and number of distinct values exceed the bounds: one aggregation."""
    cols = columns_of(df, FeatureType.CATEGORICAL)
    if not cols:
        return []
    r = df.agg(*[x for k, c in enumerate(cols) for x in (F.avg(F.length(E.q(c))).alias(f"l{k}"), F.count_distinct(F.col(E.q(c))).alias(f"d{k}"))]).first()
    return [c for k, c in enumerate(cols) if (r[f"l{k}"] or 0) > min_length and r[f"d{k}"] > min_distinct]


class TextEngine:
    def __init__(self, features: tuple[str, ...] = ("stats",), drop_original: bool = True, encode_short: bool = True) -> None:
        self.kinds, self.drop, self.encode_short = features, drop_original, encode_short
        self.features, self.texts, self.codes = FeatureSet(), [], {}

    def fit(self, df: DataFrame) -> "TextEngine":
        self.texts = text_columns(df)
        specs = []
        for c in self.texts:
            made = (E.text_features(c) if "stats" in self.kinds else {}) | (E.pattern_features(c) if "patterns" in self.kinds else {})
            specs += [FeatureSpec(f"{c}_{k}", e, source_columns=(c,), transformation=k, explanation=f"{k.replace('_', ' ')} of {c}") for k, e in made.items()]
        self.features = FeatureSet(specs)
        self.codes = {c: label_codes(df, c) for c in columns_of(df, FeatureType.CATEGORICAL) if c not in self.texts} if self.encode_short else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.select("*", *[f.column() for f in self.features if f.name not in df.columns])
        for c, codes in self.codes.items():
            out = label_encode(out, c, codes)
        return out.drop(*self.texts, *self.codes) if self.drop else out


def tfidf(df: DataFrame, key: str, column: str, max_terms: int = 5000) -> DataFrame:
    """(key, term, weight): smooth-idf weights, rows of unit length, of the most frequent terms.

    Terms are runs of two or more word characters, lower-cased, without English stop words; ties at
    the cut go to the alphabetically first.
    """
    w, _ = _weights(df, key, column, max_terms)
    return w


def _weights(df: DataFrame, key: str, column: str, max_terms: int) -> tuple[DataFrame, DataFrame]:
    """(weights as of ``tfidf``, the terms kept): term counts are worked out once and stored."""
    stop = StopWordsRemover.loadDefaultStopWords("english")
    words = df.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(F.lower(F.expr(E.text(column))), F.lit(r"(?U)\b\w\w+\b"), 0)).alias("term"))
    tf = stored(words.where(~F.col("term").isin(stop)).groupBy("k", "term").agg(F.count("*").alias("tf")))
    n = df.count()
    kept = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(max_terms)
    kept = kept.select("term", (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(F.broadcast(kept), "term").select("k", "term", (F.col("tf") * F.col("idf")).alias("w"))  # max_terms rows
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("k")))
    return w.select(F.col("k").alias(key), "term", (F.col("w") / norm).alias("weight")), kept


def tfidf_svd(df: DataFrame, key: str, column: str, components: int = 50, max_terms: int = 5000, rounds: int = 6, seed: int = 0) -> DataFrame:
    """(key, {column}_tfidf_i): projections on the leading right singular vectors, each signed so that its largest loading is positive.

    Randomised subspace iteration (Halko et al., 2011): each round multiplies the terms' basis by A'A, a pass over
    the stored rows in which every task adds up its part; the parts are summed by term in a shuffle.  The basis has
    ``max_terms`` rows at most.  Rows without any kept term have no output row.
    """
    import numpy as np
    import pyarrow as pa

    w, kept = _weights(df, key, column, max_terms)
    terms = sorted(r["term"] for r in kept.select("term").collect())
    index = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int")
    rows = stored(w.join(F.broadcast(index), "term").groupBy(key).agg(F.collect_list("i").alias("i"), F.collect_list("weight").alias("w")))
    size = len(terms)
    k = max(1, min(components, size - 1))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, k + 10))))[0] if size else np.zeros((0, 1))

    def parts_of(b: pa.RecordBatch):
        i, v = b.column(b.schema.get_field_index("i")), b.column(b.schema.get_field_index("w"))
        n = pa.compute.list_value_length(i).to_numpy(zero_copy_only=False)
        return i.flatten().to_numpy(), v.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), n)

    def times(b: pa.RecordBatch, q) -> np.ndarray:
        i, v, r = parts_of(b)
        out = np.zeros((b.num_rows, q.shape[1]))
        np.add.at(out, r, q[i] * v[:, None])
        return out

    def gram(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros(sent.value.shape)
            for b in batches:
                i, v, r = parts_of(b)
                np.add.at(y, i, times(b, sent.value)[r] * v[:, None])
            live = np.flatnonzero(np.abs(y).max(axis=1, initial=0) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array([y[j].tobytes() for j in live], pa.binary())], names=["i", "y"])

        return run

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in t.column("y")], axis=0)
        return pa.table({"i": t.column("i")[:1].cast(pa.int32()), "y": pa.array([total.tobytes()], pa.binary())})

    for step in range(rounds if size else 0):
        sent = df.sparkSession.sparkContext.broadcast(basis)
        y = np.zeros(basis.shape)
        for r in rows.mapInArrow(gram(sent), "i int, y binary").groupBy("i").applyInArrow(add, "i int, y binary").collect():
            y[r["i"]] = np.frombuffer(r["y"])
        sent.unpersist()
        if step < rounds - 1:
            basis = np.linalg.qr(y)[0]
    if size:  # eigenvectors of A'A within the subspace
        val, vec = np.linalg.eigh((basis.T @ y + y.T @ basis) / 2)
        v = (basis @ vec[:, np.argsort(-val)])[:, :k]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    else:
        v = np.zeros((0, k))
    sent = df.sparkSession.sparkContext.broadcast(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = times(b, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m[:, j]) for j in range(k)]], names=[key, *[f"{column}_tfidf_{j}" for j in range(k)]])

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"`{column}_tfidf_{i}` double" for i in range(k))
    return rows.select(key, "i", "w").mapInArrow(project, schema)


def sentiment(df: DataFrame, column: str, model: Callable[[list[str]], list[tuple[float, float, float]]] | None = None) -> DataFrame:
    """``df`` with positive, negative, neutral shares and score: of ``model`` in Arrow batches, else of a word list."""
    if model is None:
        words = F.expr(f"filter(split(lower({E.text(column)}), '[^a-z]+'), w -> w <> '')")
        inside = lambda names: F.size(F.filter(words, lambda w: w.isin(sorted(names))))
        n = F.greatest(F.size(words), F.lit(1))
        pos, neg = inside(POSITIVE) / n, inside(NEGATIVE) / n
        return df.select("*", pos.alias(f"{column}_sentiment_positive"), neg.alias(f"{column}_sentiment_negative"), (1 - pos - neg).alias(f"{column}_sentiment_neutral"), (pos - neg).alias(f"{column}_sentiment_score"))

    @F.pandas_udf("struct<p: double, n: double, u: double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield pd.DataFrame(model(s.fillna("").tolist()), columns=["p", "n", "u"])

    d = df.withColumn("__s", run(F.col(E.q(column))))
    return d.select(*df.columns, F.col("__s.p").alias(f"{column}_sentiment_positive"), F.col("__s.n").alias(f"{column}_sentiment_negative"), F.col("__s.u").alias(f"{column}_sentiment_neutral"), (F.col("__s.p") - F.col("__s.n")).alias(f"{column}_sentiment_score"))


def embed(df: DataFrame, key: str, column: str, encoder: Callable[[list[str]], list[list[float]]] | None = None, components: int = 32) -> DataFrame:
    """(key, {column}_emb_i): embeddings, of ``encoder`` or given as arrays, reduced by PCA."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if encoder is not None:

        @F.pandas_udf("array<double>")
        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in it:
                yield pd.Series(encoder(s.fillna("").tolist()))

        df = df.withColumn("__e", run(F.col(E.q(column))))
    else:
        df = df.withColumn("__e", F.col(E.q(column)).cast("array<double>"))
    d = df.where(F.col("__e").isNotNull()).select(key, array_to_vector("__e").alias("v"))
    k = min(components, d.first()["v"].size)
    out = PCA(k=k, inputCol="v", outputCol="p").fit(d).transform(d).withColumn("a", vector_to_array("p"))
    return out.select(key, *[F.col("a")[i].alias(f"{column}_emb_{i}") for i in range(k)])


ENTITY_KINDS = ("person", "org", "gpe", "date", "money", "product", "event", "loc")
POS_TAGS = ("noun", "verb", "adj", "adv", "pron", "propn", "num", "det", "adp")


def _summed(model: Callable[[list[str]], list[dict[str, int]]], texts: list[str], piece: int) -> list[dict[str, int]]:
    """The model's counts of whole texts: it gets pieces of at most ``piece`` characters, cut at blanks where there are any, and they are added up."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = len(t) if len(t) - at <= piece else (t.rfind(" ", at, at + piece) + 1) or at + piece
            end = end if end > at else at + piece
            parts.append(t[at:end])
            owner.append(i)
            at = end
            if at >= len(t):
                break
    out: list[dict[str, int]] = [{} for _ in texts]
    for i, got in zip(owner, model(parts)):
        for name, n in got.items():
            out[i][name] = out[i].get(name, 0) + n
    return out


def _counts(df: DataFrame, column: str, model: Callable[[list[str]], list[dict[str, int]]], names: tuple[str, ...], piece: int) -> DataFrame:
    @F.pandas_udf("map<string, bigint>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(_summed(model, s.fillna("").tolist(), piece))

    counted = df.withColumn("__c", run(F.col(E.q(column)).cast("string")))
    return counted.withColumn("__n", F.array(*[F.coalesce(F.try_element_at("__c", F.lit(n)), F.lit(0)) for n in names]))


def named_entities(df: DataFrame, column: str, model: Callable[[list[str]], list[dict[str, int]]] | None, piece: int = 10_000) -> DataFrame:
    """``df`` with the number of entities of each kind and in all, of a model that counts them; unchanged without one."""
    if model is None:
        return df
    d = _counts(df, column, model, ENTITY_KINDS, piece)
    total = F.aggregate("__n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(*[F.col(E.q(c)) for c in df.columns], *[F.col("__n")[k].alias(f"{column}_ner_{n}") for k, n in enumerate(ENTITY_KINDS)], total.alias(f"{column}_ner_total"))


def parts_of_speech(df: DataFrame, column: str, model: Callable[[list[str]], list[dict[str, int]]] | None, piece: int = 10_000) -> DataFrame:
    """``df`` with the share of each tag among the words, nouns over verbs, and the share of content words."""
    if model is None:
        return df
    d = _counts(df, column, model, POS_TAGS, piece)
    n = F.greatest(F.aggregate(F.map_values(F.coalesce("__c", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1))
    at = lambda tag: F.col("__n")[POS_TAGS.index(tag)]
    shares = [(at(t) / n).alias(f"{column}_pos_{t}_ratio") for t in POS_TAGS]
    content = (at("noun") + at("verb") + at("adj") + at("adv")) / n
    return d.select(*[F.col(E.q(c)) for c in df.columns], *shares, (at("noun") / F.greatest(at("verb"), F.lit(1))).alias(f"{column}_pos_noun_verb_ratio"), content.alias(f"{column}_pos_content_ratio"))
