"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors go to the shards of their nearest cluster centres, each to ``overlap`` of them.  A shard
builds its part of the graph: of each vector's nearest neighbours robust pruning keeps those that
no kept neighbour covers (Subramanya et al., 2019), links are made mutual, and the parts' adjacency
lists are united.  Every vector is then a query: a greedy search walks from its shard's medoid over the united lists,
all of the beam a step; once within the radius it expands everything in range it meets (range search of Manohar
et al., 2024), and what it found is carried on across shards along the united lists until nothing
new is in range.  All pairs are verified by their cosine in double precision.

A pair counts in the first shard that both vectors are in, so a shard gives each vector's number of links and its group,
and no pairs are written but those of vectors that share no shard.

Recall is audited against brute force for queries in hash order, drawn until enough of them have a
partner.  While it is under ``least_recall`` the shards overlap more, as long as that costs less than
comparing all nodes in blocks; then they are compared.  An audit that had to draw every node is such
a comparison, and its counts are the result.

Equal vectors are one node of all this; the copies rejoin at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import components, discard, shared_folder, stored, table, tidy
from .ngram_join import joined

COSINE, SHARD, OVERLAP, DEGREE, ALPHA, BEAM, AUDIT, LEAST_RECALL = 0.9, 1000, 2, 24, 1.2, 24, 64, 0.95
SAMPLE, MAX_CENTRES = 20_000, 16_384
#: Floats of a block of audit queries, and the comparisons that cost as much as a place in a shard.
BLOCK, PLACE = 1 << 20, 256
LINKS = "node long, links long, root long"


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def nodes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): distinct usable vectors (node, v, w) with their number of ids; and (vec_id, node).

    Vectors are usable if they are of the commonest dimension, finite and not zero.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v")).where("vec_id is not null and v is not null")
    e = e.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    sizes = e.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    e = stored(e.where(F.size("v") == (sizes["k"] if sizes else 0)).distinct())
    n = stored(e.groupBy("v").agg(F.count("*").alias("w")).select(F.monotonically_increasing_id().alias("node"), "v", "w"))
    return n, e.join(n, "v").select("vec_id", "node")


def centres(n: DataFrame, count: int, shard: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Cluster centres by k-means on a bounded sample of nodes; they only decide which shards build together."""
    k = max(1, min(MAX_CENTRES, -(-count // shard)))
    rows = n.orderBy(F.xxhash64("v"), "v").limit(max(SAMPLE, 2 * k)).select("v").toArrow()
    x = unit(matrix(rows.column("v")))
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, unit(total), c).astype(np.float32)
    return c


def _assign(sent, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        m = min(overlap, len(c))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                sim = unit(matrix(s.column(1))) @ c.T
                near = np.argpartition(-sim, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (s.num_rows, 1))
                near = np.sort(near, axis=1).astype(np.int32)
                at = pa.array(np.repeat(np.arange(s.num_rows), m))
                homes = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, m, dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *(s.column(k).take(at) for k in range(3)), homes.take(at)], names=["shard", "node", "v", "w", "homes"])

    return run


def robust_prune(near: np.ndarray, sim: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row of candidates by falling similarity, those that no kept one is ``alpha`` times nearer to than the row's node is."""
    dist = np.sqrt(np.maximum(2 - 2 * sim, 0))
    v = x[near]
    between = alpha * np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
    alive = np.ones(near.shape, dtype=bool)
    kept = np.zeros(near.shape, dtype=bool)
    for k in range(near.shape[1]):
        take = alive[:, k] & (kept.sum(axis=1) < degree)
        kept[:, k] = take
        alive &= ~take[:, None] | (between[:, k] > dist)
    return kept


def build(x: np.ndarray, degree: int, alpha: float, pool: int = 64) -> list[set[int]]:
    """A shard's part of the graph: pruned nearest neighbours, made mutual; chained to the medoid's order so that it is connected."""
    m = len(x)
    links: list[set[int]] = [set() for _ in range(m)]
    if m < 2:
        return links
    pool = min(pool, m - 1)
    for lo in range(0, m, 1024):
        sim = x[lo : lo + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = -2
        near = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        for at in range(0, len(sim), 128):
            mine = near[at : at + 128]
            kept = robust_prune(mine, np.take_along_axis(sim[at : at + 128], mine, 1), x, degree, alpha)
            for i, j in zip((np.nonzero(kept)[0] + lo + at).tolist(), mine[kept].tolist()):
                links[i].add(j)
                links[j].add(i)
    seen = np.zeros(m, dtype=bool)
    last = medoid = int((x @ x.sum(axis=0)).argmax())
    todo = [medoid]
    while True:
        while todo:
            i = todo.pop()
            if not seen[i]:
                seen[i] = True
                todo += [j for j in links[i] if not seen[j]]
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return links
        j = int(rest[(x[rest] @ x[last]).argmax()])
        links[last].add(j)
        links[j].add(last)
        last = j
        todo = [j]


def _graph(degree: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in ts.grouped(batches, "shard"):
            ids, x = g.column("node").combine_chunks().to_numpy(), unit(matrix(g.column("v")))
            links = [ids[sorted(s)] for s in build(x, degree, alpha)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links, pa.list_(pa.int64()))], names=["node", "links"])

    return run


def search(x: np.ndarray, links: list[np.ndarray], radius: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, found) of a shard, all its members as queries in step: from the medoid all of the beam at once, then all in range.

    A block's similarities come from one matrix product, which is cheaper than picking pairs; the walk uncovers those it meets.
    """
    m = len(x)
    degree = np.array([len(s) for s in links])
    if not degree.any():
        return
    start, flat = np.cumsum(degree) - degree, np.concatenate(links)
    medoid = int((x @ x.sum(axis=0)).argmax())
    for lo in range(0, m, 512):
        q = np.arange(lo, min(m, lo + 512))
        every = x[q] @ x.T
        sim = np.full((len(q), m), -2, dtype=np.float32)  # what a query has met so far
        sim[:, medoid] = every[:, medoid]
        opened = np.zeros((len(q), m), dtype=bool)
        while True:
            cut = np.partition(sim, m - min(beam, m), axis=1)[:, m - min(beam, m)]
            r, c = np.nonzero(~opened & (sim > -1.5) & (sim >= np.minimum(cut, radius)[:, None]))
            if not len(r):
                break
            opened[r, c] = True
            for k in range(0, len(r), 1 << 15):
                own, n = c[k : k + (1 << 15)], degree[c[k : k + (1 << 15)]]
                a, b = np.repeat(r[k : k + (1 << 15)], n), flat[ts.ranges(start[own], n)]
                sim[a, b] = every[a, b]
        r, c = np.nonzero(sim >= radius - 1e-4)
        yield q[r], c


def _search(radius: float, beam: int):
    """Per shard: each node's links that count here, its group, and the nodes outside that it may be near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in ts.grouped(batches, "shard"):
            shard = g.column("shard")[0].as_py()
            ids, raw = g.column("node").combine_chunks().to_numpy(), matrix(g.column("v"))
            by = np.argsort(ids)
            ids, raw, weight = ids[by], raw[by], g.column("w").to_numpy()[by]
            x, exact = unit(raw), unit(raw.astype(np.float64))
            homes = g.column("homes").combine_chunks()
            homes = homes.flatten().to_numpy().reshape(len(ids), -1)[by]
            lists = g.column("links").combine_chunks().take(pa.array(by))
            flat, offs = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            here = ids[at] == flat
            links = [at[a:b][here[a:b]] for a, b in zip(offs[:-1], offs[1:])]
            away = [flat[a:b][~here[a:b]] for a, b in zip(offs[:-1], offs[1:])]
            far = np.array([len(s) for s in away])
            total, out, ends = np.zeros(len(ids), np.int64), [[] for _ in ids], []
            for q, f in search(x, links, radius, beam):
                ok = (np.einsum("ij,ij->i", exact[q], exact[f]) >= radius) & (q != f)
                q, f = q[ok], f[ok]
                first, known = np.zeros(len(q), bool), np.zeros(len(q), bool)
                for k in range(homes.shape[1]):  # homes ascend: the first that both have is where they count
                    both = (homes[q, k][:, None] == homes[f]).any(axis=1) & ~known
                    first |= both & (homes[q, k] == shard)
                    known |= both
                total += np.bincount(q[first], weights=weight[f[first]], minlength=len(ids)).astype(np.int64)
                if len(q):  # a query's group is told by the first it found; queries come in order
                    new = np.diff(q, prepend=-1) > 0
                    head = f[np.flatnonzero(new)][np.cumsum(new) - 1]
                    ends.append(np.unique(np.concatenate([q, f]) * len(ids) + np.tile(head, 2)))
                near = np.flatnonzero(far[f] > 0)
                for i, j in zip(q[near].tolist(), f[near].tolist()):
                    out[i].append(away[j])
            code = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            root = joined(len(ids), code // len(ids), code % len(ids))
            out = [np.unique(np.concatenate([*o, away[i]])) if o or len(away[i]) else away[i] for i, o in enumerate(out)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(ids[root]), pa.array(out, pa.list_(pa.int64()))], names=["node", "links", "root", "outside"])

    return run


def cosine(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return dot / (norm(a) * norm(b))


def crossing(candidates: DataFrame, at: DataFrame, radius: float) -> DataFrame:
    """(a, b) of the candidates that share no shard and are within the radius; ``at`` has (node, v, homes)."""
    side = lambda k: at.select(F.col("node").alias(k), F.col("v").alias(f"v{k}"), F.col("homes").alias(f"h{k}"))
    c = candidates.join(side("a"), "a").join(side("b"), "b")
    return c.where(~F.arrays_overlap("ha", "hb")).where(cosine(F.col("va"), F.col("vb")) >= radius).select("a", "b")


def near_links(n: DataFrame, count: int, radius: float, shard: int, overlap: int, degree: int, alpha: float, beam: int) -> DataFrame:
    """(node, links, root): parts of each node's number of links within the radius, and of its group, by one build and search of the graph."""
    sent = n.sparkSession.sparkContext.broadcast(centres(n, count, shard))
    shards = stored(n.mapInArrow(tidy(_assign(sent, overlap)), "shard int, node long, v array<float>, w long, homes array<int>"))
    at = shards.where("shard = homes[0]").select("node", "v", "w", "homes")
    by_shard = lambda df: df.repartition("shard").sortWithinPartitions("shard", "node")
    graph = by_shard(shards.select("shard", "node", "v")).mapInArrow(tidy(_graph(degree, alpha)), "node long, links array<long>")
    graph = stored(graph.select("node", F.explode("links").alias("link")).groupBy("node").agg(F.collect_set("link").alias("links")))
    with_links = shards.join(graph, "node", "left").select("shard", "node", "v", "w", "homes", F.coalesce("links", F.array().cast("array<long>")).alias("links"))
    inside = stored(by_shard(with_links).mapInArrow(tidy(_search(radius, beam)), "node long, links long, root long, outside array<long>"))
    out, found = inside.select("node", "links", "root"), None
    step = inside.select(F.col("node").alias("q"), F.explode("outside").alias("c"))
    while True:  # across shards: neighbours of what was found, until nothing new is in range
        step = step.select(F.least("q", "c").alias("a"), F.greatest("q", "c").alias("b")).distinct()
        new = stored(crossing(step if found is None else step.join(found, ["a", "b"], "left_anti"), at, radius))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        ends = new.select(F.col("a").alias("q"), F.col("b").alias("h")).union(new.select("b", "a"))
        step = ends.join(graph, F.col("h") == F.col("node")).select("q", F.explode("links").alias("c")).where("q <> c")
    if found is not None:
        both = found.union(found.select("b", "a")).join(at.select(F.col("node").alias("b"), "w"), "b")
        out = out.unionByName(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("links"), F.min("b").alias("root")))
        out = out.unionByName(found.select(F.col("a").alias("node"), F.lit(0).cast("long").alias("links"), F.col("b").alias("root")))
    return out


def _compare(sent, radius: float):
    """(node, links, root): what a block of queries has in range among these nodes, and the groups that makes; the cosine in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        near, exact = unit(x), unit(x.astype(np.float64))
        total, links = np.zeros(len(ids), np.int64), []
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                node, v, w = s.column(0).to_numpy(), matrix(s.column(1)), s.column(2).to_numpy()
                r, c = np.nonzero(unit(v) @ near.T >= radius - 1e-4)
                cos = np.einsum("ij,ij->i", unit(v.astype(np.float64))[r], exact[c])
                ok = (cos >= radius) & (node[r] != ids[c])
                r, c = r[ok], c[ok]
                total += np.bincount(c, weights=w[r], minlength=len(ids)).astype(np.int64)
                if len(r):  # nodes and queries of one group, each once
                    root = joined(len(node) + len(ids), r, c + len(node))
                    mine = np.unique(np.concatenate([r, c + len(node)]))
                    name = np.concatenate([node, ids])
                    links.append(pa.RecordBatch.from_arrays([pa.array(name[mine]), pa.array(np.zeros(len(mine), np.int64)), pa.array(name[root[mine]])], names=["node", "links", "root"]))
        yield from links
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(total[at]), pa.array(ids[at])], names=["node", "links", "root"])

    return run


def true_links(n: DataFrame, radius: float, queries: int | None) -> tuple[DataFrame, DataFrame, bool]:
    """(true parts as of ``near_links``, the nodes drawn, whether every node was drawn).

    Nodes are drawn in hash order, in growing blocks, until ``queries`` of them have a partner; all if it is None.
    """
    spark = n.sparkSession
    by = n.withColumn("h", F.xxhash64("v", F.lit(11)))
    parts, last, partnered, size, dim = [], None, 0, queries, 1
    while queries is None or partnered < queries:
        rest = by if last is None else by.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("node") > last[1])))
        most = max(64, BLOCK // dim)
        limit = most if size is None else min(size, most)
        q = rest.orderBy("h", "node").limit(limit).select("h", "node", "v").toArrow()
        if not q.num_rows:
            break
        x = matrix(q.column("v"))
        last, dim = (q.column("h")[-1].as_py(), q.column("node")[-1].as_py()), x.shape[1]
        sent = spark.sparkContext.broadcast((q.column("node").to_numpy(), x))
        found = stored(n.select("node", "v", "w").mapInArrow(tidy(_compare(sent, radius)), LINKS))
        sent.unpersist()
        partnered += found.where("links > 0").select("node").distinct().count()
        parts.append(found)
        size = size and 4 * size
        if q.num_rows < limit:
            last = None
            break
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    if last is None:
        return out, n.select("node"), True
    drawn = by.where((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("node") <= last[1]))).select("node")
    return out, drawn, not bool(by.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("node") > last[1]))).limit(1).count())


def recall(true: DataFrame, drawn: DataFrame, found: DataFrame) -> float:
    """Share of the drawn nodes' true links, of which there is at least one, that were found."""
    t = true.where("links > 0").join(drawn, "node", "left_semi").agg(F.sum("links")).first()[0]
    return (found.where("links > 0").join(drawn, "node", "left_semi").agg(F.sum("links")).first()[0] or 0) / t


def near_duplicates(embeddings: DataFrame, radius: float = COSINE, shard: int = SHARD, overlap: int = OVERLAP, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BEAM, queries: int = AUDIT, least_recall: float = LEAST_RECALL) -> DataFrame:
    """(vec_id, class_id, links): one row for each vector with its class and the number of others within the radius, copies included.

    Links in a row make a class, named by its least vec_id.  Null vectors, vectors of another dimension, zero vectors and
    those with null, NaN or infinite entries have no links and are classes of their own; null ids are left out;
    repeated rows count once; an id with several vectors has a row for each usable one; other columns are not read.
    """
    shared_folder(embeddings.sparkSession)
    n, members = nodes(embeddings)
    count = n.count()
    own = lambda df: df.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    if not count:
        return own(every)
    found, drawn, whole = true_links(n, radius, queries)
    if not whole:
        true = found
        while recall(true, drawn, found := stored(near_links(n, count, radius, shard, overlap, degree, alpha, beam))) < least_recall:
            discard(found)
            overlap *= 2
            if overlap * shard * PLACE >= count:
                found, _, _ = true_links(n, radius, None)
                break
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    least = members.groupBy("node").agg(F.min("vec_id").alias("least"))
    vertex = n.select("node", "w").join(least, "node").join(links, "node", "left").join(groups, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    vertex = vertex.join(vertex.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "class_id", "links")
    usable = members.join(vertex, "node").select("vec_id", "class_id", "links")
    return usable.unionByName(own(every.join(members, "vec_id", "left_anti")))


def op4_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_graph_dedup": op4_graph_dedup}
SQL: dict[str, str] = {}
