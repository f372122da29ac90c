"""Chat formatting of reply trees.

Messages name their parents.  Iterative self-joins double how far up a message's pointer reaches: a
pointer of 2**k steps joined with itself reaches 2**(k+1), so the rounds grow with the logarithm of the
deepest tree's depth.  Another join a pointer then enumerates every path from its leaf up to the root:
what is known of the last 2**k messages, moved by the pointer, gives the 2**k before them.
Each path that ends in a leaf is a branch; branches of a tree are ranked by their messages' mean
score, and each chosen branch becomes one conversation.

Nothing gathers a tree in one task: ranks within a tree or turn come from a range partitioning, and
each level's rows are a table of their own, read at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, shared_folder, stored, table

ROLE, TEXT, END = "<|im_start|>", "\n", "<|im_end|>\n"


def ranked(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``df`` with the rank (from 1) of each row within its group; a group of any size is spread over the tasks.

    Rows are range-partitioned by group and order; a partition ranks what it holds of a group, and the
    counts of the partitions before it, of which there are as many as partitions at most, are added.
    """
    at = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    held = at.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    held = held.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = at.join(held.drop("__n"), ["__part", *group])
    return out.withColumn(name, (F.col("__at") - F.col("__first") + 1 + F.col("__before")).cast("int")).drop("__at", "__part", "__first", "__before")


def messages(conversations: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score) of a table of turns.

    A turn's messages answer the first message of the last turn before it, by role and text, so
    several messages of one turn are branches.  Rows with null conv_id or turn are in no tree;
    repeated rows count once; null role and text become empty.  A message scores the logarithm of
    one more than its number of characters.
    """
    shared_folder(conversations.sparkSession)
    m = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("tree"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    depth = ranked(m.select("tree", "turn").distinct(), ["tree"], ["turn"], "depth")
    m = ranked(m, ["tree", "turn"], ["role", "text"], "rank").join(depth, ["tree", "turn"])
    node = lambda depth, rank: F.concat_ws("/", depth.cast("string"), rank.cast("string"))
    return m.select("tree", node(F.col("depth"), F.col("rank")).alias("node"), F.when(F.col("depth") > 1, node(F.col("depth") - 1, F.lit(1))).alias("parent"), "role", "text", F.log1p(F.length("text").cast("double")).alias("score"))


def _pointers(m: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(pointers, circling): (tree, node, up) by 1, 2, 4, ... steps up, and those that never come to an end.

    Depths have no gaps, so when doubling loses no pointer, none but those of circles are left.
    """
    up = m.where("parent is not null and parent <> node").select("tree", "node", F.col("parent").alias("up"))
    up = stored(up.join(m.select("tree", F.col("node").alias("up")), ["tree", "up"], "left_semi").select("tree", "node", "up"))
    found, live = [], up.count()
    while live:
        found.append(up)
        to = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"))
        up = stored(up.join(to, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("next").alias("up")))
        before, live = live, up.count()
        if live == before:
            break
    return found, up


def branches(m: DataFrame) -> DataFrame:
    """(tree, leaf, depth, total, path): every root-to-leaf path of messages (tree, node, parent, role, text, score).

    A root has null parent.  Messages whose parent is missing, or that only answer each other in a
    circle, hang on no root and are in no path.  Null nodes and trees are dropped; of rows with the
    same tree and node the first by parent, role and text counts; null scores are 0.  Only names
    travel through the joins; texts and scores join once, at the end.
    """
    shared_folder(m.sparkSession)
    m = m.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("tree is not null and node is not null")
    # the least struct of a node's rows is found by partial aggregation; null parents sort first
    rest = F.struct(F.col("parent"), F.col("role"), F.col("text"), F.col("score"))
    m = stored(m.groupBy("tree", "node").agg(F.min(rest).alias("x")).select("tree", "node", "x.*"))
    pointers, circling = _pointers(m)
    inner = m.where("parent is not null and parent <> node").select("tree", F.col("parent").alias("node")).distinct()
    leaves = m.select("tree", "node").join(inner, ["tree", "node"], "left_anti").join(circling, ["tree", "node"], "left_anti")
    levels = [stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("at")))]
    paths = levels[0]
    for k, up in enumerate(pointers):
        more = stored(paths.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("at") + (1 << k)).alias("at")))
        levels.append(more)
        paths = paths.unionByName(more)
    for x in [*pointers, circling]:
        discard(x)
    told = paths.join(m, ["tree", "node"]).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("at"), "role", "text", "score"))).alias("path"), F.max(F.col("parent").isNull()).alias("rooted"))
    total = F.aggregate("path", F.lit(0.0), lambda s, x: s + x["score"])
    return told.where("rooted").select("tree", "leaf", F.size("path").alias("depth"), total.alias("total"), "path")


def conversations_of(m: DataFrame, keep: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, score, n_messages, text): each tree's branches, best first, formatted.

    ``score`` is the mean score of the path's messages, rounded to 9 digits so that ties are ties;
    equal scores rank the shorter path first, then the leaf's name.  ``keep`` chooses the best few
    branches of each tree; all by default.
    """
    text = F.concat_ws("", F.transform("path", lambda x: F.concat(F.lit(ROLE), F.coalesce(x["role"], F.lit("")), F.lit(TEXT), F.coalesce(x["text"], F.lit("")), F.lit(END))))
    b = stored(branches(m).select("tree", "leaf", F.round(F.col("total") / F.col("depth"), 9).alias("score"), "depth", text.alias("text")))
    rank = ranked(b.select("tree", "leaf", "score", "depth"), ["tree"], [F.desc("score"), F.col("depth"), F.col("leaf")], "rank")
    if keep is not None:
        rank = rank.where(F.col("rank") <= keep)
    b = rank.select("tree", "leaf", "rank").join(b, ["tree", "leaf"])
    return b.select(F.col("tree").alias("conv_id"), "leaf", F.col("rank").cast("long").alias("rank"), "score", F.col("depth").cast("long").alias("n_messages"), "text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_of(messages(table(spark, sf_dir, "conversations")))


QUERIES = {"op10_reply_tree_chat": op10_chat}
SQL = {
    "op10_reply_tree_chat": """
WITH RECURSIVE d AS (SELECT DISTINCT conv_id AS tree, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                     FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY tree ORDER BY turn) AS depth,
             row_number() OVER (PARTITION BY tree, turn ORDER BY role, text) AS k FROM d),
m AS (SELECT tree, depth || '/' || k AS node, CASE WHEN depth > 1 THEN (depth - 1) || '/1' END AS parent,
             role, text, ln(1 + length(text)::DOUBLE) AS score FROM r),
p AS (SELECT tree, node AS leaf, 1::BIGINT AS depth, score AS total,
             '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS body FROM m WHERE parent IS NULL
      UNION ALL
      SELECT m.tree, m.node, p.depth + 1, p.total + m.score,
             p.body || '<|im_start|>' || m.role || chr(10) || m.text || '<|im_end|>' || chr(10)
      FROM p JOIN m ON m.tree = p.tree AND m.parent = p.leaf),
b AS (SELECT *, round(total / depth, 9) AS score FROM p
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tree = p.tree AND m.parent = p.leaf))
SELECT tree AS conv_id, leaf, row_number() OVER (PARTITION BY tree ORDER BY score DESC, depth, leaf) AS rank,
       score, depth AS n_messages, body AS text FROM b"""
}
