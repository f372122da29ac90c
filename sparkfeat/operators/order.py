"""Order statistics over range partitions: global ranks without a window that gathers all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import q
from ..sources.shared import stored

_PLACE = (1 << 33) - 1  # how monotonically_increasing_id packs a row's place in its partition


def ordered(df: DataFrame, order: list, name: str = "__rank", group: list[str] | None = None) -> DataFrame:
    """``df`` with each row's rank, from 1, in the order of ``order``: of all rows, or within each ``group``.

    Rows are range-partitioned and sorted once, into a stored table that fixes their places; what the
    partitions before a row's hold is added, a number per partition and group that lies in it.
    """
    group = list(group or [])
    at = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__id", F.monotonically_increasing_id()))
    at = at.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit(_PLACE))}).drop("__id")
    held = at.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    held = held.select(F.col("__part").alias("__p"), "__first", "__before", *[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)])
    on = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    # without groups there is one row a partition, whatever the data
    out = at.join(held if group else F.broadcast(held), on)
    return out.select(*[F.col(q(c)) for c in df.columns], (F.col("__at") - F.col("__first") + 1 + F.col("__before")).alias(name))


def sums_before(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows before each row in the order of ``order``."""
    at = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    held = at.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    held = held.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("__own", own).join(F.broadcast(held), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))
