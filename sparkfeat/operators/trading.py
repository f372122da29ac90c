"""Rolling indicators of a price series: moving averages, volatility and the next row's movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import num


def indicators(df: DataFrame, value: str, order: list[str], entity: list[str], windows: tuple[int, ...] = (5, 10, 20), spans: tuple[int, ...] = (12, 26), depth: int = 200) -> DataFrame:
    """``df`` with SMA, rolling volatility and EMA columns and the next row's label, per entity in the order given.

    SMA and the sample deviation of relative changes are over the last ``w`` rows, null before there are so many.
    The change from a value of zero is no number, and so is the deviation of rows that hold it.
    EMA has weights (1 - a)**k over the rows before, a = 2 / (span + 1), normalised; those beyond ``depth`` rows, under
    1e-6 of the whole for spans to 26, are left out.  ``{value}_up_next`` is 1 where the next value is greater, null at the end.
    """
    w = Window.partitionBy(*entity).orderBy(*order)
    x, at = F.expr(num(value)), F.row_number().over(w)
    last = lambda n: w.rowsBetween(1 - n, 0)
    before = F.lag(x).over(w)
    d = df.withColumn("__change", F.when(before == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(x / before - 1))
    made = {}
    for n in windows:
        made[f"{value}_sma_{n}"] = F.when(at >= n, F.avg(x).over(last(n)))
        made[f"{value}_vol_{n}"] = F.when(at > n, F.stddev_samp("__change").over(last(n)))
    for s in spans:
        keep = 1 - 2 / (s + 1)
        held = F.reverse(F.collect_list(x).over(last(depth)))
        power = F.transform(held, lambda v, i: F.pow(F.lit(keep), i))
        total = F.aggregate(F.zip_with(held, power, lambda v, p: v * p), F.lit(0.0), lambda a, v: a + v)
        made[f"{value}_ema_{s}"] = total / F.aggregate(power, F.lit(0.0), lambda a, v: a + v)
    made[f"{value}_up_next"] = (F.lead(x).over(w) > x).cast("int")
    return d.withColumns(made).drop("__change")
