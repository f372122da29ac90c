"""Aggregates that Spark's own refuse on some data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of the rows where both are present; null where either does not vary, which ``corr`` takes for an error."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, a))) * F.sqrt(F.var_pop(F.when(both, b)))
    return F.nanvl(F.try_divide(F.covar_pop(a, b), spread), F.lit(None).cast("double"))
