"""Equi-joins on keys that may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal ``keys``, NULL being equal to NULL; the keys are there once,
    from the left. No keys: ``right`` is one row, added to every row of the left
    as a scalar subquery."""
    if not keys:
        cols = right.columns
        one = right.select(F.struct(*cols).alias("_one"))
        return left.withColumn("_one", one.scalar()).select(*left.columns, *[F.col("_one")[c].alias(c) for c in cols])
    r = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(r, on, how).drop(*[f"_right_{k}" for k in keys])
