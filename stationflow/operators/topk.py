"""Top-k, first-per-group and ordering helpers.

``row_number() <= k`` over a partitioned window is planned by Spark 3.5+
with a *partial* ``WindowGroupLimit`` before the shuffle, so each map task
forwards at most k rows per group: a hot group never reaches the final
window whole. First-per-group uses an aggregate (``min_by``), combined
map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", F.row_number().over(w).alias(rank_col)).where(F.col(rank_col) <= n)


def first_per(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The first row (by ``order``) of each group, as an aggregate."""
    key = F.struct(*[F.col(c) for c in order])
    val = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(*by).agg(F.min_by(val, key).alias("_f")).select(*by, "_f.*")


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows in a total order (distributed top-k)."""
    return df.orderBy(*order).limit(n)
