"""Registry of named queries: a Spark builder and, where SQL can express it,
the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Digits kept for every floating result in both engines (the two engines sum
# and interpolate in different orders; the last bits differ).
DIGITS = 6


# Both engines round after adding the same tiny shift: a mean such as
# 23.5609375 is an exact decimal tie, and a one-ulp difference between the
# engines' sums would otherwise round it to different sides.
SHIFT = 1e-9


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.replace("ROUND(", f"ROUND({SHIFT} + ")
        return fn
    return deco


def rnd(c, digits: int = DIGITS) -> Column:
    return F.round(F.lit(SHIFT) + (F.col(c) if isinstance(c, str) else c), digits)


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Rounds every double/float column (output formatting for the oracle)."""
    return df.select(*[rnd(c, digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])
