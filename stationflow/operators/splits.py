"""Chronological split, complete cases, deterministic sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default split bounds (midnight timestamps, T5).
TRAIN_END = "2021-12-31 00:00:00"
VAL_END = "2023-12-31 00:00:00"


def split_column(time: str, train_end: str, val_end: str, inclusive_day: bool = False):
    """F03 expression: 'train' ≤ train_end < 'val' ≤ val_end < 'test'.

    Bounds compare as midnight timestamps (the reference behaviour);
    ``inclusive_day=True`` moves the whole last day into the earlier split.
    """
    t = F.col(time)
    b1 = F.to_timestamp_ntz(F.lit(train_end))
    b2 = F.to_timestamp_ntz(F.lit(val_end))
    if inclusive_day:
        return (F.when(F.to_date(t) <= F.to_date(b1), "train")
                .when(F.to_date(t) <= F.to_date(b2), "val").otherwise("test"))
    return F.when(t <= b1, "train").when(t <= b2, "val").otherwise("test")


def split_predicate(time: str, split: str, train_end: str = TRAIN_END, val_end: str = VAL_END) -> Column:
    """F03 as a plain range predicate for one split, so that selecting a split
    pushes ``time <= bound`` / ``time > bound`` down to the Parquet scan."""
    t = F.col(time)
    b1, b2 = F.to_timestamp_ntz(F.lit(train_end)), F.to_timestamp_ntz(F.lit(val_end))
    if split == "train":
        return t <= b1
    if split == "val":
        return (t > b1) & (t <= b2)
    if split == "test":
        return t > b2
    raise ValueError(split)


def chrono_split(df: DataFrame, time: str = "datetime", train_end: str = TRAIN_END,
                 val_end: str = VAL_END, inclusive_day: bool = False) -> DataFrame:
    """one table with a ``split`` column (write with ``partitionBy('split')``)."""
    return df.select("*", split_column(time, train_end, val_end, inclusive_day).alias("split"))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """rows with no NULL in ``cols``."""
    return df.dropna(subset=cols)


def key_hash(key: list[str], seed: int = 42) -> Column:
    """MD5 of the seed and the key columns as text; any engine can compute it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))


def sample_det(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Reproducible bottom-k sample, the ``n`` rows with the smallest hashes
    of (seed, key), the same for any partitioning. ``orderBy(...).limit(n)`` plans
    as a distributed top-k (TakeOrderedAndProject): each task keeps a heap of n
    rows, and heaps are merged; nothing is sorted globally."""
    return df.withColumn("_h", key_hash(key, seed)).orderBy("_h", *key).limit(n).drop("_h")


def sample_per(df: DataFrame, by: list[str], key: list[str], n: int, seed: int = 42) -> DataFrame:
    """O08 per group: the ``n`` rows of each group with the smallest hashes. The
    row-number limit is planned with a partial limit before the shuffle, so a hot
    group sends at most n rows from each task."""
    w = Window.partitionBy(*by).orderBy(key_hash(key, seed), *key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
