"""Sinks (S06, S07, S10, S12, S13): every writer is a distributed DataFrame
write; nothing is gathered on the driver first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Snappy Parquet, optionally partitioned (e.g. split, station_id).
    Rows are clustered by the partition columns with a rebalance: AQE splits a
    partition value that holds much of the data over many tasks of the advisory
    size, so a coarse key never makes one writing task."""
    w = df
    if partition_by:
        w = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = w.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header (metric / importance / history tables)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def to_json_map(df: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """S10 map shape: one JSON object keyed by ``key`` (e.g. the threshold
    table keyed by station). The table is aggregated into one document, so use
    it for per-station artefacts only, whose size is bounded by the station count."""
    entries = F.collect_list(F.struct(F.col(key).cast("string").alias("k"),
                                      F.struct(*value_cols).alias("v")))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def split_summary(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Rows per split plus the feature catalogue (count and names)."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows")).select(
        "*", F.lit(len(features)).alias("n_features"),
        F.lit(",".join(features)).alias("features"))


def save_params(params: DataFrame, path: str) -> None:
    """Persist a fitted parameter row (imputation / scaling statistics)."""
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Restore a parameter row."""
    return spark.read.parquet(path)
