"""Scans of the driver tables and the stand-in observation views built on them.

The observation schema of the engine is
``station_id, datetime, event_id, temperature, dewpoint, climate_zone``.
On the driver tables it is derived from ``events``: one event is one report,
``user_id`` is the station, ``value`` (shifted by 25 so the fixed degree
bands of the rule catalogue are reachable) is the temperature, the integer
``k`` inside ``props`` is the dew point and ``event_type`` the climate zone.
Only the columns named here are read (Parquet column pruning).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: offset that maps the event value onto a degree-like scale.
TEMPERATURE_OFFSET = 25.0

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table."""
    return spark.read.parquet(table_path(sf_dir, name))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in observation table from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("station_id"),
        F.col("ts").alias("datetime"),
        F.col("event_id"),
        (F.col("value") - F.lit(TEMPERATURE_OFFSET)).alias("temperature"),
        F.get_json_object("props", "$.k").try_cast("double").alias("dewpoint"),
        F.col("event_type").alias("climate_zone"),
    )


# The same view for the DuckDB oracle; every oracle query starts from it.
OBS_SQL = f"""obs AS (
  SELECT user_id AS station_id, ts AS datetime, event_id,
         value - {TEMPERATURE_OFFSET} AS temperature,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS dewpoint,
         event_type AS climate_zone
  FROM events)"""
