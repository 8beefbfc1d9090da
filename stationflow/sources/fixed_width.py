"""Fixed-width report scan and decode.

``spark.read.text`` splits files into lines in parallel (one task per file
split); decoding is ``substring`` / ``try_cast`` / ``when`` inside codegen.
A bad number becomes NULL; a bad date drops the line (T28: per line, never
the whole file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field layout (0-based start, end exclusive, divisor, sentinel).
LAYOUT = {
    "station_id": (4, 15, None, None),
    "date": (15, 23, None, None),
    "time": (23, 27, None, None),
    "wind_direction": (60, 63, 1.0, "999"),
    "wind_speed": (65, 69, 10.0, "9999"),
    "temperature": (87, 92, 10.0, "+9999"),
    "dewpoint": (93, 98, 10.0, "+9999"),
    "sea_level_pressure": (99, 104, 10.0, "99999"),
}
# Minimum stripped line length, and the length that carries pressure.
MIN_LINE = 100
PRESSURE_LINE = 104


def read_fixed_width(spark: SparkSession, paths, min_len: int = MIN_LINE) -> DataFrame:
    """S01 + F01: lines of the given files/globs (newline stripped; T2: the length
    test is on the stripped line) with the source path, short lines dropped."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    v = F.regexp_replace("value", "\r$", "")
    return (lines.select(v.alias("value"), F.col("_metadata.file_path").alias("source_path"))
            .where(F.length("value") >= min_len))


def _field(v: Column, name: str) -> Column:
    start, end, _, _ = LAYOUT[name]
    return F.substring(v, start + 1, end - start)


def _measure(v: Column, name: str, available: Column | None = None) -> Column:
    _, _, div, sentinel = LAYOUT[name]
    raw = F.trim(_field(v, name))
    val = raw.try_cast("double") / F.lit(div)
    out = F.when((raw == "") | (raw == F.lit(sentinel)), F.lit(None).cast("double")).otherwise(val)
    out = F.when(F.isnan(out), F.lit(None).cast("double")).otherwise(out)
    return out if available is None else F.when(available, out)


def decode_fixed_width(lines: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The observation columns of each line; lines with an invalid date
    or time are dropped."""
    v = F.col(col)
    d, t = _field(v, "date"), _field(v, "time")
    year = F.substring(d, 1, 4).try_cast("int")
    month = F.substring(d, 5, 2).try_cast("int")
    day = F.substring(d, 7, 2).try_cast("int")
    hour = F.substring(t, 1, 2).try_cast("int")
    minute = F.substring(t, 3, 2).try_cast("int")
    ts = F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0))
    out = lines.select(
        *keep,
        F.trim(_field(v, "station_id")).alias("station_id"), ts.alias("datetime"),
        year.alias("year"), month.alias("month"), day.alias("day"), hour.alias("hour"), minute.alias("minute"),
        _measure(v, "temperature").alias("temperature"), _measure(v, "dewpoint").alias("dewpoint"),
        _measure(v, "wind_direction").alias("wind_direction"), _measure(v, "wind_speed").alias("wind_speed"),
        _measure(v, "sea_level_pressure", F.length(v) >= PRESSURE_LINE).alias("sea_level_pressure"))
    return out.where(F.col("datetime").isNotNull())


def signed4(x: Column) -> Column:
    """Tenths as a 5-char signed field (+0217 / -0011)."""
    return F.concat(F.when(x < 0, "-").otherwise("+"), F.lpad(F.abs(x).cast("string"), 4, "0"))


def padded(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def encode_fixed_width(df: DataFrame, fields: dict[str, Column], length: Column) -> DataFrame:
    """Inverse of S02 for fixtures and replay. ``fields`` holds text columns of
    the exact field width: station (11), datetime (12, yyyyMMddHHmm),
    wind_direction (3), wind_speed (4), temperature (5), dewpoint (5),
    sea_level_pressure (5); ``length`` cuts the 110-char line."""
    f = fields
    line = F.concat(F.lit("0000"), f["station"], f["datetime"], F.lit(" " * 33),
                    f["wind_direction"], F.lit("  "), f["wind_speed"], F.lit(" " * 18),
                    f["temperature"], F.lit(" "), f["dewpoint"], F.lit(" "), f["sea_level_pressure"],
                    F.lit(" " * 6))
    return df.select("*", F.substring(line, 1, length).alias("value"))
