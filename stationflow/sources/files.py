"""File discovery, dimension tables and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Station dimension (code, name, city, state, timezone, climate zone).
STATIONS = [
    ("722020-12839", "JFK", "New York", "NY", "America/New_York", "Humid Continental"),
    ("722590-03927", "ORD", "Chicago", "IL", "America/Chicago", "Continental"),
    ("722780-23183", "MIA", "Miami", "FL", "America/New_York", "Tropical"),
    ("722950-23174", "PHX", "Phoenix", "AZ", "America/Phoenix", "Desert"),
    ("725300-94846", "DFW", "Dallas", "TX", "America/Chicago", "Humid Subtropical"),
    ("725650-03017", "DEN", "Denver", "CO", "America/Denver", "Semi-arid"),
    ("727930-24233", "LAX", "Los Angeles", "CA", "America/Los_Angeles", "Mediterranean"),
    ("744860-94789", "SEA", "Seattle", "WA", "America/Los_Angeles", "Oceanic"),
]
# Configured year range.
START_YEAR, END_YEAR = 2015, 2024

STATION_SCHEMA = ("station_code string, station_name string, city string, state string, "
                  "timezone string, climate_zone string")


def station_dim(spark: SparkSession, rows=STATIONS) -> DataFrame:
    """The station dimension as a DataFrame."""
    return spark.createDataFrame(rows, STATION_SCHEMA)


def with_station_dim(df: DataFrame, dim: DataFrame, key: str = "station_id",
                     dim_key: str = "station_code") -> DataFrame:
    """Left join on the dash-stripped code (record ids carry no dash, T6).
    The dimension is small but not fixed in general: AQE broadcasts it when
    its measured size is under the broadcast threshold."""
    d = dim.withColumn("_k", F.regexp_replace(F.col(dim_key), "-", ""))
    return df.join(d, F.col(key).cast("string") == F.col("_k"), "left").drop("_k")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive file listing (path only; file contents are never read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.col("path")))


def resolve_files(files: DataFrame, stations: DataFrame, start_year: int = START_YEAR,
                  end_year: int = END_YEAR, station_col: str = "station_code") -> DataFrame:
    """One file per (station, year) by layout priority:
    0 ``{year}/{st}-{year}/{st}-{year}``, 1 ``{year}/{st}-{year}``,
    2 ``{year}/{st}/{st}-{year}``, 3 any file under ``{year}/`` whose name
    contains the station then the year. All are equi-joins: layouts 0–2 on
    parsed paths, the name search (3), which only runs for pairs still
    unresolved, on an index of the parts of every name."""
    p = F.col("path")
    pats = {0: r"/(\d{4})/([^/]+)-(\d{4})/([^/]+)-(\d{4})$",
            1: r"/(\d{4})/([^/]+)-(\d{4})$",
            2: r"/(\d{4})/([^/]+)/([^/]+)-(\d{4})$"}
    parsed = []
    for prio, rx in pats.items():
        yr = F.regexp_extract(p, rx, 1)
        if prio == 0:
            st, ok = F.regexp_extract(p, rx, 2), (F.regexp_extract(p, rx, 2) == F.regexp_extract(p, rx, 4)) & \
                (F.regexp_extract(p, rx, 3) == yr) & (F.regexp_extract(p, rx, 5) == yr)
        elif prio == 1:
            st, ok = F.regexp_extract(p, rx, 2), F.regexp_extract(p, rx, 3) == yr
        else:
            st, ok = F.regexp_extract(p, rx, 2), (F.regexp_extract(p, rx, 3) == F.regexp_extract(p, rx, 2)) & \
                (F.regexp_extract(p, rx, 4) == yr)
        parsed.append(files.where(p.rlike(rx) & ok).select(
            "path", st.alias("station"), yr.cast("int").alias("year"), F.lit(prio).alias("priority")))
    known = parsed[0].unionByName(parsed[1]).unionByName(parsed[2])
    grid = missing_grid(stations, start_year, end_year, None, station_col).select(
        F.col(station_col).alias("station"), "year")
    direct = grid.join(known, ["station", "year"])
    unresolved = grid.join(direct.select("station", "year"), ["station", "year"], "left_anti")
    # index of names: every part of a name as long as some station code, by year
    name = files.select("path", F.regexp_extract(p, r"/(\d{4})/", 1).cast("int").alias("year"), F.regexp_extract(p, r"([^/]+)$", 1).alias("_name"))
    sizes = stations.agg(F.collect_set(F.length(station_col)).alias("sizes")).scalar()
    name = name.withColumn("_sizes", sizes).where(F.length("_name") > 0)
    token = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_name")), lambda i: F.transform("_sizes", lambda n: F.struct(
        F.substring("_name", i, n).alias("station"), i.alias("at")))))
    index = name.select("path", "year", "_name", F.explode(token).alias("t")).select("path", "year", "_name", "t.*")
    search = (unresolved.join(index, ["station", "year"]).where(F.expr("locate(cast(year AS string), substr(_name, at + length(station))) > 0"))
              .select("path", "station", "year", F.lit(3).alias("priority")))
    allc = direct.unionByName(search)
    best = allc.groupBy("station", "year").agg(F.min_by("path", F.struct("priority", "path")).alias("path"),
                                               F.min("priority").alias("priority"))
    return best


def read_station_files(spark: SparkSession, root: str, stations: DataFrame, start_year: int = START_YEAR,
                       end_year: int = END_YEAR) -> tuple[DataFrame, DataFrame]:
    """Resolve one file per (station, year), scan them all in one
    multi-path text read, decode, tag each report with its station dimension
    (J01) and list the (station, year) pairs with no file (J09).

    Only the resolved path list (metadata, one entry per station-year) reaches
    the driver; the reports themselves are read by the executors."""
    from stationflow.sources.fixed_width import decode_fixed_width, read_fixed_width

    chosen = resolve_files(list_files(spark, root), stations, start_year, end_year)
    paths = [r["path"] for r in chosen.select("path").collect()]
    missing = missing_grid(stations, start_year, end_year,
                           chosen.select(F.col("station").alias("station_code"), "year"))
    if not paths:
        empty = spark.createDataFrame([], "value string").withColumn("report_id", F.xxhash64("value"))
        schema = decode_fixed_width(empty, keep=("report_id",)).schema
        return with_station_dim(spark.createDataFrame([], schema), stations), missing
    lines = read_fixed_width(spark, paths)
    lines = lines.withColumn("report_id", F.xxhash64("value", "source_path"))
    obs = decode_fixed_width(lines, keep=("report_id",))
    return with_station_dim(obs, stations), missing


def missing_grid(stations: DataFrame, start_year: int, end_year: int, found: DataFrame | None,
                 station_col: str = "station_code") -> DataFrame:
    """Expected (station, year) pairs, minus those found (left anti).
    The grid is built by exploding the year range per station (no cross join)."""
    grid = stations.select(F.col(station_col), F.explode(F.sequence(F.lit(start_year), F.lit(end_year))).alias("year"))
    if found is None:
        return grid
    return grid.join(found, [station_col, "year"], "left_anti")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and an explicit schema (no inference)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json_map(spark: SparkSession, path: str, value_schema: str, key: str = "station_id") -> DataFrame:
    """A JSON object keyed by station (one document) → one row per key."""
    raw = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", f"map<string, {value_schema}>")
    return raw.select(F.explode(m).alias(key, "_v")).select(key, "_v.*")


def read_json(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """JSON records (multi-line documents allowed)."""
    r = spark.read.option("multiLine", multiline)
    if schema:
        r = r.schema(schema)
    return r.json(path)
