"""Per-station statistics and exceedance profiles.

The reference loops over stations with a filter per station (F05); here a
station is a group key.

Every statistic is one ``groupBy(station).agg`` with map-side partial
aggregation, so a hot station never lands whole in one task. Exact quantiles
take ``percentile``, which keeps a value→count map per group, only for tables
that Spark plans with fewer than ``MAP_ROWS`` rows, where no map can be large;
beyond that they come from counts per value in ranges (:func:`exact_quantiles`),
without any map. ``exact=False`` switches to ``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.operators.features import one_chunk
from stationflow.operators.joins import keyed_join

# A table planned with fewer rows may keep value maps for exact quantiles.
MAP_ROWS = 1 << 22
# Quantile names and levels of the threshold table.
THRESHOLD_QS = {"p99": 0.99, "p95": 0.95, "p90": 0.90, "p10": 0.10, "p05": 0.05, "p01": 0.01}


def _pcts(col: str, qs: list[float], exact: bool) -> Column:
    """All quantiles of one column from a single aggregate: one value→count
    map per group instead of one per quantile."""
    arr = F.array(*[F.lit(float(q)) for q in qs])
    return F.percentile(col, arr) if exact else F.percentile_approx(col, arr, 10000)


def with_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], aggs: list[Column], exact: bool = True,
                   map_rows: int = MAP_ROWS) -> DataFrame:
    """``by``, the named quantiles of ``value`` and the aggregates ``aggs``."""
    if not exact or one_chunk(df, map_rows):
        g = df.groupBy(*by).agg(_pcts(value, list(qs.values()), exact).alias("_q"), *aggs)
        return g.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(qs)], *g.columns[len(by) + 1:])
    g = df.groupBy(*by).agg(*aggs)
    j = keyed_join(g, exact_quantiles(df, by, value, qs), by)
    return j.select(*by, *qs, *g.columns[len(by):])


def thresholds(train: DataFrame, station: str = "station_id", value: str = "temperature",
               qs: dict[str, float] | None = None, exact: bool = True,
               prefix: str = "temp", map_rows: int = MAP_ROWS) -> DataFrame:
    """p99,p95,p90,p10,p05,p01, mean, sample std, min, max per station.

    Fit on the training rows only (the caller passes the train split).
    """
    named = {f"{prefix}_{k}": q for k, q in (qs or THRESHOLD_QS).items()}
    return with_quantiles(train, [station], value, named,
                          [F.avg(value).alias(f"{prefix}_mean"), F.stddev_samp(value).alias(f"{prefix}_std"),
                           F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max")], exact, map_rows)


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation at rank q·(n−1), NULLs skipped)
    without a per-group value map: rows are counted per (group, value) with
    map-side combine, cumulative counts come from the ranged prefix sums of
    ``operators.metrics.cumulative`` (no window spans a group), and each
    quantile is a conditional ``min`` in one final aggregate. Memory per task
    is bounded whatever the number of distinct values."""
    from stationflow.operators.metrics import cumulative

    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    c = cumulative(counts, by, "_v", ["_c"])
    n = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    j = keyed_join(c, n, by, "inner")
    aggs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_n") - 1)
        lo_r, hi_r = F.floor(pos), F.ceil(pos)
        # value at 0-based rank r: the smallest value whose cumulative count exceeds r
        aggs += [F.min(F.when(F.col("cum__c") > lo_r, F.col("_v"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("cum__c") > hi_r, F.col("_v"))).alias(f"_hi_{name}"),
                 F.first(pos - lo_r).alias(f"_fr_{name}")]
    g = j.groupBy(*by).agg(*aggs)
    out = [F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_fr_{k}") for k in qs]
    return g.select(*by, *[e.alias(k) for e, k in zip(out, qs)])


def with_thresholds(df: DataFrame, th: DataFrame, station: str = "station_id") -> DataFrame:
    """Left equi-join of rows to their station's thresholds.

    No broadcast hint: the threshold table has one row per station, which is
    small for weather networks but grows with the key space in general. AQE
    measures the aggregated side at run time and broadcasts it only when it is
    under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise the join
    stays a shuffle join.
    """
    return df.join(th, station, "left")


def daily_amplitude(df: DataFrame, station: str = "station_id", time: str = "datetime",
                    value: str = "temperature") -> DataFrame:
    """Daily (max − min) per station, then its mean and max per station."""
    daily = (df.groupBy(station, F.to_date(time).alias("_day"))
             .agg((F.max(value) - F.min(value)).alias("_amp")))
    return daily.groupBy(station).agg(F.avg("_amp").alias("amplitude_mean"),
                                      F.max("_amp").alias("amplitude_max"))


# Exceedance predicates of the station profile (degrees; wind as given).
EXCEEDANCE_TEMPERATURE = {"hot_35": (">=", 35.0), "hot_40": (">=", 40.0), "hot_45": (">=", 45.0),
                          "cold_0": ("<=", 0.0), "cold_minus10": ("<=", -10.0),
                          "cold_minus20": ("<=", -20.0)}
EXCEEDANCE_WIND = {"wind_60": (">=", 60.0), "wind_90": (">=", 90.0)}


def _pred(col: str, op: str, v: float) -> Column:
    c = F.col(col)
    return {">=": c >= v, ">": c > v, "<=": c <= v, "<": c < v, "==": c == v}[op]


def exceedance(df: DataFrame, by: str | list[str], preds: dict[str, Column]) -> DataFrame:
    """A14 + F06: count and % of rows per group meeting each named threshold
    predicate, all in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for name, p in preds.items():
        aggs.append(F.count_if(p).alias(f"{name}_count"))
    out = df.groupBy(by).agg(*aggs)
    return out.select("*", *[(F.col(f"{n}_count") * 100.0 / F.col("n_rows")).alias(f"{n}_pct")
                             for n in preds])


def temperature_exceedance(df: DataFrame, station: str = "station_id",
                           value: str = "temperature") -> DataFrame:
    preds = {n: _pred(value, op, v) for n, (op, v) in EXCEEDANCE_TEMPERATURE.items()}
    return exceedance(df, station, preds)


# Exceedance shares kept in the station profile.
PROFILE_SHARES = ("hot_35", "hot_40", "cold_0", "cold_minus10")


def station_profile(df: DataFrame, station: str = "station_id", time: str = "datetime",
                    value: str = "temperature", map_rows: int = MAP_ROWS) -> DataFrame:
    """Samples, min/max/mean/std, p01/p05/p95/p99, daily amplitude, shares."""
    n = F.count(F.lit(1))
    shares = [(F.count_if(_pred(value, *EXCEEDANCE_TEMPERATURE[k])) * 100.0 / n).alias(f"{k}_pct")
              for k in PROFILE_SHARES]
    qs = {"temp_p01": 0.01, "temp_p05": 0.05, "temp_p95": 0.95, "temp_p99": 0.99}
    base = with_quantiles(df, [station], value, qs, [
        n.alias("samples"), F.min(value).alias("temp_min"), F.max(value).alias("temp_max"),
        F.avg(value).alias("temp_mean"), F.stddev_samp(value).alias("temp_std"), *shares], True, map_rows)
    base = base.select(station, "samples", "temp_min", "temp_max", "temp_mean", "temp_std", *qs, *[f"{k}_pct" for k in PROFILE_SHARES])
    return keyed_join(base, daily_amplitude(df, station, time, value), [station])


# Station flag rules (profile column, strict lower bound, flag text).
STATION_FLAG_RULES = [("hot_40_pct", 1.0, "Canicules fréquentes"),
                      ("cold_minus10_pct", 5.0, "Froid sévère"),
                      ("amplitude_max", 25.0, "Chocs thermiques")]


def station_flags(profile: DataFrame, station: str = "station_id",
                  rules=STATION_FLAG_RULES) -> DataFrame:
    """List of flag texts per station from its profile; stations with none omitted."""
    arr = F.array(*[F.when(F.col(c) > F.lit(t), F.lit(txt)) for c, t, txt in rules])
    flags = F.filter(arr, lambda x: x.isNotNull())
    return (profile.select(station, flags.alias("flags"))
            .where(F.size("flags") > 0))
