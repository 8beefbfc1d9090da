"""Registered queries over the stand-in observation table (``events``):
quality report, station thresholds and profiles, labels, class statistics.

Split bounds for ``events`` (January 2024): train ≤ Jan 20, val ≤ Jan 25.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import labels as L
from stationflow.operators import quality as Q
from stationflow.operators import thresholds as TH
from stationflow.operators.splits import split_column, split_predicate
from stationflow.plans.registry import query, rnd, round_doubles
from stationflow.sources.tables import OBS_SQL, observations
from stationflow.spec import OBS_SPEC

# Stand-in split bounds for the January 2024 events.
EV_TRAIN_END = "2024-01-20 00:00:00"
EV_VAL_END = "2024-01-25 00:00:00"

SPLIT_SQL = (f"CASE WHEN datetime <= TIMESTAMP '{EV_TRAIN_END}' THEN 'train' "
             f"WHEN datetime <= TIMESTAMP '{EV_VAL_END}' THEN 'val' ELSE 'test' END")


def obs_split(spark, d):
    o = observations(spark, d)
    return o.select("*", split_column("datetime", EV_TRAIN_END, EV_VAL_END).alias("split"))


def train_rows(spark, d):
    """The train split as a range predicate (pushed to the scan)."""
    return observations(spark, d).where(split_predicate("datetime", "train", EV_TRAIN_END, EV_VAL_END))


def train_thresholds(spark, d):
    """A11 fitted on the train split only."""
    return TH.thresholds(train_rows(spark, d))


# SQL pieces shared by the oracle queries.
TH_SQL = f"""th AS (
  SELECT station_id,
    quantile_cont(temperature, 0.99) AS temp_p99, quantile_cont(temperature, 0.95) AS temp_p95,
    quantile_cont(temperature, 0.90) AS temp_p90, quantile_cont(temperature, 0.10) AS temp_p10,
    quantile_cont(temperature, 0.05) AS temp_p05, quantile_cont(temperature, 0.01) AS temp_p01,
    avg(temperature) AS temp_mean, stddev_samp(temperature) AS temp_std,
    min(temperature) AS temp_min, max(temperature) AS temp_max
  FROM obs WHERE datetime <= TIMESTAMP '{EV_TRAIN_END}' GROUP BY station_id)"""

LABEL5_SQL = """CASE WHEN o.temperature >= th.temp_p01 AND o.temperature < th.temp_p05 THEN 4
     WHEN o.temperature < th.temp_p01 THEN 3
     WHEN o.temperature > th.temp_p95 AND o.temperature <= th.temp_p99 THEN 2
     WHEN o.temperature > th.temp_p99 THEN 1 ELSE 0 END"""

LABELED_SQL = f"""WITH {OBS_SQL}, {TH_SQL},
lab AS (SELECT o.*, {SPLIT_SQL.replace('datetime', 'o.datetime')} AS split, {LABEL5_SQL} AS extreme_event
        FROM obs o LEFT JOIN th USING (station_id))"""


def labeled(spark, d):
    """Observations with split and the 5-class adaptive label."""
    return L.label_adaptive(obs_split(spark, d), train_thresholds(spark, d))


# --------------------------------------------------------------------- quality
@query("overview", f"""WITH {OBS_SQL}
SELECT COUNT(*) AS n_rows, 6 AS n_columns, min(datetime) AS first_time, max(datetime) AS last_time,
  CAST(date_diff('day', CAST(min(datetime) AS DATE), CAST(max(datetime) AS DATE)) AS INTEGER) AS span_days,
  array_to_string(list_sort(list(DISTINCT year(datetime))), ',') AS years
FROM obs""")
def q_overview(spark, d):
    """A01."""
    return Q.overview(observations(spark, d), OBS_SPEC)


@query("station_counts", f"""WITH {OBS_SQL}
SELECT station_id, climate_zone, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS pct
FROM obs GROUP BY station_id, climate_zone""")
def q_station_counts(spark, d):
    """Count and share per (station, zone)."""
    g = Q.group_share(observations(spark, d), ["station_id", "climate_zone"])
    return g.select("station_id", "climate_zone", "n", rnd("pct").alias("pct"))


@query("null_profile", """SELECT column_name AS "column", n_null, ROUND(n_null * 100.0 / n, 6) AS pct_null FROM (
  SELECT COUNT(*) AS n, COUNT(*) - COUNT(o_orderkey) AS o_orderkey, COUNT(*) - COUNT(o_custkey) AS o_custkey,
    COUNT(*) - COUNT(o_orderstatus) AS o_orderstatus, COUNT(*) - COUNT(o_totalprice) AS o_totalprice,
    COUNT(*) - COUNT(o_orderdate) AS o_orderdate, COUNT(*) - COUNT(o_orderpriority) AS o_orderpriority,
    COUNT(*) - COUNT(l_quantity) AS l_quantity
  FROM (SELECT o.*, l.l_quantity FROM orders o LEFT JOIN
        (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 10) l
        ON o.o_orderkey = l.l_orderkey)
) UNPIVOT (n_null FOR column_name IN (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
                                      o_orderpriority, l_quantity))
WHERE n_null > 0""")
def q_null_profile(spark, d):
    """A03 on orders left-joined to a sparse lineitem attribute (so NULLs exist)."""
    from stationflow.sources.tables import read_table
    o = read_table(spark, d, "orders")
    li = (read_table(spark, d, "lineitem").where((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 10))
          .select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"))
    j = o.join(li, "o_orderkey", "left")
    return round_doubles(Q.null_profile(j))


@query("numeric_summary", f"""WITH {OBS_SQL}
SELECT "column", count, ROUND(mean, 6) AS mean, ROUND(median, 6) AS median, ROUND(std, 6) AS std,
       ROUND(min, 6) AS min, ROUND(max, 6) AS max, ROUND(p25, 6) AS p25, ROUND(p75, 6) AS p75 FROM (
  SELECT 'temperature' AS "column", COUNT(temperature) AS count, avg(temperature) AS mean,
    median(temperature) AS median, stddev_samp(temperature) AS std, min(temperature) AS min,
    max(temperature) AS max, quantile_cont(temperature, 0.25) AS p25, quantile_cont(temperature, 0.75) AS p75 FROM obs
  UNION ALL
  SELECT 'dewpoint', COUNT(dewpoint), avg(dewpoint), median(dewpoint), stddev_samp(dewpoint), min(dewpoint),
    max(dewpoint), quantile_cont(dewpoint, 0.25), quantile_cont(dewpoint, 0.75) FROM obs)""")
def q_numeric_summary(spark, d):
    """A04."""
    return round_doubles(Q.summary(observations(spark, d), ["temperature", "dewpoint"]))


@query("zone_stats", f"""WITH {OBS_SQL}
SELECT climate_zone, ROUND(avg(temperature), 6) AS mean, ROUND(min(temperature), 6) AS min,
  ROUND(max(temperature), 6) AS max, ROUND(stddev_samp(temperature), 6) AS std
FROM obs GROUP BY climate_zone""")
def q_zone_stats(spark, d):
    """A05."""
    g = observations(spark, d).groupBy("climate_zone").agg(
        F.avg("temperature").alias("mean"), F.min("temperature").alias("min"),
        F.max("temperature").alias("max"), F.stddev_samp("temperature").alias("std"))
    return round_doubles(g)


@query("calm_share", f"""WITH {OBS_SQL}
SELECT COUNT(*) FILTER (WHERE dewpoint < 1) AS calm_count,
  ROUND(COUNT(*) FILTER (WHERE dewpoint < 1) * 100.0 / COUNT(*), 6) AS calm_pct,
  ROUND(avg(dewpoint), 6) AS dew_mean, ROUND(min(dewpoint), 6) AS dew_min, ROUND(max(dewpoint), 6) AS dew_max
FROM obs""")
def q_calm_share(spark, d):
    """Conditional share (second variable < 1, the calm-wind test) and its mean/min/max."""
    o = observations(spark, d)
    p = F.col("dewpoint") < 1
    return round_doubles(o.agg(F.count_if(p).alias("calm_count"),
                               (F.count_if(p) * 100.0 / F.count(F.lit(1))).alias("calm_pct"),
                               F.avg("dewpoint").alias("dew_mean"), F.min("dewpoint").alias("dew_min"),
                               F.max("dewpoint").alias("dew_max")))


@query("year_counts", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n FROM orders GROUP BY 1""")
def q_year_counts(spark, d):
    """A09 on orders (several years)."""
    from stationflow.sources.tables import read_table
    return Q.counts_by(read_table(spark, d, "orders"), F.year("o_orderdate"), "year")


@query("distinct_stations", f"""WITH {OBS_SQL}
SELECT COUNT(DISTINCT station_id) AS n_distinct_station_id FROM obs""")
def q_distinct_stations(spark, d):
    """A10."""
    return Q.distinct_count(observations(spark, d), "station_id")


# ------------------------------------------------------------------ thresholds
@query("station_thresholds", f"""WITH {OBS_SQL}, {TH_SQL}
SELECT station_id, ROUND(temp_p99, 6) AS temp_p99, ROUND(temp_p95, 6) AS temp_p95, ROUND(temp_p90, 6) AS temp_p90,
  ROUND(temp_p10, 6) AS temp_p10, ROUND(temp_p05, 6) AS temp_p05, ROUND(temp_p01, 6) AS temp_p01,
  ROUND(temp_mean, 6) AS temp_mean, ROUND(temp_std, 6) AS temp_std, ROUND(temp_min, 6) AS temp_min,
  ROUND(temp_max, 6) AS temp_max FROM th""")
def q_station_thresholds(spark, d):
    """A11 (train only)."""
    return round_doubles(train_thresholds(spark, d))


@query("daily_amplitude", f"""WITH {OBS_SQL},
dd AS (SELECT station_id, CAST(datetime AS DATE) AS day, max(temperature) - min(temperature) AS amp
       FROM obs GROUP BY station_id, CAST(datetime AS DATE))
SELECT station_id, ROUND(avg(amp), 6) AS amplitude_mean, ROUND(max(amp), 6) AS amplitude_max
FROM dd GROUP BY station_id""")
def q_daily_amplitude(spark, d):
    """Two-level aggregate."""
    return round_doubles(TH.daily_amplitude(observations(spark, d)))


_EXC = TH.EXCEEDANCE_TEMPERATURE


def _exc_sql():
    parts = []
    for n, (op, v) in _EXC.items():
        parts.append(f"COUNT(*) FILTER (WHERE temperature {op} {v}) AS {n}_count")
    for n, (op, v) in _EXC.items():
        parts.append(f"ROUND(COUNT(*) FILTER (WHERE temperature {op} {v}) * 100.0 / COUNT(*), 6) AS {n}_pct")
    return ",\n  ".join(parts)


@query("exceedance", f"""WITH {OBS_SQL}
SELECT station_id, COUNT(*) AS n_rows,
  {_exc_sql()}
FROM obs GROUP BY station_id""")
def q_exceedance(spark, d):
    """A14."""
    return round_doubles(TH.temperature_exceedance(observations(spark, d)))


_PROFILE_SQL = f"""WITH {OBS_SQL},
dd AS (SELECT station_id, CAST(datetime AS DATE) AS day, max(temperature) - min(temperature) AS amp
       FROM obs GROUP BY station_id, CAST(datetime AS DATE)),
amp AS (SELECT station_id, avg(amp) AS amplitude_mean, max(amp) AS amplitude_max FROM dd GROUP BY station_id),
base AS (SELECT station_id, COUNT(*) AS samples, min(temperature) AS temp_min, max(temperature) AS temp_max,
  avg(temperature) AS temp_mean, stddev_samp(temperature) AS temp_std,
  quantile_cont(temperature, 0.01) AS temp_p01, quantile_cont(temperature, 0.05) AS temp_p05,
  quantile_cont(temperature, 0.95) AS temp_p95, quantile_cont(temperature, 0.99) AS temp_p99,
  COUNT(*) FILTER (WHERE temperature >= 35.0) * 100.0 / COUNT(*) AS hot_35_pct,
  COUNT(*) FILTER (WHERE temperature >= 40.0) * 100.0 / COUNT(*) AS hot_40_pct,
  COUNT(*) FILTER (WHERE temperature <= 0.0) * 100.0 / COUNT(*) AS cold_0_pct,
  COUNT(*) FILTER (WHERE temperature <= -10.0) * 100.0 / COUNT(*) AS cold_minus10_pct
  FROM obs GROUP BY station_id),
prof AS (SELECT * FROM base LEFT JOIN amp USING (station_id))"""


@query("station_profile", _PROFILE_SQL + """
SELECT station_id, samples, ROUND(temp_min, 6) AS temp_min, ROUND(temp_max, 6) AS temp_max,
  ROUND(temp_mean, 6) AS temp_mean, ROUND(temp_std, 6) AS temp_std, ROUND(temp_p01, 6) AS temp_p01,
  ROUND(temp_p05, 6) AS temp_p05, ROUND(temp_p95, 6) AS temp_p95, ROUND(temp_p99, 6) AS temp_p99,
  ROUND(hot_35_pct, 6) AS hot_35_pct, ROUND(hot_40_pct, 6) AS hot_40_pct, ROUND(cold_0_pct, 6) AS cold_0_pct,
  ROUND(cold_minus10_pct, 6) AS cold_minus10_pct, ROUND(amplitude_mean, 6) AS amplitude_mean,
  ROUND(amplitude_max, 6) AS amplitude_max FROM prof""")
def q_station_profile(spark, d):
    """A12."""
    return round_doubles(TH.station_profile(observations(spark, d)))


@query("station_flags", _PROFILE_SQL + """,
fl AS (SELECT station_id, list_filter([CASE WHEN hot_40_pct > 1.0 THEN 'Canicules fréquentes' END,
                                     CASE WHEN cold_minus10_pct > 5.0 THEN 'Froid sévère' END,
                                     CASE WHEN amplitude_max > 25.0 THEN 'Chocs thermiques' END],
                                    lambda x: x IS NOT NULL) AS flags FROM prof)
SELECT station_id, array_to_string(flags, '|') AS flags, CAST(len(flags) AS INTEGER) AS n_flags FROM fl
WHERE len(flags) > 0""")
def q_station_flags(spark, d):
    """A39."""
    f = TH.station_flags(TH.station_profile(observations(spark, d)))
    return f.select("station_id", F.array_join("flags", "|").alias("flags"), F.size("flags").alias("n_flags"))


# ---------------------------------------------------------------------- labels
@query("label5", LABELED_SQL + """
SELECT station_id, split, extreme_event, COUNT(*) AS n FROM lab GROUP BY ALL""")
def q_label5(spark, d):
    """R01 + J02: 5-class adaptive labels, counted per station and split."""
    return labeled(spark, d).groupBy("station_id", "split", "extreme_event").agg(F.count(F.lit(1)).alias("n"))


@query("label_binary", f"""WITH {OBS_SQL}, {TH_SQL}
SELECT o.event_id, CASE WHEN o.temperature < th.temp_p10 OR o.temperature > th.temp_p90 THEN 1 ELSE 0 END
  AS is_extreme_event FROM obs o LEFT JOIN th USING (station_id)""")
def q_label_binary(spark, d):
    """R02 per row (p10/p90 of the row's own station)."""
    b = L.label_binary(observations(spark, d), train_thresholds(spark, d))
    return b.select("event_id", "is_extreme_event")


@query("label_fixed", f"""WITH {OBS_SQL}
SELECT event_id, CASE WHEN temperature >= 33.0 THEN 1 WHEN temperature <= -5.0 THEN 2 ELSE 0 END AS extreme_event
FROM obs""")
def q_label_fixed(spark, d):
    """R04."""
    return L.label_fixed(observations(spark, d)).select("event_id", "extreme_event")


ROLL48_SQL = f"""WITH {OBS_SQL},
r AS (SELECT *, CASE WHEN COUNT(temperature) OVER w >= 24 THEN avg(temperature) OVER w END AS temp_rolling_48h
      FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY datetime, event_id
                            ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))"""


@query("label_rolling", ROLL48_SQL + """
SELECT event_id, ROUND(temp_rolling_48h, 6) AS temp_rolling_48h,
  CASE WHEN temp_rolling_48h >= 28.0 THEN 1 WHEN temp_rolling_48h <= 2.0 THEN 2 ELSE 0 END AS extreme_event,
  COALESCE(temperature >= 30.0, false) AS is_hot, COALESCE(temperature <= 0.0, false) AS is_cold FROM r""")
def q_label_rolling(spark, d):
    """R03 + W03 + P13 (48-row mean, min 24 values)."""
    r = L.label_rolling(observations(spark, d), OBS_SPEC)
    return r.select("event_id", rnd("temp_rolling_48h").alias("temp_rolling_48h"), "extreme_event",
                    "is_hot", "is_cold")


@query("class_distribution", LABELED_SQL + """
SELECT split, extreme_event, COUNT(*) AS n,
  ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY split), 6) AS pct FROM lab
GROUP BY split, extreme_event""")
def q_class_distribution(spark, d):
    """A15 per split."""
    c = L.class_distribution(labeled(spark, d), "extreme_event", ["split"])
    return c.select("split", "extreme_event", "n", rnd("pct").alias("pct"))


@query("class_weights", LABELED_SQL + """,
c AS (SELECT extreme_event, COUNT(*) AS n FROM lab WHERE split = 'train' GROUP BY ALL)
SELECT extreme_event, n, ROUND(SUM(n) OVER () / (COUNT(*) OVER () * n), 6) AS weight FROM c""")
def q_class_weights(spark, d):
    """A16 on the train split."""
    w = L.class_weights(labeled(spark, d).where(split_predicate("datetime", "train", EV_TRAIN_END, EV_VAL_END)), "extreme_event")
    return w.select("extreme_event", "n", rnd("weight").alias("weight"))


@query("imbalance", LABELED_SQL + """,
c AS (SELECT extreme_event, COUNT(*) AS n FROM lab WHERE split = 'train' GROUP BY ALL)
SELECT ROUND(max(n) * 1.0 / min(n), 6) AS imbalance_ratio, max(n) AS max_count, min(n) AS min_count,
  max(n) * 1.0 / min(n) > 20 AS use_focal, max(n) * 1.0 / min(n) > 50 AS focal_mandatory FROM c""")
def q_imbalance(spark, d):
    """A17."""
    r = L.imbalance(labeled(spark, d).where(split_predicate("datetime", "train", EV_TRAIN_END, EV_VAL_END)), "extreme_event")
    return r.select(rnd("imbalance_ratio").alias("imbalance_ratio"), "max_count", "min_count",
                    "use_focal", "focal_mandatory")


@query("class_stats", LABELED_SQL + """
SELECT extreme_event, COUNT(*) AS n, ROUND(min(temperature), 6) AS min_value,
  ROUND(avg(temperature), 6) AS mean_value, ROUND(max(temperature), 6) AS max_value FROM lab GROUP BY ALL""")
def q_class_stats(spark, d):
    """A18."""
    return round_doubles(L.class_stats(labeled(spark, d), "extreme_event"))


@query("label_names", LABELED_SQL + """
SELECT event_id, extreme_event, CASE extreme_event WHEN 0 THEN 'Normal' WHEN 1 THEN 'Canicule_Extreme'
  WHEN 2 THEN 'Forte_Chaleur' WHEN 3 THEN 'Froid_Extreme' WHEN 4 THEN 'Froid_Prolonge' END AS event_name,
  CAST(extreme_event = 1 AS DOUBLE) AS onehot_1, CAST(extreme_event = 3 AS DOUBLE) AS onehot_3 FROM lab""")
def q_label_names(spark, d):
    """P16 + P17: class names and one-hot labels."""
    lab = labeled(spark, d)
    oh = L.one_hot_label(F.col("extreme_event"), 5)
    return lab.select("event_id", "extreme_event",
                      L.decode_label(F.col("extreme_event"), L.ADAPTIVE_CLASSES).alias("event_name"),
                      oh[1].alias("onehot_1"), oh[3].alias("onehot_3"))


@query("station_quantiles_distributed", f"""WITH {OBS_SQL}
SELECT station_id, ROUND(quantile_cont(temperature, 0.99), 6) AS temp_p99,
  ROUND(quantile_cont(temperature, 0.5), 6) AS temp_p50, ROUND(quantile_cont(temperature, 0.01), 6) AS temp_p01
FROM obs GROUP BY station_id""")
def q_station_quantiles_distributed(spark, d):
    """A11 quantiles by the distributed exact method (no per-group value map)."""
    q = TH.exact_quantiles(observations(spark, d), ["station_id"], "temperature",
                           {"temp_p99": 0.99, "temp_p50": 0.5, "temp_p01": 0.01})
    return round_doubles(q)
