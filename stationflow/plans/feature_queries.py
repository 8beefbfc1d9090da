"""Registered queries for derived variables, window features, splits and prep."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.functions import derive as D
from stationflow.operators import features as FE
from stationflow.operators import prep as P
from stationflow.operators import splits as S
from stationflow.operators.quality import completeness
from stationflow.operators.splits import split_predicate
from stationflow.plans.obs_queries import EV_TRAIN_END, EV_VAL_END, SPLIT_SQL, TH_SQL
from stationflow.plans.registry import query, round_doubles
from stationflow.sources.tables import OBS_SQL, observations, read_table
from stationflow.spec import OBS_SPEC

# Stand-in parameters: the driver's stations have 49–86 rows, so the
# 168-row defaults would never fill; the operators take them as parameters.
Q_LAGS = (1, 3, 6, 12, 24)
Q_WINDOWS = (6, 24)
Q_VARS = ("temperature", "dewpoint")
W_SQL = "PARTITION BY station_id ORDER BY datetime, event_id"


def _r(expr: str) -> str:
    return f"ROUND({expr}, 6)"


def lag_sql(c: str, k: int) -> str:
    return f"{_r(f'lag({c}, {k}) OVER ({W_SQL})')} AS {c}_lag_{k}h"


_SQL_STAT = {"ma": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def roll_sql(c: str, k: int, stat: str, min_periods: int = 1, leak_free: bool = False) -> str:
    frame = f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING" if leak_free else \
        f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"
    e = f"{_SQL_STAT[stat]}({c}) OVER ({W_SQL} {frame})"
    if stat in ("min", "max"):
        e = f"CAST({e} AS DOUBLE)"
    if min_periods > 1:
        e = f"CASE WHEN count({c}) OVER ({W_SQL} {frame}) >= {min_periods} THEN {e} END"
    return f"{_r(e)} AS {c}_{stat}_{k}h"


# ------------------------------------------------------------ derived columns
@query("cyclical", f"""WITH {OBS_SQL}
SELECT event_id,
  {_r('sin(2 * pi() * hour(datetime) / 24.0)')} AS hour_sin, {_r('cos(2 * pi() * hour(datetime) / 24.0)')} AS hour_cos,
  {_r('sin(2 * pi() * (isodow(datetime) - 1) / 7.0)')} AS day_of_week_sin,
  {_r('cos(2 * pi() * (isodow(datetime) - 1) / 7.0)')} AS day_of_week_cos,
  {_r('sin(2 * pi() * dayofyear(datetime) / 365.25)')} AS day_of_year_sin,
  {_r('cos(2 * pi() * dayofyear(datetime) / 365.25)')} AS day_of_year_cos,
  {_r('sin(2 * pi() * month(datetime) / 12.0)')} AS month_sin, {_r('cos(2 * pi() * month(datetime) / 12.0)')} AS month_cos
FROM obs""")
def q_cyclical(spark, d):
    """P08 (weekday Mon=0)."""
    o = observations(spark, d).select("event_id", "datetime")
    return round_doubles(D.cyclical(o).drop("datetime"))


@query("calendar_parts", f"""WITH {OBS_SQL}
SELECT event_id, CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month,
  CAST(day(datetime) AS INTEGER) AS day, CAST(hour(datetime) AS INTEGER) AS hour,
  CAST(minute(datetime) AS INTEGER) AS minute FROM obs""")
def q_calendar_parts(spark, d):
    """P07."""
    o = observations(spark, d).select("event_id", "datetime")
    return D.calendar_parts(o).drop("datetime")


RH_SQL = ("CASE WHEN temperature IS NULL OR dewpoint IS NULL THEN NULL ELSE "
          "least(greatest(100.0 * exp((17.27 * dewpoint / (237.7 + dewpoint)) - "
          "(17.27 * temperature / (237.7 + temperature))), 0.0), 100.0) END")
TF = "(temperature * (9.0 / 5.0) + 32.0)"
HI_POLY = (f"(-42.379 + 2.04901523 * {TF} + 10.14333127 * rh + -0.22475541 * {TF} * rh "
           f"+ -0.00683783 * {TF} * {TF} + -0.05481717 * rh * rh + 0.00122874 * {TF} * {TF} * rh "
           f"+ 0.00085282 * {TF} * rh * rh + -0.00000199 * {TF} * {TF} * rh * rh)")
HI_SQL = (f"CASE WHEN temperature IS NULL THEN NULL WHEN temperature < 26.7 OR rh IS NULL THEN temperature "
          f"ELSE ({HI_POLY} - 32.0) * (5.0 / 9.0) END")
HUM_SQL = f"""WITH {OBS_SQL}, h AS (SELECT *, {RH_SQL} AS rh FROM obs),
hh AS (SELECT *, {HI_SQL} AS hi FROM h)"""


def humid(spark, d):
    return D.humidity_and_heat(observations(spark, d))


@query("humidity_heat_index", HUM_SQL + """
SELECT event_id, ROUND(rh, 6) AS relative_humidity, ROUND(hi, 6) AS heat_index FROM hh""")
def q_humidity_heat_index(spark, d):
    """P09 + P10."""
    return round_doubles(humid(spark, d).select("event_id", "relative_humidity", "heat_index"))


@query("heat_index_stats", HUM_SQL + """
SELECT COUNT(hi) AS n_heat_index, ROUND(avg(hi), 6) AS mean_heat_index, ROUND(max(hi), 6) AS max_heat_index,
  ROUND(avg(rh), 6) AS mean_humidity, ROUND(min(rh), 6) AS min_humidity, ROUND(max(rh), 6) AS max_humidity
FROM hh""")
def q_heat_index_stats(spark, d):
    """Humidity mean/min/max, heat index non-null count, mean, max."""
    h = humid(spark, d)
    return round_doubles(h.agg(F.count("heat_index").alias("n_heat_index"),
                               F.avg("heat_index").alias("mean_heat_index"),
                               F.max("heat_index").alias("max_heat_index"),
                               F.avg("relative_humidity").alias("mean_humidity"),
                               F.min("relative_humidity").alias("min_humidity"),
                               F.max("relative_humidity").alias("max_humidity")))


@query("interactions", f"""WITH {OBS_SQL}
SELECT event_id, ROUND(temperature - dewpoint, 6) AS temp_dewpoint_diff,
  ROUND(temperature * dewpoint, 6) AS temp_dewpoint_product,
  ROUND(temperature / (dewpoint + 273.15), 6) AS temp_dewpoint_ratio,
  CAST(hour(datetime) * month(datetime) AS INTEGER) AS hour_month_interaction,
  ROUND(temperature - 0.5 * sqrt(dewpoint), 6) AS wind_chill_approx FROM obs""")
def q_interactions(spark, d):
    """P11 (the second variable stands in for wind speed; no pressure column)."""
    o = observations(spark, d)
    o = o.select("*", F.hour("datetime").alias("hour"), F.month("datetime").alias("month"))
    cols = D.interaction_columns("temperature", "dewpoint", slp=None, wind="dewpoint")
    return round_doubles(o.select("event_id", *cols))


ZONES = ("click", "error", "purchase", "signup", "view")


@query("onehot", f"""WITH {OBS_SQL}
SELECT event_id, {", ".join(f"CAST(climate_zone = '{z}' AS INTEGER) AS climate_zone_{z}" for z in ZONES)}
FROM obs""")
def q_onehot(spark, d):
    """P12 with the category list taken from the data's (bounded) dimension."""
    o = observations(spark, d)
    dim = o.select("climate_zone")
    return D.one_hot_from_dim(o, "climate_zone", dim, "climate_zone").select(
        "event_id", *[f"climate_zone_{z}" for z in ZONES])


# ------------------------------------------------------------- window features
@query("lags", f"""WITH {OBS_SQL}
SELECT event_id, {", ".join(lag_sql(c, k) for c in Q_VARS for k in Q_LAGS)} FROM obs""")
def q_lags(spark, d):
    """W01 (chunked per-station windows)."""
    o = observations(spark, d)
    return round_doubles(FE.lags(o, OBS_SPEC, Q_VARS, Q_LAGS).select(
        "event_id", *[f"{c}_lag_{k}h" for c in Q_VARS for k in Q_LAGS]))


# The same observations with rows of NULL station and NULL time, for the chunked
# form with chunks much shorter than a series.
HOLES_SQL = OBS_SQL + """,
holes AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN station_id END AS station_id,
                            CASE WHEN event_id % 11 <> 0 THEN datetime END AS datetime) FROM obs)"""
LAG_CHUNK, RUN_CHUNK = 32, 16


def with_holes(o):
    return (o.withColumn("station_id", F.when(F.col("event_id") % 7 != 0, F.col("station_id")))
            .withColumn("datetime", F.when(F.col("event_id") % 11 != 0, F.col("datetime"))))


def _nulls_first(sql: str) -> str:
    return sql.replace("ORDER BY datetime", "ORDER BY datetime NULLS FIRST")


@query("lags_chunked", _nulls_first(f"""WITH {HOLES_SQL}
SELECT event_id, {", ".join(lag_sql(c, k) for c in Q_VARS for k in Q_LAGS)} FROM holes"""))
def q_lags_chunked(spark, d):
    """W01 in chunks of 32 rows, with NULL stations and times."""
    o = with_holes(observations(spark, d))
    return round_doubles(FE.lags(o, OBS_SPEC, Q_VARS, Q_LAGS, chunk_rows=LAG_CHUNK).select(
        "event_id", *[f"{c}_lag_{k}h" for c in Q_VARS for k in Q_LAGS]))


ROLL_NAMES = [f"{c}_{s}_{k}h" for c in Q_VARS for k in Q_WINDOWS for s in ("ma", "std", "min", "max")]


@query("rolling", f"""WITH {OBS_SQL}
SELECT event_id, {", ".join(roll_sql(c, k, s) for c in Q_VARS for k in Q_WINDOWS
                           for s in ("ma", "std", "min", "max"))} FROM obs""")
def q_rolling(spark, d):
    """Rolling mean / sample std / min / max incl. the current row."""
    o = observations(spark, d)
    return round_doubles(FE.rolling(o, OBS_SPEC, Q_VARS, Q_WINDOWS).select("event_id", *ROLL_NAMES))


@query("rolling_minperiods", f"""WITH {OBS_SQL}
SELECT event_id, {", ".join(roll_sql(c, 6, s, 3, True) for c in Q_VARS for s in ("ma", "std", "min", "max"))}
FROM obs""")
def q_rolling_minperiods(spark, d):
    """W02 leak-free frame (the k previous rows) with min_periods=3."""
    o = observations(spark, d)
    r = FE.rolling(o, OBS_SPEC, Q_VARS, (6,), min_periods=3, leak_free=True)
    return round_doubles(r.select("event_id", *[f"{c}_{s}_6h" for c in Q_VARS
                                                 for s in ("ma", "std", "min", "max")]))


@query("feature_table", f"""WITH {OBS_SQL}
SELECT event_id, {", ".join(lag_sql(c, k) for c in Q_VARS for k in Q_LAGS)},
  {", ".join(roll_sql(c, k, s) for c in Q_VARS for k in Q_WINDOWS for s in ("ma", "std", "min", "max"))}
FROM obs""")
def q_feature_table(spark, d):
    """W01 + W02 together: one exchange and one sort feed all 26 window columns."""
    o = observations(spark, d)
    f = FE.time_series_features(o, OBS_SPEC, Q_VARS, Q_LAGS, Q_VARS, Q_WINDOWS)
    return round_doubles(f.select("event_id", *[f"{c}_lag_{k}h" for c in Q_VARS for k in Q_LAGS], *ROLL_NAMES))


# Stand-in heat-run predicate and minimum run length (rows).
RUN_HOT = 33.0
RUN_MIN = 3


@query("run_length", f"""WITH {OBS_SQL},
a AS (SELECT *, COALESCE(temperature >= {RUN_HOT}, false) AS p,
        row_number() OVER ({W_SQL}) AS rn FROM obs),
b AS (SELECT *, p AND NOT COALESCE(lag(p) OVER ({W_SQL}), false) AS st FROM a),
c AS (SELECT *, max(CASE WHEN st THEN rn END) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ls
      FROM b)
SELECT event_id, CASE WHEN p THEN rn - ls + 1 END AS run_position,
  COALESCE(CASE WHEN p THEN rn - ls + 1 END >= {RUN_MIN}, false) AS run_position_flag FROM c""")
def q_run_length(spark, d):
    """Consecutive-row runs of t ≥ 33, flag at run position ≥ 3."""
    o = observations(spark, d)
    r = FE.run_length(o, OBS_SPEC, F.col("temperature") >= RUN_HOT, RUN_MIN)
    return r.select("event_id", "run_position", "run_position_flag")


@query("run_length_chunked", _nulls_first(f"""WITH {HOLES_SQL},
a AS (SELECT *, COALESCE(temperature >= {RUN_HOT}, false) AS p,
        row_number() OVER ({W_SQL}) AS rn FROM holes),
b AS (SELECT *, p AND NOT COALESCE(lag(p) OVER ({W_SQL}), false) AS st FROM a),
c AS (SELECT *, max(CASE WHEN st THEN rn END) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ls
      FROM b)
SELECT event_id, CASE WHEN p THEN rn - ls + 1 END AS run_position,
  COALESCE(CASE WHEN p THEN rn - ls + 1 END >= {RUN_MIN}, false) AS run_position_flag FROM c"""))
def q_run_length_chunked(spark, d):
    """W09 in chunks of 16 rows, with NULL stations and times."""
    r = FE.run_length(with_holes(observations(spark, d)), OBS_SPEC, F.col("temperature") >= RUN_HOT, RUN_MIN, chunk_rows=RUN_CHUNK)
    return r.select("event_id", "run_position", "run_position_flag")


@query("feature_catalog", f"""WITH {OBS_SQL},
f AS (SELECT *, {", ".join(lag_sql(c, k) for c in Q_VARS for k in Q_LAGS)},
  {", ".join(roll_sql(c, k, s) for c in Q_VARS for k in Q_WINDOWS for s in ("ma", "std", "min", "max"))}
  FROM obs)
SELECT 0 AS n_temporal, 10 AS n_lag, 16 AS n_rolling, 0 AS n_interaction, 0 AS n_station, 32 AS n_columns,
  COUNT(*) AS n_rows,
  CAST(SUM({" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in
                  ["station_id", "datetime", "event_id", "temperature", "dewpoint", "climate_zone"]
                  + [f"{c}_lag_{k}h" for c in Q_VARS for k in Q_LAGS] + ROLL_NAMES)}) AS BIGINT) AS n_nulls,
  ROUND(100.0 * (1.0 - SUM({" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in
                  ["station_id", "datetime", "event_id", "temperature", "dewpoint", "climate_zone"]
                  + [f"{c}_lag_{k}h" for c in Q_VARS for k in Q_LAGS] + ROLL_NAMES)}) / (COUNT(*) * 32.0)), 6)
    AS completeness_pct FROM f""")
def q_feature_catalog(spark, d):
    """F08 + A32 over the feature table."""
    o = observations(spark, d)
    f = FE.time_series_features(o, OBS_SPEC, Q_VARS, Q_LAGS, Q_VARS, Q_WINDOWS)
    return round_doubles(FE.feature_catalog(f))


# ------------------------------------------------------------- splits and prep
ORD_TRAIN_END = "1999-12-31 00:00:00"
ORD_VAL_END = "2000-12-31 00:00:00"


@query("chrono_split", f"""SELECT split, COUNT(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM (SELECT *, CASE WHEN o_orderdate <= TIMESTAMP '{ORD_TRAIN_END}' THEN 'train'
                     WHEN o_orderdate <= TIMESTAMP '{ORD_VAL_END}' THEN 'val' ELSE 'test' END AS split
      FROM orders) GROUP BY split""")
def q_chrono_split(spark, d):
    """F03 on orders (1995–2001): counts and bounds per split."""
    o = S.chrono_split(read_table(spark, d, "orders"), "o_orderdate", ORD_TRAIN_END, ORD_VAL_END)
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_date"),
                                  F.max("o_orderdate").alias("last_date"))


def with_gaps(spark, d):
    """Observations with NULLs injected by predicate (error events lose the
    dew point, low dew points lose the temperature) and the split column."""
    o = observations(spark, d)
    o = o.select("station_id", "datetime", "event_id",
                 F.when(F.col("dewpoint") >= 5, F.col("temperature")).alias("temperature"),
                 F.when(F.col("climate_zone") != "error", F.col("dewpoint")).alias("dewpoint"))
    return S.chrono_split(o, "datetime", EV_TRAIN_END, EV_VAL_END)


GAPS_SQL = f"""WITH {OBS_SQL},
g AS (SELECT station_id, datetime, event_id, CASE WHEN dewpoint >= 5 THEN temperature END AS temperature,
        CASE WHEN climate_zone <> 'error' THEN dewpoint END AS dewpoint, {SPLIT_SQL} AS split FROM obs),
med AS (SELECT median(temperature) AS mt, median(dewpoint) AS md FROM g WHERE split = 'train'),
imp AS (SELECT g.event_id, g.split, COALESCE(g.temperature, med.mt) AS temperature,
          COALESCE(g.dewpoint, med.md) AS dewpoint FROM g, med)"""


@query("complete_cases", GAPS_SQL + """
SELECT split, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE temperature IS NOT NULL AND dewpoint IS NOT NULL)
  AS n_complete FROM g GROUP BY split""")
def q_complete_cases(spark, d):
    """complete-case count per split."""
    g = with_gaps(spark, d)
    c = S.complete_cases(g, ["temperature", "dewpoint"]).groupBy("split").agg(F.count(F.lit(1)).alias("n_complete"))
    return g.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).join(c, "split", "left").select(
        "split", "n_rows", F.coalesce("n_complete", F.lit(0)).alias("n_complete"))


@query("impute_fit_apply", GAPS_SQL + """
SELECT event_id, split, ROUND(temperature, 6) AS temperature, ROUND(dewpoint, 6) AS dewpoint FROM imp""")
def q_impute_fit_apply(spark, d):
    """A19 + P14: train medians (exact) fill every split."""
    g = with_gaps(spark, d)
    cols = ["temperature", "dewpoint"]
    med = P.fit_impute(g.where(split_predicate("datetime", "train", EV_TRAIN_END, EV_VAL_END)), cols)
    return round_doubles(P.apply_impute(g, med, cols).select("event_id", "split", *cols))


@query("scale_fit_apply", GAPS_SQL + """,
st AS (SELECT avg(temperature) AS m1, stddev_pop(temperature) AS s1, avg(dewpoint) AS m2,
         stddev_pop(dewpoint) AS s2 FROM imp WHERE split = 'train')
SELECT event_id, split, ROUND((temperature - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END, 6) AS temperature,
  ROUND((dewpoint - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END, 6) AS dewpoint FROM imp, st""")
def q_scale_fit_apply(spark, d):
    """A20 + P15 after A19/P14: the prep pipeline fitted once on train."""
    g = with_gaps(spark, d)
    out = P.fit_transform(g.select("event_id", "split", "temperature", "dewpoint"), ["temperature", "dewpoint"])
    return round_doubles(out)


@query("completeness", GAPS_SQL + """
SELECT ROUND(100.0 * (1.0 - (COUNT(*) - COUNT(temperature) + COUNT(*) - COUNT(dewpoint)) / (COUNT(*) * 6.0)), 6)
  AS completeness_pct FROM g""")
def q_completeness(spark, d):
    """A32 over the table with gaps (six columns)."""
    return round_doubles(completeness(with_gaps(spark, d)))


D_FEATS = ["temperature", "dewpoint", "temperature_lag_1h", "temperature_lag_3h", "dewpoint_lag_1h",
           "dewpoint_lag_3h", "temperature_ma_6h", "dewpoint_ma_6h"]


def _diag_sql():
    pairs = [(a, b) for i, a in enumerate(D_FEATS) for b in D_FEATS[i + 1:]]
    high = " + ".join(f"CASE WHEN abs(corr({a}, {b})) > 0.95 THEN 1 ELSE 0 END" for a, b in pairs)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in D_FEATS)
    zc = " + ".join(f"COUNT(*) FILTER (WHERE abs(({c} - m_{c}) / s_{c}) > 3.0)" for c in D_FEATS)
    return f"""WITH {OBS_SQL},
f AS (SELECT *, lag(temperature, 1) OVER ({W_SQL}) AS temperature_lag_1h,
  lag(temperature, 3) OVER ({W_SQL}) AS temperature_lag_3h, lag(dewpoint, 1) OVER ({W_SQL}) AS dewpoint_lag_1h,
  lag(dewpoint, 3) OVER ({W_SQL}) AS dewpoint_lag_3h,
  avg(temperature) OVER ({W_SQL} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS temperature_ma_6h,
  avg(dewpoint) OVER ({W_SQL} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS dewpoint_ma_6h FROM obs),
st AS (SELECT {stats} FROM f),
c AS (SELECT COUNT(*) AS n, {high} AS n_high_corr_pairs FROM f),
z AS (SELECT {zc} AS nz FROM f, st)
SELECT c.n AS n_rows, {len(D_FEATS)} AS n_features, ROUND(c.n / {float(len(D_FEATS))}, 6) AS rows_per_feature,
  ROUND(0.75, 6) AS share_engineered, CAST(c.n_high_corr_pairs AS INTEGER) AS n_high_corr_pairs,
  ROUND(z.nz * 100.0 / (c.n * {len(D_FEATS)}), 6) AS outlier_cell_pct FROM c, z"""


@query("diagnosis", _diag_sql())
def q_diagnosis(spark, d):
    """Diagnosis row over a lag/rolling feature table (8 features)."""
    o = observations(spark, d)
    f = FE.time_series_features(o, OBS_SPEC, Q_VARS, (1, 3), Q_VARS, (6,))
    from stationflow.operators.quality import diagnosis
    out = diagnosis(f, D_FEATS).withColumn("n_high_corr_pairs", F.col("n_high_corr_pairs").cast("int"))
    return round_doubles(out)


ETL_COLS = ["relative_humidity", "temperature_lag_1h", "temperature_ma_6h", "dewpoint_lag_3h"]


def _etl_sql():
    lagw = f"OVER ({W_SQL})"
    base = f"""WITH {OBS_SQL}, h AS (SELECT *, {RH_SQL} AS relative_humidity FROM obs),
f AS (SELECT event_id, {SPLIT_SQL} AS split, relative_humidity,
        sin(2 * pi() * hour(datetime) / 24.0) AS hour_sin,
        lag(temperature, 1) {lagw} AS temperature_lag_1h, lag(dewpoint, 3) {lagw} AS dewpoint_lag_3h,
        avg(temperature) OVER ({W_SQL} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS temperature_ma_6h FROM h),
med AS (SELECT {", ".join(f"median({c}) AS md_{c}" for c in ETL_COLS)} FROM f WHERE split = 'train'),
imp AS (SELECT f.event_id, f.split, f.hour_sin, {", ".join(f"COALESCE(f.{c}, md_{c}) AS {c}" for c in ETL_COLS)}
        FROM f, med),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ETL_COLS)}
       FROM imp WHERE split = 'train')
SELECT event_id, split, ROUND(hour_sin, 6) AS hour_sin,
  {", ".join(f"ROUND(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS {c}" for c in ETL_COLS)}
FROM imp, st"""
    return base


@query("etl_features", _etl_sql())
def q_etl_features(spark, d):
    """E1 batch chain in one plan: derive (P09) → cyclical (P08) → lags and
    rolling in one window (W01/W02) → chronological split (F03) → train
    medians fill the NULLs the lags create (A19/P14) → train scaling
    (A20/P15)."""
    o = observations(spark, d)
    h = D.humidity_and_heat(o)
    f = FE.time_series_features(h, OBS_SPEC, ("temperature", "dewpoint"), (1, 3), ("temperature",), (6,))
    f = S.chrono_split(f, "datetime", EV_TRAIN_END, EV_VAL_END)
    f = f.select("event_id", "split", F.sin(F.lit(2 * 3.141592653589793) * F.hour("datetime") / F.lit(24.0))
                 .alias("hour_sin"), *ETL_COLS)
    return round_doubles(P.fit_transform(f, ETL_COLS, materialize_input=True))


@query("run_length_p95", f"""WITH {OBS_SQL}, {TH_SQL},
a AS (SELECT o.*, COALESCE(o.temperature > th.temp_p95, false) AS p,
        row_number() OVER ({W_SQL.replace('station_id', 'o.station_id').replace('datetime', 'o.datetime')
                            .replace('event_id', 'o.event_id')}) AS rn
      FROM obs o LEFT JOIN th USING (station_id)),
b AS (SELECT *, p AND NOT COALESCE(lag(p) OVER ({W_SQL}), false) AS st FROM a),
c AS (SELECT *, max(CASE WHEN st THEN rn END) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ls
      FROM b)
SELECT event_id, CASE WHEN p THEN rn - ls + 1 END AS run_position,
  COALESCE(CASE WHEN p THEN rn - ls + 1 END >= 2, false) AS run_position_flag FROM c""")
def q_run_length_p95(spark, d):
    """W09 variant: runs of readings above the station's train p95 (adaptive
    heat-wave persistence), flagged from the second consecutive row."""
    from stationflow.operators.thresholds import with_thresholds
    from stationflow.plans.obs_queries import train_thresholds
    o = with_thresholds(observations(spark, d), train_thresholds(spark, d).select("station_id", "temp_p95"))
    r = FE.run_length(o, OBS_SPEC, F.col("temperature") > F.col("temp_p95"), 2)
    return r.select("event_id", "run_position", "run_position_flag")
