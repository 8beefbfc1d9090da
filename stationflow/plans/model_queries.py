"""Registered queries for sequences, forecast baselines, MLlib models and
model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import compare as C
from stationflow.operators import forecast as FC
from stationflow.operators import labels as L
from stationflow.operators.metrics import regression_metrics
from stationflow.operators.sequences import sequence_count, sequences
from stationflow.plans.registry import query, rnd, round_doubles
from stationflow.sources.tables import OBS_SQL, observations, read_table
from stationflow.spec import OBS_SPEC, SeriesSpec

SEQ_L = 24
SEQ_W = "PARTITION BY station_id ORDER BY datetime, event_id"


def _seq_input(spark, d):
    return L.label_fixed(observations(spark, d))


@query("sequences_next", f"""WITH {OBS_SQL},
s AS (SELECT event_id, CASE WHEN temperature >= 33.0 THEN 1 WHEN temperature <= -5.0 THEN 2 ELSE 0 END AS y,
  list([CAST(temperature AS FLOAT), CAST(dewpoint AS FLOAT)]) OVER ({SEQ_W}
       ROWS BETWEEN {SEQ_L} PRECEDING AND 1 PRECEDING) AS x FROM obs)
SELECT event_id, CAST(len(x) AS INTEGER) AS seq_len, ROUND(CAST(x[1][1] AS DOUBLE), 6) AS first_temperature,
  ROUND(CAST(x[{SEQ_L}][1] AS DOUBLE), 6) AS last_temperature, ROUND(CAST(x[{SEQ_L}][2] AS DOUBLE), 6) AS last_dewpoint,
  y FROM s WHERE len(x) = {SEQ_L}""")
def q_sequences_next(spark, d):
    """x = previous 24 rows (temperature, dew point), y = R04 label at t."""
    s = sequences(_seq_input(spark, d), OBS_SPEC, ["temperature", "dewpoint"], "extreme_event", SEQ_L)
    return s.select("event_id", F.size("x").alias("seq_len"),
                    rnd(F.col("x")[0][0].cast("double")).alias("first_temperature"),
                    rnd(F.col("x")[SEQ_L - 1][0].cast("double")).alias("last_temperature"),
                    rnd(F.col("x")[SEQ_L - 1][1].cast("double")).alias("last_dewpoint"), "y")


@query("sequences_last", f"""WITH {OBS_SQL},
s AS (SELECT event_id, CASE WHEN temperature >= 33.0 THEN 1 WHEN temperature <= -5.0 THEN 2 ELSE 0 END AS y,
  row_number() OVER ({SEQ_W}) AS rn, COUNT(*) OVER (PARTITION BY station_id) AS n,
  list([CAST(temperature AS FLOAT), CAST(dewpoint AS FLOAT)]) OVER ({SEQ_W}
       ROWS BETWEEN {SEQ_L - 1} PRECEDING AND CURRENT ROW) AS x FROM obs)
SELECT event_id, CAST(len(x) AS INTEGER) AS seq_len, ROUND(CAST(x[1][1] AS DOUBLE), 6) AS first_temperature,
  ROUND(CAST(x[{SEQ_L}][1] AS DOUBLE), 6) AS last_temperature, y FROM s WHERE len(x) = {SEQ_L} AND rn < n""")
def q_sequences_last(spark, d):
    """Label on the last element, final row of each station dropped (n − L rows)."""
    s = sequences(_seq_input(spark, d), OBS_SPEC, ["temperature", "dewpoint"], "extreme_event", SEQ_L,
                  label="last", drop_tail=True)
    return s.select("event_id", F.size("x").alias("seq_len"),
                    rnd(F.col("x")[0][0].cast("double")).alias("first_temperature"),
                    rnd(F.col("x")[SEQ_L - 1][0].cast("double")).alias("last_temperature"), "y")


@query("sequence_count", f"""WITH {OBS_SQL}
SELECT CAST(SUM(GREATEST(n - {SEQ_L}, 0)) AS BIGINT) AS n_sequences FROM
  (SELECT station_id, COUNT(*) AS n FROM obs GROUP BY station_id)""")
def q_sequence_count(spark, d):
    """W04 cardinality law Σ max(n_s − L, 0)."""
    return sequence_count(observations(spark, d), OBS_SPEC, SEQ_L)


# ---------------------------------------------------------------- baselines
# Daily revenue (thousands) per order priority: five keyed daily series, 1995–2001.
DAY_SPEC = SeriesSpec("o_orderpriority", "day")
D_TRAIN_END = "1999-12-31 00:00:00"
D_TEST_START = "2000-12-31 00:00:00"
PERIOD = 365


def daily(spark, d):
    o = read_table(spark, d, "orders")
    return o.groupBy("o_orderpriority", F.col("o_orderdate").alias("day")).agg(
        (F.sum("o_totalprice") / 1000.0).alias("revenue"))


def daily_split(spark, d):
    s = daily(spark, d)
    train = s.where(F.col("day") <= F.to_timestamp_ntz(F.lit(D_TRAIN_END)))
    test = s.where(F.col("day") > F.to_timestamp_ntz(F.lit(D_TEST_START)))
    return train, test


DAILY_SQL = f"""WITH s AS (SELECT o_orderpriority, o_orderdate AS day, SUM(o_totalprice) / 1000.0 AS revenue
                FROM orders GROUP BY ALL),
tr AS (SELECT * FROM s WHERE day <= TIMESTAMP '{D_TRAIN_END}'),
te AS (SELECT * FROM s WHERE day > TIMESTAMP '{D_TEST_START}'),
pers AS (SELECT te.*, l.y_hat FROM te LEFT JOIN
           (SELECT o_orderpriority, arg_max(revenue, day) AS y_hat FROM tr WHERE revenue IS NOT NULL GROUP BY ALL) l
         USING (o_orderpriority)),
trn AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) - 1 AS ix,
          COUNT(*) OVER (PARTITION BY o_orderpriority) AS n, avg(revenue) OVER (PARTITION BY o_orderpriority) AS m
        FROM tr),
stat AS (SELECT DISTINCT o_orderpriority, n, m FROM trn),
ten AS (SELECT te.*, row_number() OVER (PARTITION BY te.o_orderpriority ORDER BY day) - 1 AS i, stat.n, stat.m
        FROM te LEFT JOIN stat USING (o_orderpriority)),
seas AS (SELECT ten.o_orderpriority, ten.day, ten.revenue, COALESCE(trn.revenue, ten.m) AS y_hat
         FROM ten LEFT JOIN trn ON trn.o_orderpriority = ten.o_orderpriority AND trn.ix = ten.n - {PERIOD} + ten.i)"""


@query("persistence", DAILY_SQL + """
SELECT o_orderpriority, day, ROUND(revenue, 6) AS revenue, ROUND(y_hat, 6) AS y_hat FROM pers""")
def q_persistence(spark, d):
    """Last train value per series for every test day."""
    train, test = daily_split(spark, d)
    return round_doubles(FC.persistence(train, test, DAY_SPEC, "revenue").select(
        "o_orderpriority", "day", "revenue", "y_hat"))


@query("seasonal_naive", DAILY_SQL + """
SELECT o_orderpriority, day, ROUND(revenue, 6) AS revenue, ROUND(y_hat, 6) AS y_hat FROM seas""")
def q_seasonal_naive(spark, d):
    """W08 + J08: train row n − 365 + i, else the train mean."""
    train, test = daily_split(spark, d)
    return round_doubles(FC.seasonal_naive(train, test, DAY_SPEC, "revenue", PERIOD).select(
        "o_orderpriority", "day", "revenue", "y_hat"))


@query("seasonal_calendar", DAILY_SQL + f""",
cal AS (SELECT te.o_orderpriority, te.day, te.revenue, COALESCE(tr.revenue, stat.m) AS y_hat
        FROM te LEFT JOIN stat USING (o_orderpriority)
        LEFT JOIN tr ON tr.o_orderpriority = te.o_orderpriority AND tr.day + INTERVAL {PERIOD} DAY = te.day)
SELECT o_orderpriority, day, ROUND(revenue, 6) AS revenue, ROUND(y_hat, 6) AS y_hat FROM cal""")
def q_seasonal_calendar(spark, d):
    """W08 calendar option: the value 365 days earlier, else the train mean."""
    train, test = daily_split(spark, d)
    return round_doubles(FC.seasonal_naive(train, test, DAY_SPEC, "revenue", PERIOD, by="calendar").select(
        "o_orderpriority", "day", "revenue", "y_hat"))


BASE_METRICS_SQL = DAILY_SQL + """,
allp AS (SELECT 'persistence' AS model, revenue, y_hat FROM pers
         UNION ALL SELECT 'seasonal_naive', revenue, y_hat FROM seas),
met AS (SELECT model, COUNT(*) AS n, avg((revenue - y_hat) * (revenue - y_hat)) AS mse,
          avg(abs(revenue - y_hat)) AS mae, var_pop(revenue) AS v
        FROM allp WHERE revenue IS NOT NULL AND y_hat IS NOT NULL GROUP BY model)"""


@query("baseline_metrics", BASE_METRICS_SQL + """
SELECT model, n, ROUND(mse, 4) AS mse, ROUND(sqrt(mse), 4) AS rmse, ROUND(mae, 4) AS mae,
  ROUND(1 - mse / v, 6) AS r2 FROM met""")
def q_baseline_metrics(spark, d):
    """M04 + A21: baseline comparison table (persistence, seasonal naive)."""
    train, test = daily_split(spark, d)
    m = FC.run_baselines(train, test, DAY_SPEC, "revenue", features=[], period=PERIOD)
    return m.select("model", "n", rnd("mse", 4).alias("mse"), rnd("rmse", 4).alias("rmse"),
                    rnd("mae", 4).alias("mae"), rnd("r2").alias("r2"))


@query("model_compare", BASE_METRICS_SQL + """,
r AS (SELECT model, sqrt(mse) AS rmse, mae, 1 - mse / v AS r2 FROM met),
ref AS (SELECT rmse AS ref_rmse FROM r WHERE model = 'persistence')
SELECT model, ROUND(rmse, 4) AS rmse, CAST(rank() OVER (ORDER BY rmse) AS INTEGER) AS rank_rmse,
  ROUND((ref_rmse - rmse) / ref_rmse * 100.0, 6) AS improvement_pct,
  rmse = min(rmse) OVER () AS is_best, rmse = max(rmse) OVER () AS is_worst
FROM r, ref""")
def q_model_compare(spark, d):
    """W10, A31, P22, J10 over the baseline metric table."""
    train, test = daily_split(spark, d)
    m = FC.run_baselines(train, test, DAY_SPEC, "revenue", features=[], period=PERIOD)
    c = C.compare(m, "rmse", reference="persistence")
    return c.select("model", rnd("rmse", 4).alias("rmse"), "rank_rmse", rnd("improvement_pct").alias("improvement_pct"),
                    "is_best", "is_worst")


# --------------------------------------------------------------------- MLlib
@query("linear_fit", """SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, COUNT(*) AS n
FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL""")
def q_linear_fit(spark, d):
    """OLS of extended price on quantity (normal equations, distributed)."""
    li = read_table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    m = FC.fit_linear(li, ["l_quantity"], "l_extendedprice")
    n = li.dropna().agg(F.count(F.lit(1)).alias("n"))
    return n.select(rnd(F.lit(float(m.coefficients[0])), 4).alias("slope"),
                    rnd(F.lit(float(m.intercept)), 4).alias("intercept"), "n")


@query("linear_predict", """WITH tr AS (SELECT * FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-31 00:00:00'),
co AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
       FROM tr),
te AS (SELECT * FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-12-31 00:00:00'),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS y_hat FROM te, co)
SELECT COUNT(*) AS n, ROUND(sqrt(avg((y - y_hat) * (y - y_hat))), 4) AS rmse, ROUND(avg(abs(y - y_hat)), 4) AS mae
FROM p""")
def q_linear_predict(spark, d):
    """M01 fit on early ship dates, predicted on later ones, A21 on the result."""
    li = read_table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_shipdate")
    cut = F.to_timestamp_ntz(F.lit("1998-12-31 00:00:00"))
    train, test = li.where(F.col("l_shipdate") <= cut), li.where(F.col("l_shipdate") > cut)
    m = FC.fit_linear(train, ["l_quantity"], "l_extendedprice")
    p = FC.predict(m, train, test, ["l_quantity"])
    r = regression_metrics(p, "l_extendedprice", "y_hat")
    return r.select("n", rnd("rmse", 4).alias("rmse"), rnd("mae", 4).alias("mae"))


GBT_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("gbt_importance")
def q_gbt_importance(spark, d):
    """M02 + A36: boosted trees on lineitem, feature importances (rows-only check)."""
    li = read_table(spark, d, "lineitem").select(*GBT_FEATURES, "l_extendedprice")
    m = FC.fit_gbt(li, GBT_FEATURES, "l_extendedprice", max_iter=10, max_depth=4)
    return FC.importance(m, GBT_FEATURES, spark)


@query("scenario_benchmark")
def q_scenario_benchmark(spark, d):
    """Estimator × feature scenario → test metrics (rows-only check)."""
    li = read_table(spark, d, "lineitem").select(*GBT_FEATURES, "l_extendedprice", "l_shipdate")
    cut = F.to_timestamp_ntz(F.lit("1998-12-31 00:00:00"))
    train, test = li.where(F.col("l_shipdate") <= cut), li.where(F.col("l_shipdate") > cut)
    scenarios = {"RAW": ["l_quantity"], "ALL": GBT_FEATURES}
    return C.scenario_benchmark(train, test, scenarios, "l_extendedprice")
