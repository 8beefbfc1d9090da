"""Registered report queries: fixed-band alert designs, the adaptive rule
catalogue join, probability-to-class, split summary, top-k report and the
model-type comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import compare as C
from stationflow.operators import forecast as FC
from stationflow.operators import labels as L
from stationflow.operators import rules as R
from stationflow.operators import topk as TK
from stationflow.plans.metric_queries import SCORED_SQL, scored
from stationflow.plans.model_queries import DAILY_SQL, DAY_SPEC, PERIOD, daily_split
from stationflow.plans.obs_queries import SPLIT_SQL, TH_SQL, obs_split
from stationflow.plans.registry import query, rnd, round_doubles
from stationflow.plans.rule_queries import RULE_SQL, identified
from stationflow.sources.sinks import split_summary
from stationflow.sources.tables import OBS_SQL, observations


def _case(rules, field, default):
    parts = []
    for i, r in sorted(enumerate(rules), key=lambda x: (-R.SEVERITY_ORDER[x[1]["severity"]], x[0])):
        cond = " AND ".join(f"temperature {op} {v}" for _, op, v in r["conditions"])
        parts.append(f"WHEN {cond} THEN '{r[field]}'")
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


@query("alerts_fixed_band", f"""WITH {OBS_SQL}
SELECT event_id, {_case(R.FIXED_BAND_RULES, 'event_type', 'NORMAL')} AS event_inferred,
  {_case(R.FIXED_BAND_RULES, 'severity', 'NORMAL')} AS severity_inferred,
  {_case(R.FIXED_BAND_RULES, 'alert_level', 'VERT')} AS alert_level_inferred,
  {_case(R.TWO_LEVEL_RULES, 'alert_level', 'none')} AS level_two_way
FROM obs""")
def q_alerts_fixed_band(spark, d):
    """Fixed-band severity on the reading itself (numeric level 3/2) and
    the two-level variant, both as compiled rule lists."""
    o = observations(spark, d).select("event_id", "temperature")
    a = R.infer_top(o, R.FIXED_BAND_RULES).select("event_id", "temperature", "event_inferred", "severity_inferred",
                                                 "alert_level_inferred")
    two = F.get(R.alerts_column(a, R.TWO_LEVEL_RULES), 0)["alert_level"]
    return a.select("event_id", "event_inferred", "severity_inferred", "alert_level_inferred",
                    F.coalesce(two, F.lit("none")).alias("level_two_way"))


ADAPT_SQL = "(VALUES " + ", ".join(
    f"('{r['id']}', '{r['name']}', {r['severity']}, {r['confidence']}, {len(r['recommendations'])})"
    for r in R.ADAPTIVE_RULES) + ") AS cat(id, name, severity, confidence, n_recs)"


@query("adaptive_rules", f"""WITH {OBS_SQL}, {TH_SQL},
i AS (SELECT {RULE_SQL} AS rule_id FROM obs o LEFT JOIN th USING (station_id))
SELECT i.rule_id, cat.name AS rule_name, cat.severity, CAST(cat.confidence AS DOUBLE) AS confidence,
  cat.n_recs AS n_recommendations, COUNT(*) AS n
FROM i JOIN {ADAPT_SQL} ON i.rule_id = cat.id GROUP BY ALL""")
def q_adaptive_rules(spark, d):
    """R06 + J05: identified rows joined to the R1–R4 catalogue (fixed size,
    broadcast), counted per rule."""
    cat = R.adaptive_rules_table(spark).select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"),
                                               "severity", "confidence",
                                               F.size("recommendations").alias("n_recommendations"))
    j = identified(spark, d).select("rule_id").join(F.broadcast(cat), "rule_id")
    return j.groupBy("rule_id", "rule_name", "severity", "confidence", "n_recommendations").agg(
        F.count(F.lit(1)).alias("n"))


@query("threshold_classes", SCORED_SQL + """,
pr AS (SELECT *, [1 - abs(p - 0.1), 1 - abs(p - 0.3), 1 - abs(p - 0.5), 1 - abs(p - 0.7), 1 - abs(p - 0.9)] AS probs
       FROM sc)
SELECT CAST(p > 0.5 AS INTEGER) AS class_binary,
  CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS class_argmax, COUNT(*) AS n FROM pr GROUP BY ALL""")
def q_threshold_classes(spark, d):
    """Class from a probability (p > 0.5) and argmax over class scores."""
    s = scored(spark, d)
    probs = F.array(*[F.lit(1.0) - F.abs(F.col("p") - F.lit(c)) for c in (0.1, 0.3, 0.5, 0.7, 0.9)])
    out = s.select(L.threshold_class(F.col("p")).alias("class_binary"), L.argmax_class(probs).alias("class_argmax"))
    return out.groupBy("class_binary", "class_argmax").agg(F.count(F.lit(1)).alias("n"))


FEATS = ["temperature", "dewpoint"]


@query("split_summary", f"""WITH {OBS_SQL}
SELECT split, COUNT(*) AS n_rows, 2 AS n_features, 'temperature,dewpoint' AS features
FROM (SELECT *, {SPLIT_SQL} AS split FROM obs) GROUP BY split""")
def q_split_summary(spark, d):
    """Rows per split and the feature catalogue of the saved splits."""
    return split_summary(obs_split(spark, d), FEATS)


@query("top_revenue_days", DAILY_SQL + """
SELECT o_orderpriority, day, ROUND(revenue, 6) AS revenue FROM s ORDER BY revenue DESC, o_orderpriority, day LIMIT 10""")
def q_top_revenue_days(spark, d):
    """Top-10 report of the daily series (distributed top-k; the
    limit is the feature)."""
    from stationflow.plans.model_queries import daily
    t = TK.head(daily(spark, d), [F.col("revenue").desc(), F.col("o_orderpriority"), F.col("day")], 10)
    return round_doubles(t)


@query("model_types", DAILY_SQL + f""",
dw AS (SELECT *, CAST(isodow(day) AS DOUBLE) AS dow FROM s),
co AS (SELECT regr_slope(revenue, dow) AS b, regr_intercept(revenue, dow) AS a FROM dw
       WHERE day <= TIMESTAMP '1999-12-31 00:00:00'),
lin AS (SELECT 'linear_regression' AS model, revenue, a + b * dow AS y_hat FROM dw, co
        WHERE day > TIMESTAMP '2000-12-31 00:00:00'),
allp AS (SELECT 'persistence' AS model, revenue, y_hat FROM pers
         UNION ALL SELECT 'seasonal_naive', revenue, y_hat FROM seas UNION ALL SELECT * FROM lin),
met AS (SELECT model, CASE WHEN model = 'linear_regression' THEN 'ml' ELSE 'baseline' END AS type,
          sqrt(avg((revenue - y_hat) * (revenue - y_hat))) AS rmse, avg(abs(revenue - y_hat)) AS mae
        FROM allp WHERE revenue IS NOT NULL AND y_hat IS NOT NULL GROUP BY model)
SELECT type, COUNT(*) AS n_models, ROUND(avg(rmse), 4) AS rmse_mean, ROUND(min(rmse), 4) AS rmse_min,
  ROUND(max(rmse), 4) AS rmse_max, ROUND(avg(mae), 4) AS mae_mean, ROUND(min(mae), 4) AS mae_min,
  ROUND(max(mae), 4) AS mae_max, arg_min(model, rmse) AS best_model FROM met GROUP BY type""")
def q_model_types(spark, d):
    """A30 + A31 + A40 + M04: baselines and a linear model on the day of week,
    summarised per model type with the best model of each type."""
    train, test = daily_split(spark, d)
    dow = F.dayofweek("day")  # Sunday=1 … Saturday=7
    iso = (F.pmod(dow + 5, F.lit(7)) + 1).cast("double")  # Monday=1 … Sunday=7
    train, test = train.withColumn("dow", iso), test.withColumn("dow", iso)
    m = FC.run_baselines(train, test, DAY_SPEC, "revenue", features=["dow"], period=PERIOD)
    m = C.nulls_to_zero(m, ["r2"]).withColumn(
        "type", F.when(F.col("model") == "linear_regression", "ml").otherwise("baseline"))
    g = C.by_type(m, "type", ["rmse", "mae"])
    best = m.groupBy("type").agg(F.min_by("model", "rmse").alias("best_model"))
    out = g.join(best, "type").select("type", "n_models", *[rnd(c, 4).alias(c) for c in
                                                            ["rmse_mean", "rmse_min", "rmse_max", "mae_mean",
                                                             "mae_min", "mae_max"]], "best_model")
    return out
