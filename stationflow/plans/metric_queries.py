"""Registered evaluation queries over a scored stand-in table.

Truth comes from the engine's own labels (R01 five classes, R02 binary);
the stand-in model output is arithmetic on another column (dew point / 100 as
a probability, its quintile as a class), so every metric is computed on data
that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import labels as L
from stationflow.operators import metrics as M
from stationflow.operators.features import lags
from stationflow.plans.obs_queries import LABEL5_SQL, SPLIT_SQL, TH_SQL, obs_split, train_thresholds
from stationflow.plans.registry import query, round_doubles
from stationflow.sources.tables import OBS_SQL
from stationflow.spec import OBS_SPEC

CLASSES = [0, 1, 2, 3, 4]


def scored(spark, d):
    """event_id, station_id, split, temperature, y5, yb, p, yhat5."""
    o = obs_split(spark, d)
    th = train_thresholds(spark, d)
    lab = L.label_both(o, th)
    return lab.select("event_id", "station_id", "split", "temperature",
                      F.col("extreme_event").alias("y5"), F.col("is_extreme_event").alias("yb"),
                      (F.col("dewpoint") / 100.0).alias("p"),
                      F.least(F.floor(F.col("dewpoint") / 20), F.lit(4)).cast("int").alias("yhat5"))


SCORED_SQL = f"""WITH {OBS_SQL}, {TH_SQL},
sc AS (SELECT o.event_id, o.station_id, {SPLIT_SQL.replace('datetime', 'o.datetime')} AS split, o.temperature,
  {LABEL5_SQL} AS y5,
  CASE WHEN o.temperature < th.temp_p10 OR o.temperature > th.temp_p90 THEN 1 ELSE 0 END AS yb,
  o.dewpoint / 100.0 AS p, CAST(LEAST(FLOOR(o.dewpoint / 20), 4) AS INTEGER) AS yhat5
  FROM obs o LEFT JOIN th USING (station_id))"""


def reg_scored(spark, d):
    """Regression stand-in: predict each reading by the previous one (lag 1)."""
    o = obs_split(spark, d)
    return lags(o, OBS_SPEC, ("temperature",), (1,)).withColumnRenamed("temperature_lag_1h", "y_hat")


REG_SQL = f"""WITH {OBS_SQL},
rs AS (SELECT *, {SPLIT_SQL} AS split,
  lag(temperature, 1) OVER (PARTITION BY station_id ORDER BY datetime, event_id) AS y_hat FROM obs),
ok AS (SELECT * FROM rs WHERE temperature IS NOT NULL AND y_hat IS NOT NULL)"""


@query("regression_metrics", REG_SQL + """
SELECT split, COUNT(*) AS n, ROUND(avg((temperature - y_hat) * (temperature - y_hat)), 6) AS mse,
  ROUND(sqrt(avg((temperature - y_hat) * (temperature - y_hat))), 6) AS rmse,
  ROUND(avg(abs(temperature - y_hat)), 6) AS mae,
  ROUND(1 - avg((temperature - y_hat) * (temperature - y_hat)) / var_pop(temperature), 6) AS r2
FROM ok GROUP BY split""")
def q_regression_metrics(spark, d):
    """A21 per split for the lag-1 forecast."""
    return round_doubles(M.regression_metrics(reg_scored(spark, d), "temperature", "y_hat", ["split"]))


@query("mape", REG_SQL + """
SELECT split, ROUND(avg(abs((temperature - y_hat) / temperature)) FILTER (WHERE temperature <> 0) * 100.0, 6)
  AS mape_skip, COUNT(*) FILTER (WHERE temperature = 0) AS n_zero_truth FROM ok GROUP BY split""")
def q_mape(spark, d):
    """A22 with the skip-zero policy, plus the count of zero truths."""
    r = reg_scored(spark, d).where(F.col("temperature").isNotNull() & F.col("y_hat").isNotNull())
    g = r.groupBy("split").agg(M.mape(r, "temperature", "y_hat", "skip").alias("mape_skip"),
                               F.count_if(F.col("temperature") == 0).alias("n_zero_truth"))
    return round_doubles(g)


@query("confusion", SCORED_SQL + """,
grid AS (SELECT a.y, b.y_hat FROM (VALUES (0), (1), (2), (3), (4)) a(y), (VALUES (0), (1), (2), (3), (4)) b(y_hat)),
cnt AS (SELECT y5 AS y, yhat5 AS y_hat, COUNT(*) AS n FROM sc GROUP BY ALL)
SELECT grid.y, grid.y_hat, COALESCE(cnt.n, 0) AS n FROM grid LEFT JOIN cnt USING (y, y_hat)""")
def q_confusion(spark, d):
    """A23 (5×5 grid, zero cells kept)."""
    return M.confusion(scored(spark, d), "y5", "yhat5", CLASSES)


@query("prf", SCORED_SQL + """,
grid AS (SELECT a.y, b.y_hat FROM (VALUES (0), (1), (2), (3), (4)) a(y), (VALUES (0), (1), (2), (3), (4)) b(y_hat)),
cnt AS (SELECT y5 AS y, yhat5 AS y_hat, COUNT(*) AS n FROM sc GROUP BY ALL),
cf AS (SELECT grid.y, grid.y_hat, COALESCE(cnt.n, 0) AS n FROM grid LEFT JOIN cnt USING (y, y_hat)),
per AS (SELECT c AS cls,
          SUM(n) FILTER (WHERE y = c AND y_hat = c) AS tp, SUM(n) FILTER (WHERE y_hat = c) AS pred_n,
          SUM(n) FILTER (WHERE y = c) AS support
        FROM cf, (VALUES (0), (1), (2), (3), (4)) k(c) GROUP BY c),
pr AS (SELECT cls, tp, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
        AS f1 FROM pr)
SELECT CAST(cls AS VARCHAR) AS class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
  ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro', ROUND(avg(precision), 6), ROUND(avg(recall), 6), ROUND(avg(f1), 6),
  CAST(SUM(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted', ROUND(SUM(precision * support) / SUM(support), 6),
  ROUND(SUM(recall * support) / SUM(support), 6), ROUND(SUM(f1 * support) / SUM(support), 6),
  CAST(SUM(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', ROUND(SUM(tp) / SUM(support), 6), ROUND(SUM(tp) / SUM(support), 6),
  ROUND(SUM(tp) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f""")
def q_prf(spark, d):
    """Per-class, macro, weighted and accuracy rows."""
    return round_doubles(M.prf(M.confusion(scored(spark, d), "y5", "yhat5", CLASSES)))


AUC_SQL = """g AS (SELECT s, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(1 - y) AS BIGINT) AS neg FROM src GROUP BY s),
c AS (SELECT *, SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM g)"""


@query("auc", SCORED_SQL + """, src AS (SELECT p AS s, yb AS y FROM sc), """ + AUC_SQL + """
SELECT CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg,
  ROUND(SUM(pos * (cum_neg - 0.5 * neg)) / (SUM(pos) * SUM(neg)), 6) AS auc FROM c""")
def q_auc(spark, d):
    """Exact binary AUC with tied scores."""
    return round_doubles(M.auc(scored(spark, d), "yb", "p"))



@query("auc_ovr", SCORED_SQL + """,
long AS (SELECT k.cls, 1 - abs(sc.p - (2 * k.cls + 1) / 10.0) AS s, CAST(sc.y5 = k.cls AS INTEGER) AS y
         FROM sc, (VALUES (0), (1), (2), (3), (4)) k(cls)),
g AS (SELECT cls, s, SUM(y) AS pos, SUM(1 - y) AS neg FROM long GROUP BY cls, s),
c AS (SELECT *, SUM(neg) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS cum_neg FROM g),
per AS (SELECT cls, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
          THEN SUM(pos * (cum_neg - 0.5 * neg)) / (SUM(pos) * SUM(neg)) END AS auc FROM c GROUP BY cls)
SELECT CAST(cls AS VARCHAR) AS class, ROUND(auc, 6) AS auc FROM per
UNION ALL SELECT 'macro', ROUND(avg(auc), 6) FROM per""")
def q_auc_ovr(spark, d):
    """One-vs-rest AUC per class and macro (class-k score = 1 − |p − (2k+1)/10|)."""
    s = scored(spark, d)
    s = s.select("y5", *[(F.lit(1.0) - F.abs(F.col("p") - F.lit((2 * k + 1) / 10.0))).alias(f"s{k}")
                         for k in CLASSES])
    return round_doubles(M.auc_ovr(s, "y5", {k: f"s{k}" for k in CLASSES}))


@query("roc_points", SCORED_SQL + """,
g AS (SELECT p AS s, SUM(yb) AS pos, SUM(1 - yb) AS neg FROM sc GROUP BY p),
c AS (SELECT *, SUM(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
        SUM(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
        SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM g)
SELECT ROUND(s, 6) AS threshold, ROUND(fp / N, 6) AS fpr, ROUND(tp / P, 6) AS tpr FROM c""")
def q_roc_points(spark, d):
    """One point per distinct threshold."""
    return round_doubles(M.roc_points(scored(spark, d), "yb", "p"))


@query("per_station_metrics", SCORED_SQL + """,
st AS (SELECT station_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE yb = CAST(p > 0.5 AS INTEGER)) AS ok,
         COUNT(*) FILTER (WHERE yb = 1 AND p > 0.5) AS tp, COUNT(*) FILTER (WHERE p > 0.5) AS pp,
         COUNT(*) FILTER (WHERE yb = 1) AS ap FROM sc GROUP BY station_id HAVING COUNT(*) >= 10),
m AS (SELECT station_id, n, ok / n AS accuracy, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
        CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS recall FROM st),
g AS (SELECT station_id, p AS s, SUM(yb) AS pos, SUM(1 - yb) AS neg FROM sc GROUP BY station_id, p),
c AS (SELECT *, SUM(neg) OVER (PARTITION BY station_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS cum_neg FROM g),
a AS (SELECT station_id, COALESCE(CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
        THEN SUM(pos * (cum_neg - 0.5 * neg)) / (SUM(pos) * SUM(neg)) END, 0.0) AS auc FROM c GROUP BY station_id)
SELECT m.station_id, m.n, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision,
  ROUND(recall, 6) AS recall,
  ROUND(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1,
  ROUND(a.auc, 6) AS auc FROM m LEFT JOIN a USING (station_id)""")
def q_per_station_metrics(spark, d):
    """Per-station binary metrics (cut 0.5), AUC 0.0 for one-class stations."""
    return round_doubles(M.binary_station_metrics(scored(spark, d), "station_id", "yb", "p"))


FOCAL_SQL = SCORED_SQL + """,
pr AS (SELECT *, [1 - abs(p - 0.1), 1 - abs(p - 0.3), 1 - abs(p - 0.5), 1 - abs(p - 0.7), 1 - abs(p - 0.9)] AS raw
       FROM sc),
pn AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS probs FROM pr),
cl AS (SELECT *, LEAST(GREATEST(p, 1e-7), 1 - 1e-7) AS pc,
         LEAST(GREATEST(probs[y5 + 1], 1e-7), 1 - 1e-7) AS py FROM pn),
cw AS (SELECT y5, COUNT(*) AS n FROM sc WHERE split = 'train' GROUP BY y5),
w AS (SELECT y5, SUM(n) OVER () / (COUNT(*) OVER () * n) AS weight FROM cw)"""


def _probs(s):
    raw = [F.lit(1.0) - F.abs(F.col("p") - F.lit(c)) for c in (0.1, 0.3, 0.5, 0.7, 0.9)]
    tot = raw[0] + raw[1] + raw[2] + raw[3] + raw[4]
    return s.select("*", F.array(*[r / tot for r in raw]).alias("probs"))


@query("focal_loss", FOCAL_SQL + """
SELECT ROUND(avg(CASE WHEN yb = 1 THEN 0.25 ELSE 0.75 END * pow(1 - CASE WHEN yb = 1 THEN pc ELSE 1 - pc END, 2)
                 * -ln(CASE WHEN yb = 1 THEN pc ELSE 1 - pc END)), 6) AS focal_binary,
  ROUND(avg(0.25 * pow(1 - py, 2) * -ln(py)), 6) AS focal_categorical,
  ROUND(avg(w.weight * -ln(py)), 6) AS weighted_ce
FROM cl LEFT JOIN w USING (y5)""")
def q_focal_loss(spark, d):
    """Binary and categorical focal loss and class-weighted cross-entropy
    (weights from A16 on train, joined by class)."""
    s = _probs(scored(spark, d))
    w = L.class_weights(s.where(F.col("split") == "train"), "y5").select("y5", "weight")
    j = s.join(w, "y5", "left")
    py = M._clip(F.get(F.col("probs"), F.col("y5")))
    out = j.agg(M.focal_loss_binary(j, "yb", "p").alias("focal_binary"),
                M.focal_loss_categorical("y5", "probs").alias("focal_categorical"),
                F.avg(F.col("weight") * -F.ln(py)).alias("weighted_ce"))
    return round_doubles(out)


# Requirement targets (macro F1, heat/cold recall, AUC).
TARGETS = {"f1_macro": 0.80, "recall_1": 0.90, "recall_3": 0.90, "auc": 0.85}


@query("requirement_checks", SCORED_SQL + """,
cnt AS (SELECT y5, yhat5, COUNT(*) AS n FROM sc GROUP BY ALL),
per AS (SELECT k.c AS cls, COALESCE(SUM(n) FILTER (WHERE y5 = k.c AND yhat5 = k.c), 0) AS tp,
          SUM(n) FILTER (WHERE yhat5 = k.c) AS pred_n, SUM(n) FILTER (WHERE y5 = k.c) AS support
        FROM cnt, (VALUES (0), (1), (2), (3), (4)) k(c) GROUP BY k.c),
pr AS (SELECT cls, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
        AS f1 FROM pr),
src AS (SELECT p AS s, yb AS y FROM sc), """ + AUC_SQL + """,
vals AS (SELECT 'f1_macro' AS metric, (SELECT avg(f1) FROM f) AS value
  UNION ALL SELECT 'recall_1', (SELECT recall FROM f WHERE cls = 1)
  UNION ALL SELECT 'recall_3', (SELECT recall FROM f WHERE cls = 3)
  UNION ALL SELECT 'auc', (SELECT SUM(pos * (cum_neg - 0.5 * neg)) / (SUM(pos) * SUM(neg)) FROM c)),
tg(metric, target) AS (VALUES ('f1_macro', 0.80), ('recall_1', 0.90), ('recall_3', 0.90), ('auc', 0.85)),
chk AS (SELECT vals.metric, vals.value, CAST(tg.target AS DOUBLE) AS target,
          COALESCE(vals.value >= tg.target, false) AS ok FROM vals JOIN tg USING (metric))
SELECT metric, ROUND(value, 6) AS value, target, ok FROM chk
UNION ALL SELECT 'ALL', NULL, NULL, bool_and(ok) FROM chk""")
def q_requirement_checks(spark, d):
    """Metric ≥ target per requirement and the overall verdict."""
    s = scored(spark, d)
    per = M.prf(M.confusion(s, "y5", "yhat5", CLASSES))
    f1m = per.where(F.col("class") == "macro").select(F.lit("f1_macro").alias("metric"), F.col("f1").alias("value"))
    r1 = per.where(F.col("class") == "1").select(F.lit("recall_1").alias("metric"), F.col("recall").alias("value"))
    r3 = per.where(F.col("class") == "3").select(F.lit("recall_3").alias("metric"), F.col("recall").alias("value"))
    a = M.auc(s, "yb", "p").select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    vals = f1m.unionByName(r1).unionByName(r3).unionByName(a)
    return round_doubles(M.check_targets_long(vals, TARGETS, spark))
