"""Registered queries for event identification, rule inference and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import labels as L
from stationflow.operators import rules as R
from stationflow.plans.obs_queries import LABELED_SQL, ROLL48_SQL, TH_SQL, train_thresholds
from stationflow.plans.registry import query, rnd
from stationflow.sources.tables import OBS_SQL, observations
from stationflow.spec import OBS_SPEC

IDENT_SQL = """CASE WHEN o.temperature > th.temp_p99 THEN '{a}' WHEN o.temperature > th.temp_p95 THEN '{b}'
  WHEN o.temperature < th.temp_p01 THEN '{c}' WHEN o.temperature < th.temp_p05 THEN '{d}' ELSE '{e}' END"""
EVENT_SQL = IDENT_SQL.format(a="Canicule_Extreme", b="Forte_Chaleur", c="Froid_Extreme", d="Froid_Prolonge",
                             e="Normal")
LEVEL_SQL = IDENT_SQL.format(a="ROUGE", b="ORANGE", c="ROUGE", d="ORANGE", e="VERT")
RULE_SQL = IDENT_SQL.format(a="R1", b="R2", c="R3", d="R4", e="R0")


def identified(spark, d):
    return R.identify_event(observations(spark, d), train_thresholds(spark, d))


@query("alert_levels", f"""WITH {OBS_SQL}, {TH_SQL}
SELECT o.station_id, {LEVEL_SQL} AS alert_level, COUNT(*) AS n FROM obs o LEFT JOIN th USING (station_id)
GROUP BY ALL""")
def q_alert_levels(spark, d):
    """Flagship: A11 (train) → J02 → R05 → alert counts per station and level."""
    return identified(spark, d).groupBy("station_id", "alert_level").agg(F.count(F.lit(1)).alias("n"))


@query("identify_event", f"""WITH {OBS_SQL}, {TH_SQL}
SELECT o.event_id, {EVENT_SQL} AS event_type, {LEVEL_SQL} AS alert_level, {RULE_SQL} AS rule_id
FROM obs o LEFT JOIN th USING (station_id)""")
def q_identify_event(spark, d):
    """R05 per row."""
    return identified(spark, d).select("event_id", "event_type", "alert_level", "rule_id")


def rolled(spark, d):
    """Observations with the 48-row rolling mean the fixed-band rules read."""
    o = observations(spark, d)
    return L.label_rolling(o, OBS_SPEC).drop("extreme_event", "is_hot", "is_cold")


def _rule_case(field: str) -> str:
    parts = []
    for r in sorted(enumerate(R.CLIMATE_RULES), key=lambda x: (-R.SEVERITY_ORDER[x[1]["severity"]], x[0])):
        cond = " AND ".join(f"temp_rolling_48h {op} {v}" for _, op, v in r[1]["conditions"])
        val = r[1][field] if field != "name" else r[1]["name"]
        parts.append(f"WHEN {cond} THEN {val!r}" if isinstance(val, str) else f"WHEN {cond} THEN {val}")
    return "CASE " + " ".join(parts)


TOP_SQL = (ROLL48_SQL + f""",
t AS (SELECT station_id, datetime, event_id, temp_rolling_48h,
  {_rule_case('event_type')} ELSE 'NORMAL' END AS event_inferred,
  {_rule_case('severity')} ELSE 'NORMAL' END AS severity_inferred,
  {_rule_case('alert_level')} ELSE 'VERT' END AS alert_level_inferred,
  CAST({_rule_case('confidence')} ELSE 1.0 END AS DOUBLE) AS confidence_inferred,
  {_rule_case('name')} ELSE 'NONE' END AS rule_triggered FROM r)""")


def inferred(spark, d):
    return R.infer_top(rolled(spark, d))


@query("alerts_top", TOP_SQL + """
SELECT event_id, event_inferred, severity_inferred, alert_level_inferred, confidence_inferred, rule_triggered
FROM t""")
def q_alerts_top(spark, d):
    """Compiled rules on the 48-row mean, most severe alert per row."""
    return inferred(spark, d).select("event_id", "event_inferred", "severity_inferred",
                                     "alert_level_inferred", "confidence_inferred", "rule_triggered")


def _rules_values_sql() -> str:
    rows = []
    for i, r in enumerate(R.CLIMATE_RULES):
        lo = hi = "NULL"
        lo_inc = hi_inc = "true"
        for _, op, v in r["conditions"]:
            if op in (">", ">="):
                lo, lo_inc = str(v), "true" if op == ">=" else "false"
            else:
                hi, hi_inc = str(v), "true" if op == "<=" else "false"
        rows.append(f"({i}, '{r['name']}', '{r['event_type']}', '{r['severity']}', '{r['alert_level']}', "
                    f"{r['confidence']}, {R.SEVERITY_ORDER[r['severity']]}, {lo}, {lo_inc}, {hi}, {hi_inc})")
    return ("rules(rule_no, rule_name, event_type, severity, alert_level, confidence, severity_rank, lo, "
            "lo_inc, hi, hi_inc) AS (VALUES " + ", ".join(rows) + ")")


@query("alerts_all", ROLL48_SQL + f""", {_rules_values_sql()}
SELECT r.event_id, rules.rule_name, rules.event_type, rules.severity, rules.alert_level,
  CAST(rules.confidence AS DOUBLE) AS confidence
FROM r JOIN rules ON (rules.lo IS NULL OR (CASE WHEN rules.lo_inc THEN r.temp_rolling_48h >= rules.lo
                                               ELSE r.temp_rolling_48h > rules.lo END))
                 AND (rules.hi IS NULL OR (CASE WHEN rules.hi_inc THEN r.temp_rolling_48h <= rules.hi
                                               ELSE r.temp_rolling_48h < rules.hi END))
WHERE r.temp_rolling_48h IS NOT NULL""")
def q_alerts_all(spark, d):
    """R08 long form: every triggered rule per row (oracle: range join on the rule table)."""
    return R.explode_alerts(rolled(spark, d), ["event_id"]).select(
        "event_id", "rule_name", "event_type", "severity", "alert_level", "confidence")


@query("alert_stats", TOP_SQL + """
SELECT event_inferred, alert_level_inferred, COUNT(*) AS n FROM t GROUP BY ALL""")
def q_alert_stats(spark, d):
    """Alert counts by event and level."""
    return inferred(spark, d).groupBy("event_inferred", "alert_level_inferred").agg(
        F.count(F.lit(1)).alias("n"))


@query("active_alerts", TOP_SQL + """,
a AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC, event_id DESC) AS rn
      FROM t WHERE rule_triggered <> 'NONE')
SELECT station_id, datetime, event_id, event_inferred, severity_inferred, rule_triggered FROM a WHERE rn = 1""")
def q_active_alerts(spark, d):
    """Latest alert per station (aggregate form)."""
    a = inferred(spark, d).where(F.col("rule_triggered") != "NONE").select(
        "station_id", "datetime", "event_id", "event_inferred", "severity_inferred", "rule_triggered")
    return R.active_alerts(a, "station_id", "datetime", "event_id")


@query("alert_history", TOP_SQL + """
SELECT station_id, datetime, event_id, event_inferred, rule_triggered FROM t
WHERE rule_triggered <> 'NONE' AND datetime BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
  AND station_id IN (SELECT station_id FROM t WHERE rule_triggered <> 'NONE')""")
def q_alert_history(spark, d):
    """Alert history between two times, for every station with alerts
    (the per-station endpoint is ``rules.alert_history``)."""
    a = inferred(spark, d).where(F.col("rule_triggered") != "NONE")
    return a.where(F.col("datetime").between(F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")),
                                             F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))).select(
        "station_id", "datetime", "event_id", "event_inferred", "rule_triggered")


def _recs_sql() -> str:
    def arr(xs):
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    c_base, c_extra = R.RECOMMENDATIONS["CANICULE"]
    f_base, f_extra = R.RECOMMENDATIONS["VAGUE_FROID"]
    return f"""CASE WHEN event_inferred = 'CANICULE' THEN
      CASE WHEN severity_inferred IN ('SEVERE', 'EXTREME') THEN list_concat({arr(c_base)}, {arr(c_extra)})
           ELSE {arr(c_base)} END
    WHEN event_inferred = 'VAGUE_FROID' THEN
      CASE WHEN severity_inferred IN ('SEVERE', 'EXTREME') THEN list_concat({arr(f_base)}, {arr(f_extra)})
           ELSE {arr(f_base)} END
    ELSE ['{R.NO_RECOMMENDATION}'] END"""


@query("recommendations", TOP_SQL + f""",
rc AS (SELECT event_id, event_inferred, severity_inferred, {_recs_sql()} AS recs FROM t)
SELECT event_id, event_inferred, CAST(len(recs) AS INTEGER) AS n_recommendations, recs[1] AS first_recommendation,
  recs[len(recs)] AS last_recommendation FROM rc""")
def q_recommendations(spark, d):
    """R11 + J04 on every inferred alert (NORMAL rows get the no-concept message)."""
    t = inferred(spark, d).select("event_id", "event_inferred", "severity_inferred")
    r = R.recommend(t, spark, "event_inferred", "severity_inferred")
    return r.select("event_id", "event_inferred", F.size("recommendations").alias("n_recommendations"),
                    F.get("recommendations", 0).alias("first_recommendation"),
                    F.element_at("recommendations", -1).alias("last_recommendation"))


@query("alert_impacts", TOP_SQL + """,
imp(concept, impact) AS (VALUES """ + ", ".join(
    f"('{c[0].upper()}', '{i}')" for c in R.CONCEPTS for i in c[3]) + """)
SELECT t.event_inferred, imp.impact, COUNT(*) AS n FROM t
JOIN imp ON replace(t.event_inferred, '_', '') = imp.concept GROUP BY ALL""")
def q_alert_impacts(spark, d):
    """R15 + J04: alerts joined to the flattened ontology (impact edges), counted."""
    t = inferred(spark, d).select("event_inferred")
    edges = R.concept_edges(spark).where(F.col("kind") == "impacts").select(
        F.upper(F.regexp_replace("name", "_", "")).alias("_c"), F.col("target").alias("impact"))
    j = t.join(F.broadcast(edges), F.upper(F.regexp_replace("event_inferred", "_", "")) == F.col("_c"))
    return j.groupBy("event_inferred", "impact").agg(F.count(F.lit(1)).alias("n"))


CASCADE_SQL = f"""WITH {OBS_SQL}, {TH_SQL},
c AS (SELECT o.event_id, o.dewpoint / 100.0 AS p, {EVENT_SQL} AS ev, {LEVEL_SQL} AS lvl, {RULE_SQL} AS rid
      FROM obs o LEFT JOIN th USING (station_id))"""


@query("cascade_alerts", CASCADE_SQL + """
SELECT event_id, COALESCE(p > 0.5, false) AS detected, ROUND(p, 6) AS probability,
  CASE WHEN p > 0.5 THEN ev ELSE 'Normal' END AS event_type,
  CASE WHEN p > 0.5 THEN lvl ELSE 'VERT' END AS alert_level,
  CASE WHEN p > 0.5 THEN rid ELSE 'R0' END AS rule_id,
  CASE WHEN p > 0.5 AND rid IN ('R1', 'R3') THEN 5 WHEN p > 0.5 AND rid IN ('R2', 'R4') THEN 3 ELSE 0 END AS severity,
  CAST(CASE WHEN p > 0.5 AND rid IN ('R2', 'R4') THEN 0.95 ELSE 1.0 END AS DOUBLE) AS confidence
FROM c""")
def q_cascade_alerts(spark, d):
    """R13 over a scored table (score = dew point / 100, an arithmetic stand-in probability)."""
    scored = observations(spark, d).select("event_id", "station_id", "temperature",
                                           (F.col("dewpoint") / 100.0).alias("p"))
    c = R.cascade(scored, train_thresholds(spark, d))
    return c.select("event_id", "detected", rnd("probability").alias("probability"), "event_type",
                    "alert_level", "rule_id", "severity", "confidence")


@query("consensus", LABELED_SQL + """,
cz AS (SELECT event_id, extreme_event, CAST(LEAST(FLOOR(dewpoint / 20), 4) AS INTEGER) AS predicted FROM lab)
SELECT predicted, extreme_event, CASE WHEN predicted = extreme_event THEN 'HIGH_CONFIDENCE' ELSE 'REVIEW' END
  AS confidence_tag, COUNT(*) AS n FROM cz GROUP BY ALL""")
def q_consensus(spark, d):
    """Model class (stand-in: dew-point quintile) vs rule class."""
    from stationflow.plans.obs_queries import labeled
    lab = labeled(spark, d).select("event_id", "extreme_event",
                                   F.least(F.floor(F.col("dewpoint") / 20), F.lit(4)).cast("int").alias("predicted"))
    c = R.consensus(lab, "predicted", "extreme_event")
    return c.groupBy("predicted", "extreme_event", "confidence_tag").agg(F.count(F.lit(1)).alias("n"))
