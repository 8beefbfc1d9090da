"""Registered query of band rules by interval index."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators.bands import band_alerts
from stationflow.plans.registry import query
from stationflow.sources.tables import OBS_SQL, observations

N_BANDS = 600  # overlapping bands over the degree range


@query("alerts_bands", f"""WITH {OBS_SQL},
b AS (SELECT CAST(i AS INTEGER) AS rule_no, CASE WHEN i % 50 = 7 THEN NULL ELSE i * 0.25 - 60.0 END AS lo, i % 3 <> 0 AS lo_inc,
        CASE WHEN i % 60 = 11 THEN NULL ELSE i * 0.25 - 60.0 + (i % 9) * 1.5 END AS hi, i % 2 = 0 AS hi_inc, CAST(i * 7 % 5 AS INTEGER) AS severity
      FROM range({N_BANDS}) t(i)),
m AS (SELECT o.event_id, b.rule_no, b.severity FROM obs o JOIN b ON (b.lo IS NULL OR o.temperature > b.lo OR (b.lo_inc AND o.temperature = b.lo))
        AND (b.hi IS NULL OR o.temperature < b.hi OR (b.hi_inc AND o.temperature = b.hi)) WHERE o.temperature IS NOT NULL),
a AS (SELECT event_id, string_agg(rule_no, ',' ORDER BY severity DESC, rule_no) AS alerts, COUNT(*) AS n FROM m GROUP BY event_id)
SELECT o.event_id, COALESCE(a.n, 0) AS n_alerts, COALESCE(a.alerts, '') AS alerts FROM obs o LEFT JOIN a USING (event_id)""")
def q_alerts_bands(spark, d):
    """J03 + R08 + O06: all alerts of each report out of 600 overlapping bands, worst first."""
    i = F.col("id").cast("int")
    lo = i * F.lit(0.25) - 60.0
    rules = spark.range(N_BANDS).select(
        i.alias("rule_no"), F.when(i % 50 != 7, lo).alias("lo"), (i % 3 != 0).alias("lo_inc"),
        F.when(i % 60 != 11, lo + (i % 9) * F.lit(1.5)).alias("hi"), (i % 2 == 0).alias("hi_inc"), (i * 7 % 5).cast("int").alias("severity"))
    a = band_alerts(observations(spark, d), ["event_id"], "temperature", rules)
    return a.select("event_id", F.size("alerts").cast("long").alias("n_alerts"),
                    F.array_join(F.transform("alerts", lambda x: x["rule_no"].cast("string")), ",").alias("alerts"))
