"""Registered streaming queries: the observation table is replayed as JSON
messages into the shared work folder, consumed by a Structured Streaming
query with ``availableNow``, and the sink is read back as the result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.operators import forecast as FC
from stationflow.operators import prep as P
from stationflow.operators.splits import split_predicate
from stationflow.plans.obs_queries import EV_TRAIN_END, EV_VAL_END, SPLIT_SQL, TH_SQL, obs_split, train_thresholds
from stationflow.plans.registry import query, rnd
from stationflow.plans.rule_queries import EVENT_SQL, LEVEL_SQL, RULE_SQL
from stationflow.session import work_path
from stationflow.sources.tables import OBS_SQL, observations
from stationflow.streaming import event_time as ET
from stationflow.streaming import stream as ST

MESSAGE_SCHEMA = T.StructType([
    T.StructField("station_id", T.LongType()), T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("dewpoint", T.DoubleType()), T.StructField("climate_zone", T.StringType()),
    T.StructField("_timestamp", T.DoubleType()), T.StructField("_index", T.LongType())])
# Fixed value: text of a malformed message (poison) injected by the replay.
POISON = '{"event_id": '
POISON_SQL = "(climate_zone = 'error' AND dewpoint >= 98)"


def replay(spark, d, folder: str):
    """T-S3: every observation as a message; rows matching the poison rule
    are replaced by a malformed value (T-S5)."""
    o = observations(spark, d)
    bad = (F.col("climate_zone") == "error") & (F.col("dewpoint") >= 98)
    ST.write_messages(ST.to_messages(o, "event_id", bad, POISON), folder)


def consume(spark, d, name: str):
    folder = work_path(spark, f"{name}-in")
    replay(spark, d, folder)
    stream = ST.decode_messages(ST.read_stream(spark, folder), MESSAGE_SCHEMA)
    return stream, work_path(spark, f"{name}-out"), work_path(spark, f"{name}-ckpt")


def fitted_model(spark, d):
    """Batch fit on train: median impute, population scale, OLS of the
    temperature on the scaled dew point."""
    is_train = split_predicate("datetime", "train", EV_TRAIN_END, EV_VAL_END)
    o = obs_split(spark, d)
    med = P.param_values(P.fit_impute(o.where(is_train), ["dewpoint"]))
    imputed = P.apply_impute(o, med, ["dewpoint"])
    sc = P.param_values(P.fit_scale(imputed.where(is_train), ["dewpoint"]))
    scaled = P.apply_scale(imputed, sc, ["dewpoint"]).withColumnRenamed("dewpoint", "dewpoint_scaled")
    m = FC.fit_linear(scaled.where(is_train), ["dewpoint_scaled"], "temperature")
    return (med["median_dewpoint"], (sc["mean_dewpoint"], sc["std_dewpoint"]), float(m.coefficients[0]),
            float(m.intercept))


@query("stream_score", f"""WITH {OBS_SQL},
sp AS (SELECT *, {SPLIT_SQL} AS split FROM obs),
med AS (SELECT median(dewpoint) AS md FROM sp WHERE split = 'train'),
imp AS (SELECT sp.*, COALESCE(dewpoint, md) AS dimp FROM sp, med),
sc AS (SELECT avg(dimp) AS m, stddev_pop(dimp) AS s FROM imp WHERE split = 'train'),
x AS (SELECT imp.*, (dimp - m) / s AS dewpoint_scaled FROM imp, sc),
co AS (SELECT regr_slope(temperature, dewpoint_scaled) AS b, regr_intercept(temperature, dewpoint_scaled) AS a
       FROM x WHERE split = 'train' AND temperature IS NOT NULL)
SELECT event_id, ROUND(dewpoint_scaled, 4) AS dewpoint_scaled, ROUND(a + dewpoint_scaled * b, 4) AS prediction,
  ROUND(abs(a + dewpoint_scaled * b - temperature), 4) AS abs_error, temperature IS NOT NULL AS has_actual
FROM x, co WHERE NOT {POISON_SQL}""")
def q_stream_score(spark, d):
    """T-S1–T-S6, P19–P21: stream of messages scored by the batch-fitted model."""
    med, (m, s), b, a = fitted_model(spark, d)
    stream, sink, ckpt = consume(spark, d, "score")
    good = ST.counters(stream).where(~F.col("_poison"))
    scored = ST.score_stream(good, {"dewpoint": med}, {"dewpoint": (m, s)}, {"dewpoint": b}, a, "temperature")
    ST.run_available(scored.select("event_id", "dewpoint_scaled", "prediction", "abs_error", "has_actual"),
                     sink, ckpt)
    out = spark.read.parquet(sink)
    return out.select("event_id", rnd("dewpoint_scaled", 4).alias("dewpoint_scaled"),
                      rnd("prediction", 4).alias("prediction"), rnd("abs_error", 4).alias("abs_error"), "has_actual")


@query("stream_alerts", f"""WITH {OBS_SQL}, {TH_SQL}
SELECT o.event_id, {EVENT_SQL} AS event_type, {LEVEL_SQL} AS alert_level, {RULE_SQL} AS rule_id
FROM obs o LEFT JOIN th USING (station_id) WHERE NOT (o.climate_zone = 'error' AND o.dewpoint >= 98)""")
def q_stream_alerts(spark, d):
    """T-S7: stream–static join with the train thresholds, R05 per message."""
    th = train_thresholds(spark, d)
    stream, sink, ckpt = consume(spark, d, "alerts")
    a = ST.alert_stream(stream.where(~F.col("_poison")), th)
    ST.run_available(a.select("event_id", "event_type", "alert_level", "rule_id"), sink, ckpt)
    return spark.read.parquet(sink)


@query("stream_rolling", f"""WITH {OBS_SQL},
r AS (SELECT *, CASE WHEN COUNT(temperature) OVER w >= 24 THEN avg(temperature) OVER w END AS temp_rolling_48h
      FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY datetime, event_id
                            ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT event_id, ROUND(temp_rolling_48h, 6) AS temp_rolling_48h FROM r""")
def q_stream_rolling(spark, d):
    """T-S8: the 48-row mean as a stateful streaming operator (per-station
    ring buffer in ``applyInPandasWithState``), equal to the batch W03."""
    folder = work_path(spark, "rolling-in")
    ST.write_messages(ST.to_messages(observations(spark, d), "event_id"), folder)
    stream = ST.decode_messages(ST.read_stream(spark, folder), MESSAGE_SCHEMA)
    rows = stream.select("station_id", "datetime", "event_id", "temperature")
    r = ST.rolling_stream(rows, "station_id", ("datetime", "event_id"), "temperature",
                          "station_id long, datetime timestamp_ntz, event_id long, temperature double")
    sink, ckpt = work_path(spark, "rolling-out"), work_path(spark, "rolling-ckpt")
    ST.run_available(r.select("event_id", "temp_rolling_48h"), sink, ckpt)
    return spark.read.parquet(sink).select("event_id", rnd("temp_rolling_48h").alias("temp_rolling_48h"))


@query("stream_ledger", f"""WITH {OBS_SQL} SELECT event_id, station_id, ROUND(temperature, 6) AS temperature FROM obs""")
def q_stream_ledger(spark, d):
    """S14 + S16 + T-S4: messages written in batches of one file, each batch once; the batches in the ledger, read back."""
    folder, sink, ledger, ckpt = (work_path(spark, f"ledger-{x}") for x in ("in", "out", "log", "ckpt"))
    ST.write_messages(ST.to_messages(observations(spark, d), "event_id"), folder)
    stream = ST.decode_messages(ST.read_stream(spark, folder, max_per_trigger=1), MESSAGE_SCHEMA)
    ST.run_with_ledger(stream.select("event_id", "station_id", "temperature"), sink, ledger, ckpt)
    back = ST.read_committed(spark, sink, ledger)
    return back.select("event_id", "station_id", rnd("temperature").alias("temperature"))


SECOND_SQL = "COALESCE(climate_zone = 'error', FALSE)"


@query("stream_event_time", f"""WITH {OBS_SQL},
b AS (SELECT station_id, max(datetime) AS released FROM obs
      WHERE NOT {SECOND_SQL} AND datetime <= (SELECT date_trunc('millisecond', max(datetime)) - INTERVAL 1 DAY FROM obs WHERE NOT {SECOND_SQL})
      GROUP BY station_id),
s AS (SELECT o.*, datetime IS NULL OR ({SECOND_SQL} AND COALESCE(datetime <= released, FALSE)) AS late
      FROM obs o LEFT JOIN b ON o.station_id IS NOT DISTINCT FROM b.station_id),
r AS (SELECT *, CASE WHEN COUNT(temperature) OVER w >= 24 THEN avg(temperature) OVER w END AS temp_rolling_48h FROM s
      WHERE NOT late AND datetime <= (SELECT date_trunc('millisecond', max(datetime)) - INTERVAL 1 DAY FROM obs)
      WINDOW w AS (PARTITION BY station_id ORDER BY datetime, event_id ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT event_id, late, ROUND(temp_rolling_48h, 6) AS temp_rolling_48h FROM r
UNION ALL SELECT event_id, late, CAST(NULL AS DOUBLE) FROM s WHERE late""")
def q_stream_event_time(spark, d):
    """T-S8 by event time: the messages of the zone ``error`` arrive after all others. Rows of a day wait for the
    watermark and come out in time order; late rows go to a folder of their own."""
    folder, sink, side, ckpt = (work_path(spark, f"event-time-{x}") for x in ("in", "out", "late", "ckpt"))
    o = observations(spark, d)
    second = F.coalesce(F.col("climate_zone") == "error", F.lit(False))
    for arrival in (~second, second):
        ST.write_messages(ST.to_messages(o.where(arrival), "event_id"), folder)
        stream = ST.decode_messages(ST.read_stream(spark, folder), MESSAGE_SCHEMA)
        rows = stream.select("station_id", "datetime", "event_id", "temperature")
        ET.run_split(ET.rolling_event_time(rows, "station_id", "datetime", ("event_id",), "temperature", "1 day"), "late", sink, side, ckpt)
    released, late = (spark.read.parquet(p).withColumn("late", F.lit(flag)) for p, flag in ((sink, False), (side, True)))
    return released.unionByName(late).select("event_id", "late", rnd("temp_rolling_48h").alias("temp_rolling_48h"))
