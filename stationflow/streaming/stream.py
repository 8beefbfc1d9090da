"""Structured Streaming legs (S14–S17, P19–P21, T-S1–T-S8, A37).

Messages are JSON values with a string key. In production the source and
sink are Kafka (``format('kafka')``, earliest offsets, a checkpoint per
query); tests and the registered queries replay the same messages through
the file source (``format('text')`` over a folder of JSON lines), which is
the same DataFrame shape (one ``value`` string per message). Every query
runs with ``trigger(availableNow=True)`` so it drains what is there and
stops (T-S6); progress lives in the checkpoint (T-S4, exactly-once with the
file sink).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_messages(df: DataFrame, key: str, poison: Column | None = None, malformed: str = "") -> DataFrame:
    """NaN → null, envelope ``_timestamp`` (epoch s) and ``_index``,
    value = JSON with null fields kept, key = the row key as string. Rows where
    ``poison`` is true carry ``malformed`` as their value (T-S5)."""
    cols = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            cols.append(F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    env = F.struct(*cols, (F.unix_micros(F.current_timestamp()) / 1e6).alias("_timestamp"),
                   F.col(key).alias("_index"))
    value = F.to_json(env, {"ignoreNullFields": "false"})
    if poison is not None:
        value = F.when(poison, F.lit(malformed)).otherwise(value)
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value"))


def write_messages(messages: DataFrame, target: str, fmt: str = "files", **opts) -> None:
    """T-S3: publish a table as messages. ``fmt='kafka'`` writes key/value to
    a topic (``topic``, ``kafka.bootstrap.servers`` in ``opts``); ``'files'``
    writes one JSON value per line into ``target``."""
    if fmt == "kafka":
        w = messages.select("key", "value").write.format("kafka")
        for k, v in opts.items():
            w = w.option(k, v)
        w.option("topic", target).save()
    else:
        messages.select("value").write.mode("append").text(target)


def read_stream(spark: SparkSession, source: str, fmt: str = "files", max_per_trigger: int | None = None,
                **opts) -> DataFrame:
    """A streaming DataFrame with a ``value`` string column.
    ``fmt='kafka'``: ``source`` is the topic, earliest offsets (T27);
    ``'files'``: ``source`` is a folder of JSON lines. ``max_per_trigger``
    bounds each micro-batch (F09)."""
    if fmt == "kafka":
        r = (spark.readStream.format("kafka").option("subscribe", source)
             .option("startingOffsets", "earliest"))
        if max_per_trigger:
            r = r.option("maxOffsetsPerTrigger", max_per_trigger)
        for k, v in opts.items():
            r = r.option(k, v)
        return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"))
    r = spark.readStream.format("text")
    if max_per_trigger:
        r = r.option("maxFilesPerTrigger", max_per_trigger)
    return r.load(source)


def decode_messages(stream: DataFrame, schema: T.StructType | str, keep_raw: bool = False) -> DataFrame:
    """T-S1 + T-S5 + P21: parse with the explicit (fitted) schema: absent fields
    are NULL, extra keys are ignored; a message that does not parse gets
    ``_poison`` = true and NULL data (count it and go on). ``keep_raw`` keeps
    the message text for a dead-letter sink."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    d = stream.select(parsed.alias("data"), F.col("value"))
    poison = F.col("data").isNull() | ~F.col("value").startswith("{") | F.col("data._index").isNull()
    return d.select("data.*", poison.alias("_poison"), *(["value"] if keep_raw else []))


def run_with_dead_letter(decoded: DataFrame, build, sink: str, dead_letter: str, checkpoint: str):
    """T-S5 side output: each micro-batch writes its good rows, transformed by
    ``build(batch_df)``, to ``sink`` and the raw text of its poison messages to
    ``dead_letter``. Each batch goes to its own ``batch_id=`` folder with
    overwrite, so a retried batch replaces its own output (exactly-once
    effect with the checkpointed offsets)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        good = build(batch.where(~F.col("_poison")).drop("value"))
        good.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        bad = batch.where(F.col("_poison")).select("value")
        bad.write.mode("overwrite").text(f"{dead_letter}/batch_id={batch_id}")
    q = (decoded.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def progress_counters(query) -> dict:
    """Rows and rates of the last micro-batch plus observed counters."""
    p = query.lastProgress or {}
    c = (p.get("observedMetrics") or {}).get("counters") or {}
    c = c.asDict() if hasattr(c, "asDict") else dict(c)
    return {"input_rows": p.get("numInputRows"), "input_rows_per_sec": p.get("inputRowsPerSecond"),
            "processed_rows_per_sec": p.get("processedRowsPerSecond"), **c}


def linear_score(features: dict[str, float], intercept: float) -> Column:
    """Dot product of feature columns with fitted coefficients (literals)."""
    e = F.lit(float(intercept))
    for c, w in features.items():
        e = e + F.col(c) * F.lit(float(w))
    return e


def score_stream(stream: DataFrame, impute: dict[str, float], scale: dict[str, tuple[float, float]],
                 coef: dict[str, float], intercept: float, target: str | None = None) -> DataFrame:
    """T-S2 + P14 + P15 + P19: impute → scale → linear prediction → absolute
    error (NULL when the truth is absent). Stateless, so no watermark."""
    cols = {}
    for c in coef:
        x = F.coalesce(F.col(c), F.lit(float(impute[c])))
        m, s = scale[c]
        cols[c] = (x - F.lit(float(m))) / F.lit(float(s) if s else 1.0)
    d = stream.select("*", *[v.alias(f"{k}_scaled") for k, v in cols.items()])
    pred = linear_score({f"{k}_scaled": w for k, w in coef.items()}, intercept)
    d = d.select("*", pred.alias("prediction"))
    if target:
        d = d.select("*", F.abs(F.col("prediction") - F.col(target)).alias("abs_error"),
                     F.col(target).isNotNull().alias("has_actual"))
    return d


def alert_stream(stream: DataFrame, thresholds: DataFrame, station: str = "station_id",
                 value: str = "temperature") -> DataFrame:
    """T-S7: stream–static join with the per-station thresholds, then R05
    identification; append mode, stateless. The static side of a
    stream–static join is re-evaluated for every micro-batch, so the
    threshold table (an aggregate over the whole training table) is
    materialized once into the shared checkpoint folder first."""
    from stationflow.operators.rules import identify_event_columns
    from stationflow.session import materialize
    th = materialize(thresholds.select(station, "temp_p99", "temp_p95", "temp_p05", "temp_p01"))
    j = stream.join(th, station, "left")
    return j.select(*stream.columns, *identify_event_columns(F.col(value), F.col("temp_p99"), F.col("temp_p95"),
                                                             F.col("temp_p05"), F.col("temp_p01")))


def counters(stream: DataFrame, name: str = "counters") -> DataFrame:
    """Processed / predicted / poison counts per micro-batch as observed
    metrics (read from ``query.lastProgress['observedMetrics']``)."""
    return stream.observe(name, F.count(F.lit(1)).alias("processed"),
                          F.count_if(~F.col("_poison")).alias("decoded"),
                          F.count_if(F.col("_poison")).alias("errors"))


def run_available(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                  mode: str = "append"):
    """T-S6 + S17: drain the source once and stop; returns the finished query
    (``lastProgress`` carries rows/s and the observed counters)."""
    q = (stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .option("path", sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_with_ledger(stream: DataFrame, sink: str, ledger: str, checkpoint: str, after_write=None):
    """Writes every micro-batch once, whatever is replayed (S14, S16, T-S4).

    A batch goes to a folder of its own number, then its line (batch id, rows,
    time of writing) to the ledger. A query that stopped between the two, or
    before Spark recorded the batch, gets the same rows again and replaces that
    folder; a batch with a line in the ledger is not written again.
    :func:`read_committed` reads the batches in the ledger only. ``after_write``
    is called between both steps (tests stop there)."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        if _exists(spark, f"{ledger}/batch_id={batch_id}/_SUCCESS"):
            return
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        if after_write:
            after_write(batch_id)
        n = spark.read.parquet(f"{sink}/batch_id={batch_id}").groupBy().agg(F.count(F.lit(1)).alias("n_rows"))
        n.select("n_rows", F.current_timestamp().alias("written")).write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_committed(spark: SparkSession, sink: str, ledger: str) -> DataFrame:
    """The rows of the batches that the ledger holds, with their batch_id."""
    done = spark.read.parquet(ledger).select("batch_id")
    return spark.read.parquet(sink).join(F.broadcast(done), "batch_id", "left_semi")


def console_sink(stream: DataFrame):
    """Console sink (append), for interactive use."""
    return stream.writeStream.format("console").outputMode("append").start()


# ----------------------------------------------------------------- T-S8
ROLL_STATE = "values array<double>"


def rolling_state_fn(window: int, min_periods: int, order: tuple[str, ...], value: str, out: str):
    """Per-station buffer of the last ``window − 1`` values carried across
    micro-batches. A group larger than an Arrow batch comes in several chunks in
    any order: all are gathered and sorted before the rolling mean runs over the
    buffer and the batch."""
    import pandas as pd

    def fn(key, pdfs, state):
        buf = [float("nan") if v is None else v for v in state.get[0]] if state.exists else []
        pdf = pd.concat(list(pdfs)).sort_values(list(order), kind="stable")
        vals = pd.concat([pd.Series(buf, dtype="float64"), pdf[value].astype("float64")], ignore_index=True)
        means = vals.rolling(window, min_periods=max(1, min_periods)).mean().to_numpy()[len(buf):]
        tail = vals.to_numpy()[-(window - 1):] if window > 1 else []
        state.update(([None if v != v else float(v) for v in tail],))
        yield pdf.assign(**{out: means})
    return fn


def rolling_stream(stream: DataFrame, station: str, order: tuple[str, ...], value: str, schema: str,
                   window: int = 48, min_periods: int = 24, out: str = "temp_rolling_48h") -> DataFrame:
    """T-S8: streaming 48-row mean (``applyInPandasWithState``). Rows arriving
    after later rows of the same station were already emitted are placed at
    the end of the buffer in arrival order (documented late-row rule)."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    return stream.groupBy(station).applyInPandasWithState(
        rolling_state_fn(window, min_periods, order, value, out), f"{schema}, {out} double", ROLL_STATE,
        "append", GroupStateTimeout.NoTimeout)
