"""End-to-end jobs mirroring the reference's entry points, composed from the
library operators. Every step is lazy except the fits (one aggregate each)
and the writes; outputs go to the caller's (shared) folder.

E1 ``run_etl``: station files → decoded reports tagged with the station
dimension → derived variables → window features → chronological split →
train-fitted imputation and scaling → Parquet partitioned by split, plus
the parameter rows and the split summary.

E2 ``run_extremes``: feature table → train thresholds → labels (5-class,
binary, rolling) → class statistics and weights → rule alerts with
recommendations → Parquet / JSON artefacts.

E3 ``run_stream``: messages (files or Kafka) → decode with the fitted
feature schema → impute, scale and score with the parameters and the linear
model saved by ``run_etl`` → Parquet sink, ``availableNow``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.functions import derive as D
from stationflow.operators import features as FE
from stationflow.operators import labels as L
from stationflow.operators import prep as P
from stationflow.operators import rules as R
from stationflow.operators import splits as S
from stationflow.operators.thresholds import thresholds
from stationflow.session import materialize
from stationflow.sources import sinks as SK
from stationflow.sources.files import END_YEAR, START_YEAR, read_station_files, station_dim
from stationflow.spec import SeriesSpec

# reports are ordered by time, then by a hash of the raw line (deterministic tiebreak)
SPEC = SeriesSpec("station_id", "datetime", "report_id")


def build_features(obs: DataFrame, spec: SeriesSpec = SPEC, lags=FE.DEFAULT_LAGS,
                   windows=FE.DEFAULT_WINDOWS) -> DataFrame:
    """Derived variables, cyclical encodings, lags, rolling statistics and
    interactions in one pass over one window partitioning."""
    d = D.humidity_and_heat(obs)
    d = D.cyclical(d, spec.time)
    lag_vars = [c for c in FE.DEFAULT_LAG_VARS if c in d.columns]
    roll_vars = [c for c in FE.DEFAULT_ROLL_VARS if c in d.columns]
    d = FE.time_series_features(d, spec, lag_vars, lags, roll_vars, windows)
    slp = "sea_level_pressure" if "sea_level_pressure" in d.columns else None
    wind = "wind_speed" if "wind_speed" in d.columns else None
    return d.select("*", *D.interaction_columns("temperature", "dewpoint", slp, wind))


def run_etl(spark: SparkSession, raw_root: str, out_root: str, train_end: str = S.TRAIN_END,
            val_end: str = S.VAL_END, start_year: int = START_YEAR, end_year: int = END_YEAR,
            stations: DataFrame | None = None, lags=FE.DEFAULT_LAGS, windows=FE.DEFAULT_WINDOWS) -> dict:
    """E1. Returns the output paths and the list of missing station-years."""
    dim = stations if stations is not None else station_dim(spark)
    obs, missing = read_station_files(spark, raw_root, dim, start_year, end_year)
    feats = build_features(obs, SPEC, lags, windows)
    feats = materialize(S.chrono_split(feats, SPEC.time, train_end, val_end))
    cols = P.numeric_features(feats, target="temperature",
                              exclude=P.CALENDAR_PARTS + ("station_id", SPEC.tiebreak))
    train = feats.where(S.split_predicate(SPEC.time, "train", train_end, val_end))
    med = P.fit_impute(train, cols)
    imputed = P.apply_impute(feats, med, cols)
    sc = P.fit_scale(imputed.where(S.split_predicate(SPEC.time, "train", train_end, val_end)), cols)
    scaled = P.apply_scale(imputed, sc, cols)
    paths = {k: os.path.join(out_root, k) for k in ("features", "splits", "impute_params", "scale_params",
                                                   "split_summary", "missing", "model", "model_features")}
    SK.write_parquet(feats.drop("split"), paths["features"])
    SK.write_parquet(scaled, paths["splits"], ["split"])
    SK.save_params(med, paths["impute_params"])
    SK.save_params(sc, paths["scale_params"])
    SK.write_json(SK.split_summary(scaled, cols), paths["split_summary"])
    SK.write_csv(missing, paths["missing"])
    # the model uses the features that have a train median (a lag longer than
    # the train history is NULL everywhere and stays out)
    medians = P.param_values(med)
    usable = [c for c in cols if medians[f"median_{c}"] is not None]
    model_train = spark.read.parquet(paths["splits"]).where(F.col("split") == "train")
    from stationflow.operators.forecast import fit_linear
    fit_linear(model_train, usable, "temperature", solver="auto").write().overwrite().save(paths["model"])
    spark.createDataFrame([(",".join(usable),)], "features string").coalesce(1).write.mode("overwrite").json(
        paths["model_features"])
    return paths


def run_stream(spark: SparkSession, source: str, etl_root: str, out: str, checkpoint: str,
               fmt: str = "files", key: str = "report_id", **opts):
    """Score a message stream with the artefacts of ``run_etl``. Returns
    the finished streaming query (its progress carries the counters)."""
    from pyspark.ml.regression import LinearRegressionModel
    from pyspark.sql import types as T

    from stationflow.streaming import stream as ST

    cols = spark.read.json(os.path.join(etl_root, "model_features")).first()["features"].split(",")
    med = P.param_values(SK.load_params(spark, os.path.join(etl_root, "impute_params")))
    sc = P.param_values(SK.load_params(spark, os.path.join(etl_root, "scale_params")))
    model = LinearRegressionModel.load(os.path.join(etl_root, "model"))
    fields = [T.StructField(c, T.DoubleType()) for c in cols]
    schema = T.StructType([T.StructField(SPEC.station, T.StringType()), T.StructField(SPEC.time, T.TimestampNTZType()),
                           T.StructField(key, T.LongType()), T.StructField("temperature", T.DoubleType()),
                           *[f for f in fields if f.name != "temperature"],
                           T.StructField("_timestamp", T.DoubleType()), T.StructField("_index", T.LongType())])
    stream = ST.counters(ST.decode_messages(ST.read_stream(spark, source, fmt, **opts), schema))
    scored = ST.score_stream(stream.where(~F.col("_poison")),
                             {c: med[f"median_{c}"] for c in cols},
                             {c: (sc[f"mean_{c}"], sc[f"std_{c}"]) for c in cols},
                             dict(zip(cols, model.coefficients.toArray().tolist())), model.intercept,
                             "temperature")
    return ST.run_available(scored.select(SPEC.station, SPEC.time, key, "prediction", "abs_error", "has_actual"),
                            out, checkpoint)


def run_extremes(spark: SparkSession, features_path: str, out_root: str, train_end: str = S.TRAIN_END,
                 val_end: str = S.VAL_END, spec: SeriesSpec = SPEC) -> dict:
    """E2. Thresholds fitted on train; labels, class statistics and alerts for
    every row."""
    feats = spark.read.parquet(features_path)
    feats = S.chrono_split(feats, spec.time, train_end, val_end)
    train = feats.where(S.split_predicate(spec.time, "train", train_end, val_end))
    th = materialize(thresholds(train))
    rolled = L.label_rolling(feats, spec).withColumnRenamed("extreme_event", "extreme_event_rolling")
    lab = L.label_both(rolled, th)
    alerts = R.infer_top(lab)
    recs = R.recommend(alerts.where(F.col("rule_triggered") != "NONE")
                       .select(spec.station, spec.time, "event_inferred", "severity_inferred"),
                       spark, "event_inferred", "severity_inferred")
    paths = {k: os.path.join(out_root, k) for k in ("thresholds", "labeled", "class_distribution",
                                                   "class_weights", "alerts", "recommendations", "rules")}
    SK.write_json(SK.to_json_map(th, spec.station, [c for c in th.columns if c != spec.station]),
                  paths["thresholds"])
    SK.write_parquet(alerts, paths["labeled"], ["split"])
    SK.write_csv(L.class_distribution(lab, "extreme_event", ["split"]), paths["class_distribution"])
    SK.write_json(L.class_weights(lab.where(F.col("split") == "train"), "is_extreme_event"), paths["class_weights"])
    SK.write_csv(R.alert_stats(alerts, "event_inferred"), paths["alerts"])
    SK.write_json(recs.select(spec.station, spec.time, "event_inferred",
                              F.array_join("recommendations", " | ").alias("recommendations")),
                  paths["recommendations"])
    SK.write_json(R.rules_table(spark), paths["rules"])
    return paths


def main(argv: list[str] | None = None) -> None:
    """``spark-submit stationflow/jobs.py etl RAW OUT``, ``... extremes FEATURES OUT`` or
    ``... stream MESSAGES OUT --etl ETL_OUT [--checkpoint DIR]``.
    On a cluster the submitter's configuration wins; unset scale settings
    get the defaults of ``session.SCALE_CONF`` and ``spark.checkpoint.dir``
    must name a shared folder."""
    import argparse

    from stationflow.session import apply_scale_conf

    ap = argparse.ArgumentParser(prog="stationflow.jobs")
    ap.add_argument("job", choices=["etl", "extremes", "stream"])
    ap.add_argument("input")
    ap.add_argument("output")
    ap.add_argument("--train-end", default=S.TRAIN_END)
    ap.add_argument("--val-end", default=S.VAL_END)
    ap.add_argument("--etl", help="output folder of the etl job (stream)")
    ap.add_argument("--checkpoint", help="streaming checkpoint folder (default: under spark.checkpoint.dir)")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"stationflow-{a.job}").getOrCreate()
    apply_scale_conf(spark)
    if a.job == "etl":
        out = run_etl(spark, a.input, a.output, a.train_end, a.val_end)
    elif a.job == "extremes":
        out = run_extremes(spark, a.input, a.output, a.train_end, a.val_end)
    else:
        from stationflow.session import work_path
        q = run_stream(spark, a.input, a.etl, a.output, a.checkpoint or work_path(spark, "stream-ckpt"))
        from stationflow.streaming.stream import progress_counters
        out = {"sink": a.output, **{k: str(v) for k, v in progress_counters(q).items()}}
    for k, v in out.items():
        print(f"{k}\t{v}")


if __name__ == "__main__":
    main()
