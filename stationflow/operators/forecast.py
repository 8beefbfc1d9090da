"""Forecast baselines and MLlib regressors.

Baselines are joins and aggregates over keyed series; the regressors are
MLlib estimators on a ``VectorAssembler`` column, so fitting is distributed
(tree aggregation) and nothing is collected but the model.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.operators.features import row_index
from stationflow.operators.joins import keyed_join
from stationflow.operators.metrics import regression_metrics
from stationflow.spec import SeriesSpec


def persistence(train: DataFrame, test: DataFrame, spec: SeriesSpec, y: str,
                mode: str = "last_train") -> DataFrame:
    """``last_train`` predicts the last non-NULL train value of the
    station for every test row (max_by: combined map-side, no sort);
    ``lag1`` predicts the previous observed value."""
    if mode == "last_train":
        order = F.struct(*spec.order_cols())
        last = (train.where(F.col(y).isNotNull()).groupBy(spec.station)
                .agg(F.max_by(F.col(y), order).alias("y_hat")))
        return keyed_join(test, last, [spec.station])
    if mode == "lag1":
        from stationflow.operators.features import lags
        both = train.unionByName(test.select(*train.columns))
        out = lags(both, spec, (y,), (1,)).withColumnRenamed(f"{y}_lag_1h", "y_hat")
        keys = [spec.station, *spec.order_names()]
        return keyed_join(out, test.select(*keys), keys, "inner")
    raise ValueError(mode)


def seasonal_naive(train: DataFrame, test: DataFrame, spec: SeriesSpec, y: str, period: int = 365,
                   by: str = "rows") -> DataFrame:
    """W08 + J08. ``by='rows'``: test row i (0-based in its station) takes train
    row n − period + i; missing or out of range → the station's train mean.
    ``by='calendar'``: the value one ``period``-day interval earlier (equi-join
    on the shifted time), same fallback."""
    mean = train.groupBy(spec.station).agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    if by == "rows":
        tr = row_index(train, spec).select(spec.station, F.col("_rix").alias("_tix"), F.col(y).alias("_ty"))
        te = keyed_join(row_index(test, spec), mean, [spec.station])
        te = te.withColumn("_tix", F.col("_n") - period + F.col("_rix"))
        j = keyed_join(te, tr, [spec.station, "_tix"])
        out = j.withColumn("y_hat", F.coalesce(F.col("_ty"), F.col("_mean")))
        return out.drop("_tix", "_ty", "_mean", "_n", "_rix")
    if by == "calendar":
        tr = train.select(spec.station, (F.col(spec.time) + F.expr(f"INTERVAL {period} DAYS")).alias(spec.time),
                          F.col(y).alias("_ty"))
        j = keyed_join(keyed_join(test, mean, [spec.station]), tr.where(F.col(spec.time).isNotNull()), [spec.station, spec.time])
        return j.select(*test.columns, F.coalesce("_ty", "_mean").alias("y_hat"))
    raise ValueError(by)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def fill_with_train_mean(train: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """M01 prediction rule: NULL features take the train mean."""
    from stationflow.operators.prep import apply_impute, fit_impute
    return apply_impute(df, fit_impute(train, features, "mean"), features, "mean")


def fit_linear(train: DataFrame, features: list[str], y: str, solver: str = "normal"):
    """Ordinary least squares (normal equations, no regularisation) on
    complete rows. ``solver="auto"`` falls back to L-BFGS when the normal
    matrix is singular (collinear engineered features)."""
    from pyspark.ml.regression import LinearRegression
    d = assemble(train.dropna(subset=[*features, y]), features)
    return LinearRegression(featuresCol="features", labelCol=y, regParam=0.0, elasticNetParam=0.0,
                            solver=solver).fit(d)


# Rows of a boosting task: MLlib keeps each partition's rows as objects and reads
# them once per tree level, some 100 bytes a row.
GBT_TASK_ROWS = 1 << 20


def bounded_partitions(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """``df``, dealt anew where one of its partitions holds more than ``task_rows``
    rows (``GBT_TASK_ROWS``); files that pack rows densely otherwise give tasks of any size. One count
    per partition decides, and smaller tables stay as they are."""
    task_rows = task_rows or GBT_TASK_ROWS
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    most, n = sizes.agg(F.max("n"), F.sum("n")).first()
    return df if (most or 0) <= task_rows else df.repartition(-(-n // task_rows))


def fit_gbt(train: DataFrame, features: list[str], y: str, max_iter: int = 20, max_depth: int = 5,
            step_size: float = 0.1, subsample: float = 0.8, feature_subset: str = "auto", seed: int = 42):
    """Gradient-boosted trees (MLlib) on tasks of bounded rows."""
    from pyspark.ml.regression import GBTRegressor
    d = assemble(bounded_partitions(train.select(*features, y).dropna()), features)
    return GBTRegressor(featuresCol="features", labelCol=y, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step_size, subsamplingRate=subsample, featureSubsetStrategy=feature_subset,
                        seed=seed).fit(d)


# Bins of a feature of boosted trees (MLlib's default). Up to COUNTED distinct values
# are counted for them one by one, beyond that QUANTILES of all rows stand for them.
GBT_BINS, COUNTED, QUANTILES = 32, 4096, 1024


def split_points(values: list[tuple[float, float]], bins: int = GBT_BINS) -> list[float]:
    """MLlib's thresholds of a feature with these (value, weight) pairs: all midpoints of
    neighbours where they are fewer than ``bins``, else those closest to equal shares."""
    values = sorted(values)
    mids = [(a + b) / 2.0 for (a, _), (b, _) in zip(values, values[1:])]
    if len(mids) < bins:
        return mids
    share = sum(w for _, w in values) / bins
    out, seen, target = [], values[0][1], share
    for mid, (_, w) in zip(mids, values[1:]):
        before, seen = seen, seen + w
        if abs(before - target) < abs(seen - target):
            out.append(mid)
            target += share
    return out


def feature_splits(rows: DataFrame, features: list[str], distinct: dict[str, int]) -> dict[str, list[float]]:
    """The thresholds of each feature from all ``rows`` (MLlib alone takes them from a sample
    of 10,000). ``distinct``: about how many values each has."""
    few, many = [c for c in features if distinct[c] <= COUNTED], [c for c in features if distinct[c] > COUNTED]
    values: dict = {c: [] for c in features}
    if few:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in few])
        for r in rows.select(F.explode(pairs).alias("p")).groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n")).collect():
            values[r["c"]].append((r["v"], r["n"]))
    if many:
        grid = [i / QUANTILES for i in range(QUANTILES + 1)]
        r = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), grid, 10000).alias(c) for c in many]).first()
        values.update({c: list(Counter(r[c] or []).items()) for c in many})
    return {c: split_points(v) for c, v in values.items()}


def binned(df: DataFrame, features: list[str], splits: dict[str, list[float]], out: list[str]) -> DataFrame:
    """``df`` with the bin of each feature as ``out``: 1 + the number of its thresholds below
    the value. As in MLlib's trees a value at a threshold is below it, and NaN and NULL are above all."""
    from pyspark.ml.feature import Bucketizer
    inf = math.inf
    # Bucketizer takes a value at a bound to the upper side, so bounds are the next larger numbers
    bounds = [sorted({b for b in (math.nextafter(t, inf) for t in splits[c]) if b < inf} or {0.0}) for c in features]
    d = Bucketizer(inputCols=features, outputCols=out, splitsArray=[[-inf, *b, inf] for b in bounds], handleInvalid="keep").transform(df)
    # the sum sheds the column's metadata, by which trees would take the bins for categories
    return d.select(*df.columns, *[(F.col(c) + 1.0).alias(c) for c in out])


def fit_gbt_cells(rows: DataFrame, features: list[str], splits: dict[str, list[float]], y: str, max_iter: int = 20,
                  max_depth: int = 5, seed: int = 42):
    """M02 on complete ``rows``, all of them in every tree: boosted trees over the bins of
    the features (:func:`binned`).

    Rows with the same bins take the same way through every tree, and gains of squared
    errors differ by sums of residuals alone, so a row for each combination of bins, with
    its mean of ``y`` and its number of rows as weight, gives the trees that the rows
    give. The combinations are at most the product of the bins (32,768 for three
    features), and never more than the rows."""
    from pyspark.ml.regression import GBTRegressor

    from stationflow.session import materialize
    bins = [f"_bin_{i}" for i in range(len(features))]
    cells = materialize(binned(rows, features, splits, bins).groupBy(*bins).agg(F.avg(y).alias(y), F.count(F.lit(1)).cast("double").alias("_rows")))
    n = cells.count()
    cells = bounded_partitions(cells.coalesce(max(1, -(-n * 16 // GBT_TASK_ROWS))))
    # the bins are the thresholds already; so many are allowed that MLlib looks for them in all cells
    return GBTRegressor(featuresCol="features", labelCol=y, weightCol="_rows", maxIter=max_iter, maxDepth=max_depth, seed=seed,
                        maxBins=max(GBT_BINS, math.isqrt(n) + 1)).fit(assemble(cells, bins))


def predict(model, train: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    d = assemble(fill_with_train_mean(train, df, features), features)
    return model.transform(d).withColumnRenamed("prediction", "y_hat").drop("features")


def importance(model, features: list[str], spark) -> DataFrame:
    """Feature importances, one row per feature (order at the sink)."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def run_baselines(train: DataFrame, test: DataFrame, spec: SeriesSpec, y: str, features: list[str],
                  period: int = 365) -> DataFrame:
    """Fit → predict test → metrics, one row per model (unionByName).
    Train and test are read by every model, so both are materialized once
    (reliable checkpoint in the shared folder) instead of being recomputed
    from the sources per model."""
    from stationflow.session import materialize
    train, test = materialize(train), materialize(test)
    rows = []
    p = persistence(train, test, spec, y)
    rows.append(regression_metrics(p, y, "y_hat").select(F.lit("persistence").alias("model"), "*"))
    s = seasonal_naive(train, test, spec, y, period)
    rows.append(regression_metrics(s, y, "y_hat").select(F.lit("seasonal_naive").alias("model"), "*"))
    if features:
        m = fit_linear(train, features, y)
        lp = predict(m, train, test, features)
        rows.append(regression_metrics(lp, y, "y_hat").select(F.lit("linear_regression").alias("model"), "*"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
