"""Model-comparison tables.

Inputs are metric tables (one row per model), so the whole-table windows
below run over a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(metrics: DataFrame, col: str = "rmse", reference: str | None = None,
            model: str = "model") -> DataFrame:
    """W10 rank (1 = best, lower is better), A31 best/worst flags, P22/J10
    improvement % against the reference model's value."""
    w_all = Window.partitionBy()
    out = metrics.select("*", F.rank().over(Window.orderBy(col)).cast("int").alias(f"rank_{col}"),
                         (F.col(col) == F.min(col).over(w_all)).alias("is_best"),
                         (F.col(col) == F.max(col).over(w_all)).alias("is_worst"))
    if reference is not None:
        ref = F.max(F.when(F.col(model) == reference, F.col(col))).over(w_all)
        out = out.select("*", ((ref - F.col(col)) / ref * 100.0).alias("improvement_pct"))
    return out


def best(metrics: DataFrame, col: str, mode: str = "min", model: str = "model") -> DataFrame:
    """The arg-min / arg-max row as an aggregate (min_by / max_by)."""
    f = F.min_by if mode == "min" else F.max_by
    return metrics.agg(f(F.col(model), F.col(col)).alias(f"best_{model}"),
                       (F.min(col) if mode == "min" else F.max(col)).alias(col))


def by_type(metrics: DataFrame, type_col: str, cols: list[str], status: str | None = None) -> DataFrame:
    """mean/min/max of each measure per model type (+ counts by status)."""
    aggs = [F.count(F.lit(1)).alias("n_models")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    if status:
        aggs.append(F.count_if(F.col(status) == "OK").alias("n_ok"))
    return metrics.groupBy(type_col).agg(*aggs)


def efficiency(metrics: DataFrame, rmse: str = "rmse", minutes: str = "minutes") -> DataFrame:
    """(1 / RMSE) / (minutes + 1)."""
    return metrics.select("*", ((F.lit(1.0) / F.col(rmse)) / (F.col(minutes) + 1)).alias("efficiency"))


def nulls_to_zero(metrics: DataFrame, cols: list[str]) -> DataFrame:
    """NULL metric → 0 in comparison tables."""
    return metrics.fillna(0.0, subset=cols)


def scenario_benchmark(train: DataFrame, test: DataFrame, scenarios: dict[str, list[str]], y: str,
                       gbt_iter: int = 10) -> DataFrame:
    """(scenario = column subset) × (ridge, boosted trees) → test metrics.

    A scenario's complete train rows are read for their cross-products (ridge), the
    thresholds of the features, and the cells of their bins, on which the trees are
    fitted; the test rows are read once for all models."""
    from stationflow.operators.forecast import assemble, binned, feature_splits, fill_with_train_mean, fit_gbt_cells
    from stationflow.operators.gram import PLAIN, Gram
    from stationflow.operators.joins import keyed_join
    from stationflow.operators.metrics import regression_metrics

    every = list(dict.fromkeys(c for f in scenarios.values() for c in f))
    distinct = train.agg(*[F.approx_count_distinct(c).alias(c) for c in every]).first().asDict()
    scored = fill_with_train_mean(train, test.select(*every, y), every)
    names = []
    for k, (name, feats) in enumerate(scenarios.items()):
        rows = train.select(*feats, y).dropna()
        coef, base = Gram(rows, [*feats, y], PLAIN).ridge_scaled(feats, y, 1.0)
        ridge = sum((F.lit(b) * F.col(c) for b, c in zip(coef, feats)), F.lit(base))
        splits = feature_splits(rows, feats, distinct)
        gbt = fit_gbt_cells(rows, feats, splits, y, gbt_iter, 4, 42)
        bins = [f"_bin_{k}_{i}" for i in range(len(feats))]
        d = binned(scored.select("*", ridge.alias(f"_hat_{len(names)}")), feats, splits, bins)
        scored = gbt.setFeaturesCol(f"_bins_{k}").setPredictionCol(f"_hat_{len(names) + 1}").transform(assemble(d, bins, f"_bins_{k}"))
        scored = scored.drop(f"_bins_{k}", *bins)
        names += [f"ridge_{name}", f"gbt_{name}"]
    hats = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_hat_{i}").alias("y_hat")) for i, n in enumerate(names)])
    m = regression_metrics(scored.select(F.col(y).alias("y"), F.explode(hats).alias("p")).select("y", "p.*"), "y", "y_hat", ["name"])
    models = train.sparkSession.range(0, 1, 1, 1).select(F.explode(F.lit(names)).alias("name"))  # a row for each, without test rows too
    return keyed_join(models, m, ["name"]).select("name", "rmse", "mae", "r2")
