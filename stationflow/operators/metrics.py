"""Evaluation metrics over scored tables.

All metrics are aggregates over ``(truth, prediction/score)`` columns, so
they run where the scores are (no collect). Cumulative sums over the score
order (AUC, ROC) avoid a single-partition window over rows: distinct scores
are pre-aggregated and dealt into ordered ranges by splitters from the data,
each range's offset comes from a prefix sum over the small table of range
totals, and the running sum inside a range is a window over that range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.operators.joins import keyed_join

# Ranges of an order are a square of these: without and with group keys.
SCORE_WIDTH, GROUP_WIDTH = 32, 8


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE, R² over rows with non-NULL truth and prediction."""
    by = by or []
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    err = F.col(y) - F.col(p)
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"),
                          F.avg(F.abs(err)).alias("mae"), F.var_pop(y).alias("_var"))
    return g.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                    (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_var"))).alias("r2"))


def mape(df: DataFrame, y: str, p: str, zero: str = "skip") -> Column:
    """A22 aggregate: mean |(y−p)/y|·100. ``zero='skip'`` ignores y = 0,
    ``'eps'`` adds 1e-10 to the denominator, ``'plain'`` is infinite
    if any y = 0 (NaN where the prediction is 0 too)."""
    yc, pc = F.col(y), F.col(p)
    if zero == "eps":
        r = F.abs((yc - pc) / (yc + F.lit(1e-10)))
    elif zero == "plain":
        at_zero = F.when(pc == 0, F.lit(float("nan"))).when(pc.isNotNull(), F.lit(float("inf")))
        r = F.when(yc == 0, at_zero).otherwise(F.abs(F.try_divide(yc - pc, yc)))
    else:
        r = F.abs(F.try_divide(yc - pc, F.when(yc != 0, yc)))
    return F.avg(r) * 100.0


def class_grid(spark: SparkSession, classes: list[int], y: str = "y", p: str = "y_hat") -> DataFrame:
    """The full K×K (truth, prediction) grid as a literal table."""
    return spark.createDataFrame([(a, b) for a in classes for b in classes], f"{y} int, {p} int")


def confusion(df: DataFrame, y: str, p: str, classes: list[int], by: list[str] | None = None) -> DataFrame:
    """Counts per (truth, prediction), zero cells kept for the class grid."""
    by = by or []
    counts = df.groupBy(*by, F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("y_hat")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = class_grid(df.sparkSession, classes)
    if by:
        # per-group grids: the group keys with the classes exploded twice
        cls = F.array(*[F.lit(c) for c in classes])
        grid = (counts.select(*by).distinct()
                .select(*by, F.explode(cls).alias("y"))
                .select(*by, "y", F.explode(cls).alias("y_hat")))
    g = grid.join(counts, [*by, "y", "y_hat"], "left")
    return g.select(*by, "y", "y_hat", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def prf(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A24 from A23 in one pass: each cell contributes its count to the truth
    class (support, true positives) and to the predicted class (predicted
    count); one aggregate gives the per-class rows, a window over those few
    rows gives macro / weighted / accuracy, emitted once per group. 0/0 → 0."""
    by = by or []
    y, yh, n = F.col("y"), F.col("y_hat"), F.col("n")
    zero = F.lit(0).cast("long")
    cells = F.array(F.struct(y.alias("cls"), n.alias("support"), F.when(y == yh, n).otherwise(zero).alias("tp"),
                             zero.alias("pred_n")),
                    F.struct(yh.alias("cls"), zero.alias("support"), zero.alias("tp"), n.alias("pred_n")))
    per = (conf.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
           .groupBy(*by, "cls").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                                    F.sum("pred_n").alias("pred_n")))
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("*", prec.alias("precision"), rec.alias("recall"))
    pr, rc = F.col("precision"), F.col("recall")
    per = per.select("*", F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0).alias("f1"))
    w = Window.partitionBy(*by)
    tot = F.sum("support").over(w)
    wcols = {
        "_mp": F.avg("precision").over(w), "_mr": F.avg("recall").over(w), "_mf": F.avg("f1").over(w),
        "_wp": F.sum(pr * F.col("support")).over(w) / tot, "_wr": F.sum(rc * F.col("support")).over(w) / tot,
        "_wf": F.sum(F.col("f1") * F.col("support")).over(w) / tot,
        "_acc": F.sum("tp").over(w) / tot, "_tot": tot,
        "_first": F.row_number().over(w.orderBy("cls")) == 1,
    }
    per = per.select("*", *[v.alias(k) for k, v in wcols.items()])

    def row(name, p, r, f, sup):
        return F.struct(name.alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        sup.alias("support"))
    c = F.col
    own = row(c("cls").cast("string"), pr, rc, c("f1"), c("support"))
    extra = [row(F.lit("macro"), c("_mp"), c("_mr"), c("_mf"), c("_tot")),
             row(F.lit("weighted"), c("_wp"), c("_wr"), c("_wf"), c("_tot")),
             row(F.lit("accuracy"), c("_acc"), c("_acc"), c("_acc"), c("_tot"))]
    rows = F.when(c("_first"), F.array(own, *extra)).otherwise(F.array(own))
    return per.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def _score_counts(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """Distinct scores with their positive/negative counts (partial aggregation)."""
    yc = F.col(y).cast("int")
    return (df.where(F.col(score).isNotNull() & yc.isNotNull())
            .groupBy(*by, F.col(score).cast("double").alias("s"))
            .agg(F.sum(F.when(yc == 1, 1).otherwise(0)).cast("long").alias("pos"),
                 F.sum(F.when(yc == 1, 0).otherwise(1)).cast("long").alias("neg")))


def _cuts(g: DataFrame, by: list[str], order: str, width: int) -> DataFrame:
    """Splitters of the distinct order values of each group, about equally many
    values apart (a mergeable quantile sketch): ``_tails``, ``width`` arrays of
    ``width`` ascending splitters, and ``_heads``, the first of each."""
    n = width * width
    at = [k / (n + 1) for k in range(1, n + 1)]
    cut = g.groupBy(*by).agg(F.percentile_approx(order, at, F.lit(8 * n)).alias("_cut"))
    tails = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.slice("_cut", i * width + 1, width))
    return cut.select(*by, tails.alias("_tails")).select("*", F.transform("_tails", lambda t: t[0]).alias("_heads"))


def cumulative(g: DataFrame, by: list[str], order: str, cols: list[str], descending: bool = False,
               width: int | None = None, totals: bool = False) -> DataFrame:
    """Adds ``cum_{c}`` = sum of ``c`` over rows with order value ≤ (or ≥ when
    descending) the row's, within ``by``; exact. ``g`` holds one row per
    (by, order value).

    The values of each group are dealt into ``width``² + 1 ranges by splitters
    from a sketch of the data (as a sample sort does), so ranges are of like size
    wherever the values lie; a value finds its range in two steps of ``width``
    comparisons. A prefix sum over the table of range totals gives each range
    its offset, and the running sum inside a range is a window over that range.
    NULL keys form a group of their own. ``totals`` adds ``tot_{c}``, the group
    total, carried on the range table."""
    width = width or (GROUP_WIDTH if by else SCORE_WIDTH)
    o = F.col(order)
    cut = _cuts(g, by, order, width)
    cut = cut.withColumnRenamed("_heads", "_h")
    if by:
        d = keyed_join(g, cut, by, "inner")
    else:
        # one row of splitters, joined on a key that is 0 for every row: in the
        # same plan (not a subquery), so that the exchange below is reused
        zero = lambda c: F.pmod(F.xxhash64(c), F.lit(1))
        cut = F.broadcast(cut.withColumn("_z", zero("_tails")))
        d = g.withColumn("_y", zero(o)).join(cut, F.col("_y") == F.col("_z"))
    head = F.size(F.filter("_h", lambda x: x < o))
    tail = F.size(F.filter(F.get("_tails", F.greatest(head - 1, F.lit(0))), lambda x: x < o))
    no = F.when(head == 0, 0).otherwise((head - 1) * width + tail)
    no = (F.lit(width * width) - no) if descending else no
    # one key column: joins and windows on it share a partitioning, and NULL keys are equal in it
    d = d.select(*g.columns, F.struct(*[F.col(c) for c in by], no.cast("int").alias("_b")).alias("_k"))
    tot = d.groupBy("_k").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wb = Window.partitionBy(*[F.col("_k")[c] for c in by])
    run = wb.orderBy(F.col("_k._b"))  # at most width² + 1 rows per group
    offs = tot.select(F.col("_k").alias("_r"), *[(F.sum(f"_t_{c}").over(run) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in cols],
                      *([F.sum(f"_t_{c}").over(wb).alias(f"tot_{c}") for c in cols] if totals else []))
    j = d.join(offs, F.col("_k") == F.col("_r"))
    wl = Window.partitionBy("_k").orderBy(o.desc() if descending else o.asc()).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*g.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(wl)).alias(f"cum_{c}") for c in cols],
                    *([f"tot_{c}" for c in cols] if totals else []))


def auc(df: DataFrame, y: str, score: str, by: list[str] | None = None, one_class: float | None = None) -> DataFrame:
    """Exact ROC-AUC with ties counted half (the average-rank formula).
    NULL when a group lacks a class (``one_class`` replaces it, A28 uses 0.0)."""
    by = by or []
    g = _score_counts(df, y, score, by)
    c = cumulative(g, by, "s", ["neg"])
    part = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg"))).alias("_u"),
                              F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    a = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    if one_class is not None:
        a = F.coalesce(a, F.lit(one_class))
    return part.select(*by, "n_pos", "n_neg", a.alias("auc"))


def auc_ovr(df: DataFrame, y: str, prob_cols: dict[int, str]) -> DataFrame:
    """One-vs-rest AUC per class and the macro mean (classes with one
    side empty are NULL and left out of the mean)."""
    arr = F.array(*[F.struct(F.lit(k).alias("cls"), F.col(c).cast("double").alias("score"),
                             (F.col(y) == k).cast("int").alias("yk")) for k, c in prob_cols.items()])
    long = df.select(F.explode(arr).alias("e")).select("e.cls", "e.score", "e.yk")
    per = auc(long, "yk", "score", ["cls"])
    macro = per.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("class"), "auc")
    return per.select(F.col("cls").cast("string").alias("class"), "auc").unionByName(macro)


def roc_points(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """One point per distinct score threshold (descending): fpr, tpr.
    Class totals ride on the table of range totals, so no extra pass and no window over all distinct scores."""
    by = by or []
    g = _score_counts(df, y, score, by)
    c = cumulative(g, by, "s", ["pos", "neg"], descending=True, totals=True)
    return c.select(*by, F.col("s").alias("threshold"),
                    F.try_divide(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"),
                    F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"))


def binary_station_metrics(df: DataFrame, station: str, y: str, p: str, cut: float = 0.5,
                           min_rows: int = 10) -> DataFrame:
    """Per-station accuracy, precision, recall, F1 (class 1) and AUC (0.0
    when one class only); stations with fewer than ``min_rows`` rows skipped."""
    yh = (F.col(p) > cut).cast("int")
    yc = F.col(y).cast("int")
    g = df.groupBy(station).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yc == yh).alias("_ok"),
        F.count_if((yc == 1) & (yh == 1)).alias("_tp"), F.count_if(yh == 1).alias("_pp"),
        F.count_if(yc == 1).alias("_ap")).where(F.col("n") >= min_rows)
    prec = F.when(F.col("_pp") > 0, F.col("_tp") / F.col("_pp")).otherwise(0.0)
    rec = F.when(F.col("_ap") > 0, F.col("_tp") / F.col("_ap")).otherwise(0.0)
    m = g.select(station, "n", (F.col("_ok") / F.col("n")).alias("accuracy"), prec.alias("precision"),
                 rec.alias("recall"))
    m = m.select("*", F.when(F.col("precision") + F.col("recall") > 0,
                             2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                 .otherwise(0.0).alias("f1"))
    a = auc(df, y, p, [station], one_class=0.0).select(station, "auc")
    return keyed_join(m, a, [station])


EPS = 1e-7


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(EPS)), F.lit(1.0 - EPS))


def focal_loss_binary(df: DataFrame, y: str, p: str, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """A35 binary focal loss (mean): α_t = α if y = 1 else 1 − α."""
    pc = _clip(F.col(p))
    pt = F.when(F.col(y) == 1, pc).otherwise(F.lit(1.0) - pc)
    at = F.when(F.col(y) == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return F.avg(at * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * -F.ln(pt))


def focal_loss_categorical(y: str, probs: str, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """A35 categorical focal loss (mean) with p_t = probability of the true class."""
    pt = _clip(F.get(F.col(probs), F.col(y).cast("int")))
    return F.avg(F.lit(alpha) * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * -F.ln(pt))


def weighted_ce(y: str, probs: str, weights: dict[int, float]) -> Column:
    """A35 class-weighted cross-entropy (mean of w_y · −ln p_y)."""
    w = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
    py = _clip(F.get(F.col(probs), F.col(y).cast("int")))
    return F.avg(w[F.col(y).cast("int")] * -F.ln(py))


def check_targets(metrics: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Metric ≥ target → pass flag per requirement, and all() of them."""
    cols = [(F.col(m) >= F.lit(t)).alias(f"{m}_ok") for m, t in targets.items()]
    out = metrics.select("*", *cols)
    return out.select("*", F.coalesce(F.reduce(F.array(*[F.col(f"{m}_ok") for m in targets]), F.lit(True),
                                               lambda a, b: a & b), F.lit(False)).alias("all_ok"))


def check_targets_long(values: DataFrame, targets: dict[str, float], spark: SparkSession) -> DataFrame:
    """A38 long form: (metric, value) rows against a target table → ok per
    metric plus an 'ALL' row (bool_and). The target table is a literal of
    fixed size, broadcast."""
    tg = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "metric string, target double")
    chk = values.join(F.broadcast(tg), "metric").select(
        "metric", F.col("value").cast("double").alias("value"), "target",
        F.coalesce(F.col("value") >= F.col("target"), F.lit(False)).alias("ok"))
    overall = chk.agg(F.bool_and("ok").alias("ok")).select(
        F.lit("ALL").alias("metric"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("double").alias("target"), "ok")
    return chk.unionByName(overall)
