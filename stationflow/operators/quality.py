"""Data-quality report (A01–A10, A29, A32–A34, A41, T24 filters).

Each report is one aggregate pass (partial aggregation map-side). Wide
reports (one statistic per column) are computed as one wide row and turned
long with ``unpivot``; nothing is looped per column with separate jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.operators.gram import correlation, cross_products
from stationflow.operators.joins import keyed_join
from stationflow.operators.thresholds import MAP_ROWS, with_quantiles
from stationflow.spec import SeriesSpec


def overview(df: DataFrame, spec: SeriesSpec, year: Column | None = None) -> DataFrame:
    """Rows, columns, first/last time, day span, sorted distinct years."""
    t = F.col(spec.time)
    y = year if year is not None else F.year(t)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                  F.min(t).alias("first_time"), F.max(t).alias("last_time"),
                  F.datediff(F.max(t), F.min(t)).alias("span_days"),
                  F.array_join(F.sort_array(F.collect_set(y)), ",").alias("years"))


def group_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """A02 + W11: count and % of all rows per group (share window over the
    aggregated groups, one row per group)."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return g.select("*", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"))


def null_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """NULL count and % for every column (one pass), long form."""
    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    long = wide.unpivot("_n", names, "column", "n_null")
    long = long.select("column", "n_null", (F.col("n_null") * 100.0 / F.col("_n")).alias("pct_null"))
    return long.where(F.col("n_null") > 0) if only_missing else long


def summary(df: DataFrame, cols: list[str], by: list[str] | None = None, map_rows: int = MAP_ROWS) -> DataFrame:
    """Count, mean, median, sample std, min, max, p25, p75 per
    column (long form), optionally per group."""
    by = by or []
    wide = None
    for c in cols:
        aggs = [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
        one = with_quantiles(df, by, c, {f"{c}__median": 0.5, f"{c}__p25": 0.25, f"{c}__p75": 0.75}, aggs, True, map_rows)
        wide = one if wide is None else keyed_join(wide, one, by)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                        F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__median").alias("median"),
                        F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"),
                        F.col(f"{c}__max").alias("max"), F.col(f"{c}__p25").alias("p25"),
                        F.col(f"{c}__p75").alias("p75")) for c in cols]
    return wide.select(*by, F.explode(F.array(*structs)).alias("s")).select(*by, "s.*")


def conditional_share(df: DataFrame, pred: Column, name: str) -> DataFrame:
    """Count and % of rows meeting a predicate."""
    return df.agg(F.count_if(pred).alias(f"{name}_count"),
                  (F.count_if(pred) * 100.0 / F.count(F.lit(1))).alias(f"{name}_pct"))


def counts_by(df: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """Rows per key (e.g. year), ordered at the sink only."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """A10: number of distinct values (exact)."""
    return df.agg(F.count_distinct(col).alias(f"n_distinct_{col}"))


def completeness(df: DataFrame) -> DataFrame:
    """1 − nulls / (rows · columns), in %."""
    names = df.columns
    nulls = sum((F.count_if(F.col(c).isNull()) for c in names), F.lit(0))
    return df.agg((F.lit(100.0) * (F.lit(1.0) - nulls / (F.count(F.lit(1)) * F.lit(len(names)))))
                  .alias("completeness_pct"))


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def histogram(df: DataFrame, col: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between min and max (last bin closed on the right).

    Bounds come from one aggregate row (a bounded scalar result); binning is
    then a projection and a grouped count."""
    by = by or []
    b = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:  # no value: no row, the same columns
        lo = hi = 0.0
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(col)
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    g = df.where(x.isNotNull()).groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")


def feature_corr(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson correlation of every column with the target (one pass), with
    |r| and a strength bucket."""
    long = cross_products(df, [*cols, target]).where(F.col("b") == target).where(F.col("a") != target)
    long = long.select(F.col("a").alias("feature"), correlation().alias("r"))
    a = F.abs(F.col("r"))
    return long.select("feature", "r", a.alias("abs_r"),
                       F.when(a >= 0.7, "strong").when(a >= 0.3, "moderate").when(a >= 0.1, "weak")
                       .otherwise("negligible").alias("strength"))


def outliers(df: DataFrame, cols: list[str], z: float = 3.0) -> DataFrame:
    """Count and % of rows with |z| > z per column; z from the population
    mean/std of the same rows (one stats row, then one counting pass)."""
    st = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    counts = []
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        if s is None or s == 0:
            counts.append(F.lit(0).cast("long").alias(c))
        else:
            counts.append(F.count_if(F.abs((F.col(c) - F.lit(m)) / F.lit(s)) > z).alias(c))
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *counts)
    long = wide.unpivot("_n", cols, "feature", "n_outliers")
    return long.select("feature", "n_outliers", (F.col("n_outliers") * 100.0 / F.col("_n")).alias("pct"))


def correlated_pairs(df: DataFrame, cols: list[str], threshold: float = 0.95) -> DataFrame:
    """Pairs of columns with |r| above the threshold, from one pass of
    cross-products; the pair grid is over column names, not rows."""
    long = cross_products(df, cols).where(F.col("a") != F.col("b")).select("a", "b", correlation().alias("r"))
    return long.where(F.abs("r") > threshold)


# Name patterns of engineered features (lags, rolling stats,
# cyclical encodings, interactions).
ENGINEERED = r"(_lag_\d+h|_(ma|std|min|max)_\d+h|_sin|_cos|_diff|_product|_ratio|_interaction|_approx)$"


def diagnosis(df: DataFrame, features: list[str], corr_threshold: float = 0.95, z: float = 3.0) -> DataFrame:
    """Rows per feature, share of engineered features, number of highly
    correlated feature pairs and % of |z| > z cells, as one row. Correlations,
    means and deviations are read from one table of cross-products."""
    import re

    n_eng = sum(1 for c in features if re.search(ENGINEERED, c))
    # means and deviations come from the same table as the correlations
    pairs = cross_products(df, features).withColumn("r", correlation()).collect()  # one row for each pair of columns
    high = sum(1 for p in pairs if p["a"] != p["b"] and p["r"] is not None and abs(p["r"]) > corr_threshold)
    zcount = []
    for p in pairs:
        if p["a"] == p["b"] and p["n"] and p["n"] * p["sxx"] > p["sx"] ** 2:
            mean = p["sx"] / p["n"]
            zcount.append(F.count_if(F.abs((F.col(p["a"]) - F.lit(mean)) / F.lit((p["sxx"] / p["n"] - mean * mean) ** 0.5)) > z))
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), F.lit(len(features)).alias("n_features"),
        (n / F.lit(len(features))).alias("rows_per_feature"),
        F.lit(n_eng / len(features)).alias("share_engineered"),
        F.lit(high).alias("n_high_corr_pairs"),
        (sum(zcount, F.lit(0)) * 100.0 / (n * F.lit(len(features)))).alias("outlier_cell_pct"))


# Configured quality settings, declared but never applied upstream.
QUALITY_BOUNDS = {"temperature": (-60.0, 60.0)}
MISSING_CODES = (9999, 99999, 999999)
OUTLIER_STD_THRESHOLD = 5.0


def bounds_filter(df: DataFrame, bounds: dict = QUALITY_BOUNDS) -> DataFrame:
    """Optional filter keeping rows whose present values lie in bounds."""
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        if c in df.columns:
            cond = cond & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return df.where(cond)
