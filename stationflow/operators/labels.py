"""Event labelling and class statistics.

Labels are ``when`` chains over the row and its station's thresholds (J02);
class statistics are small aggregates whose shares use a window over the
already aggregated counts (a handful of rows per group), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.operators.thresholds import with_thresholds
from stationflow.spec import SeriesSpec

# Class names of the 5-class adaptive scheme.
ADAPTIVE_CLASSES = {0: "Normal", 1: "Canicule_Extreme", 2: "Forte_Chaleur",
                    3: "Froid_Extreme", 4: "Froid_Prolonge"}
# Class names of the binary and the 3-class rolling schemes.
BINARY_CLASSES = {0: "Normal", 1: "Evenement_Extreme"}
ROLLING_CLASSES = {0: "Normal", 1: "Canicule", 2: "Froid_Prolonge"}


def adaptive_label(t: Column, p99: Column, p95: Column, p05: Column, p01: Column) -> Column:
    """R01 expression. Assignments are applied in order 1,2,3,4 with the later one
    winning, so the chain tests them in reverse; NULL temperature or thresholds → 0."""
    return (F.when((t >= p01) & (t < p05), 4)
            .when(t < p01, 3)
            .when((t > p95) & (t <= p99), 2)
            .when(t > p99, 1)
            .otherwise(0))


def label_adaptive(df: DataFrame, th: DataFrame, station: str = "station_id",
                   value: str = "temperature", out: str = "extreme_event") -> DataFrame:
    """R01 + J02: 5-class label against per-station percentiles; unmatched → 0."""
    j = with_thresholds(df, th.select(station, "temp_p99", "temp_p95", "temp_p05", "temp_p01"),
                        station)
    lab = adaptive_label(F.col(value), F.col("temp_p99"), F.col("temp_p95"),
                         F.col("temp_p05"), F.col("temp_p01"))
    return j.select(*df.columns, lab.alias(out))


def label_binary(df: DataFrame, th: DataFrame, station: str = "station_id",
                 value: str = "temperature", low: str = "temp_p10", high: str = "temp_p90",
                 out: str = "is_extreme_event") -> DataFrame:
    """1 when t < low or t > high of the row's own station (T8: per row, by key)."""
    j = with_thresholds(df, th.select(station, F.col(low).alias("_lo"), F.col(high).alias("_hi")),
                        station)
    t = F.col(value)
    lab = F.when((t < F.col("_lo")) | (t > F.col("_hi")), 1).otherwise(0)
    return j.select(*df.columns, lab.alias(out))


def label_both(df: DataFrame, th: DataFrame, station: str = "station_id", value: str = "temperature",
               low: str = "temp_p10", high: str = "temp_p90") -> DataFrame:
    """R01 and R02 from one join with the thresholds (``extreme_event`` and
    ``is_extreme_event``)."""
    cols = ["temp_p99", "temp_p95", "temp_p05", "temp_p01", low, high]
    j = with_thresholds(df, th.select(station, *dict.fromkeys(cols)), station)
    t = F.col(value)
    five = adaptive_label(t, F.col("temp_p99"), F.col("temp_p95"), F.col("temp_p05"), F.col("temp_p01"))
    binary = F.when((t < F.col(low)) | (t > F.col(high)), 1).otherwise(0)
    return j.select(*df.columns, five.alias("extreme_event"), binary.alias("is_extreme_event"))


def rolling_mean_min_periods(value: str, w, window: int = 48, min_periods: int = 24) -> Column:
    """Mean over the last ``window`` rows (incl. current) of the ordered
    window ``w``, NULL until ``min_periods`` non-NULL values are in the frame."""
    fw = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(fw) >= min_periods, F.avg(value).over(fw))


def rolling_label(r: Column, hot: float = 28.0, cold: float = 2.0) -> Column:
    """R03 expression: ≥hot → 1, ≤cold → 2, else (incl. NULL) 0."""
    return F.when(r >= hot, 1).when(r <= cold, 2).otherwise(0)


def label_rolling(df: DataFrame, spec: SeriesSpec, value: str = "temperature",
                  hot: float = 28.0, cold: float = 2.0, window: int = 48,
                  min_periods: int = 24, hot_point: float = 30.0,
                  cold_point: float = 0.0) -> DataFrame:
    """R03 + W03 + P13 in the windowed (chunked, skew-proof) form."""
    from stationflow.operators.features import windowed

    out = windowed(df, spec, lambda w: [rolling_mean_min_periods(value, w, window, min_periods)
                                        .alias("temp_rolling_48h")], halo=window - 1)
    t = F.col(value)
    return out.select("*", rolling_label(F.col("temp_rolling_48h"), hot, cold).alias("extreme_event"),
                      F.coalesce(t >= hot_point, F.lit(False)).alias("is_hot"),
                      F.coalesce(t <= cold_point, F.lit(False)).alias("is_cold"))


def label_fixed(df: DataFrame, value: str = "temperature", hot: float = 33.0,
                cold: float = -5.0, out: str = "extreme_event") -> DataFrame:
    """Fixed thresholds t ≥ hot → 1, t ≤ cold → 2."""
    t = F.col(value)
    return df.select("*", F.when(t >= hot, 1).when(t <= cold, 2).otherwise(0).alias(out))


def decode_label(label: Column, names: dict[int, str]) -> Column:
    """Class id → name through a literal map (no join)."""
    m = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])
    return m[label]


def one_hot_label(label: Column, n_classes: int) -> Column:
    """array<double> indicator of the class."""
    return F.array(*[F.when(label == k, 1.0).otherwise(0.0) for k in range(n_classes)])


def threshold_class(p: Column, cut: float = 0.5) -> Column:
    """P18 binary: 1 when p > cut."""
    return F.when(p > cut, 1).otherwise(0)


def argmax_class(probs: Column) -> Column:
    """P18 multi-class: first index of the largest probability (0-based)."""
    return F.array_position(probs, F.array_max(probs)).cast("int") - 1


def class_rows(df: DataFrame, label: str, cls: int) -> DataFrame:
    """the rows of one class."""
    return df.where(F.col(label) == cls)


def class_distribution(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """A15 + W11: count and % per class (share of the group total by a window
    over the aggregated counts)."""
    by = by or []
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return counts.select("*", (F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights N / (K · n_c); K counts present classes only."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
                         .alias("weight"))


def imbalance(df: DataFrame, label: str, warn: float = 20.0, mandatory: float = 50.0) -> DataFrame:
    """max/min class count and the focal-loss flags."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    r = counts.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"),
                   F.max("n").alias("max_count"), F.min("n").alias("min_count"))
    return r.select("*", (F.col("imbalance_ratio") > warn).alias("use_focal"),
                    (F.col("imbalance_ratio") > mandatory).alias("focal_mandatory"))


def class_stats(df: DataFrame, label: str, value: str = "temperature") -> DataFrame:
    """Count, min, mean, max of the value per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min_value"),
                                 F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))
