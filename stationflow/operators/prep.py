"""Feature selection, imputation and scaling.

Fitting is one aggregate over the train rows giving a one-row parameter
table (an action, like an MLlib ``fit``). Applying reads that single row once
on the driver (a bounded scalar result: two numbers per column) and inlines
the values as literals, so the transform is plain column arithmetic inside
whole-stage codegen, with no join. The parameter row can be persisted with
``sources.sinks``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.operators.features import one_chunk
from stationflow.operators.joins import keyed_join
from stationflow.operators.thresholds import MAP_ROWS, exact_quantiles

NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")
# Calendar parts kept but never scaled.
CALENDAR_PARTS = ("year", "month", "day", "hour", "minute")


def numeric_features(df: DataFrame, target: str | None = "temperature",
                     exclude=CALENDAR_PARTS + ("station_id",)) -> list[str]:
    """Numeric columns minus target, calendar parts and keys."""
    return [c for c, t in df.dtypes
            if t in NUMERIC_TYPES and c != target and c not in exclude]


def categorical_features(df: DataFrame) -> list[str]:
    """String columns."""
    return [c for c, t in df.dtypes if t == "string"]


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The allow-listed columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def strategic_features(df: DataFrame, raw: list[str], max_lag: int = 6) -> list[str]:
    """Raw + calendar + cyclical + lag columns whose lag is ≤ ``max_lag``
    (the integer is parsed, T20), numeric only."""
    num = {c for c, t in df.dtypes if t in NUMERIC_TYPES}
    out = []
    for c in df.columns:
        if c not in num:
            continue
        m = re.search(r"_lag_(\d+)h$", c)
        if c in raw or c in CALENDAR_PARTS or c.endswith(("_sin", "_cos")) or (m and int(m.group(1)) <= max_lag):
            out.append(c)
    return out


def fit_impute(train: DataFrame, cols: list[str], strategy: str = "median", map_rows: int = MAP_ROWS) -> DataFrame:
    """One-row table ``median_{c}`` (exact) or ``mean_{c}`` per column. Beyond
    ``map_rows`` planned rows medians come from counts in ranges, without value maps."""
    if strategy == "median" and cols and not one_chunk(train, map_rows):
        rows = [exact_quantiles(train, [], c, {f"median_{c}": 0.5}) for c in cols]
        return reduce(lambda a, b: keyed_join(a, b, []), rows)
    if strategy == "median":
        return train.agg(*[F.percentile(c, 0.5).alias(f"median_{c}") for c in cols])
    return train.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def param_values(params) -> dict:
    """The one-row parameter table as a dict (DataFrame, Row or dict)."""
    if isinstance(params, DataFrame):
        params = params.first()
    return params.asDict() if hasattr(params, "asDict") else dict(params)


def apply_impute(df: DataFrame, params, cols: list[str], strategy: str = "median") -> DataFrame:
    """NULL → fitted value (train statistic, T18)."""
    v = param_values(params)
    out = [F.coalesce(F.col(c), F.lit(v[f"{strategy}_{c}"]).cast("double")).alias(c) if c in cols
           else F.col(c) for c in df.columns]
    return df.select(*out)


def fit_scale(train: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std per column (after imputation)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return train.agg(*aggs)


def apply_scale(df: DataFrame, params, cols: list[str]) -> DataFrame:
    """(x − mean) / std, with std 0 (or undefined) treated as 1."""
    v = param_values(params)
    out = []
    for c in df.columns:
        if c in cols:
            sd = v[f"std_{c}"]
            sd = 1.0 if sd is None or sd == 0 else sd
            out.append(((F.col(c) - F.lit(v[f"mean_{c}"])) / F.lit(sd)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fit_transform(df_split: DataFrame, cols: list[str], split: str = "split",
                  materialize_input: bool = False) -> DataFrame:
    """The whole prep chain once (T19): impute with train medians, then
    scale with train mean/std of the imputed values; every split transformed.
    ``materialize_input`` checkpoints an expensive input (e.g. a window
    feature table) so the two fits and the transform read it once."""
    if materialize_input:
        from stationflow.session import materialize
        df_split = materialize(df_split)
    train = df_split.where(F.col(split) == "train")
    med = fit_impute(train, cols)
    imputed = apply_impute(df_split, med, cols)
    sc = fit_scale(imputed.where(F.col(split) == "train"), cols)
    return apply_scale(imputed, sc, cols)


def select_features(df: DataFrame, scenario: str, target: str = "temperature", raw: list[str] | None = None,
                    top: int = 30, exclude=CALENDAR_PARTS + ("station_id",)) -> list[str]:
    """M03 feature scenarios: ``ALL`` numeric features, ``RAW`` the present
    raw columns, ``RAW+LAG`` raw plus every lag column, ``TOP30`` the ``top``
    features with the largest |correlation| with the target (one aggregate;
    only the ranked feature names reach the driver)."""
    allf = numeric_features(df, target, exclude)
    raw = [c for c in (raw or []) if c in allf]
    if scenario == "ALL":
        return allf
    if scenario == "RAW":
        return raw
    if scenario == "RAW+LAG":
        return raw + [c for c in allf if re.search(r"_lag_\d+h$", c) and c not in raw]
    if scenario.startswith("TOP"):
        from stationflow.operators.quality import feature_corr
        if scenario[3:].isdigit():
            top = int(scenario[3:])
        ranked = (feature_corr(df, allf, target).where(F.col("abs_r").isNotNull())
                  .orderBy(F.col("abs_r").desc(), "feature").limit(top).collect())
        return [r["feature"] for r in ranked]
    raise ValueError(scenario)
