"""Row-local derived variables (P07–P13, F02) as built-in Column expressions.

Nothing here shuffles: each function is a projection that stays inside
whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Magnus coefficients for relative humidity.
MAGNUS_A = 17.27
MAGNUS_B = 237.7

# Rothfusz heat-index polynomial (Fahrenheit), in term order
# c0 + c1*T + c2*R + c3*T*R + c4*T^2 + c5*R^2 + c6*T^2*R + c7*T*R^2 + c8*T^2*R^2.
ROTHFUSZ = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783,
            -0.05481717, 0.00122874, 0.00085282, -0.00000199)
HEAT_INDEX_MIN_C = 26.7

# Cyclical periods.
CYCLE_PERIODS = {"hour": 24.0, "day_of_week": 7.0, "day_of_year": 365.25, "month": 12.0}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_parts(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Integer year, month, day, hour, minute of the timestamp."""
    t = F.col(time)
    return df.select("*", F.year(t).alias("year"), F.month(t).alias("month"),
                     F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"),
                     F.minute(t).alias("minute"))


def cyclical_columns(time: str = "datetime") -> list[Column]:
    """sin/cos of hour/24, weekday(Mon=0)/7, dayofyear/365.25, month/12."""
    t = F.col(time)
    parts = {"hour": F.hour(t), "day_of_week": F.weekday(t),
             "day_of_year": F.dayofyear(t), "month": F.month(t)}
    out = []
    for name, x in parts.items():
        ang = F.lit(2 * math.pi) * x / F.lit(CYCLE_PERIODS[name])
        out += [F.sin(ang).alias(f"{name}_sin"), F.cos(ang).alias(f"{name}_cos")]
    return out


def cyclical(df: DataFrame, time: str = "datetime") -> DataFrame:
    return df.select("*", *cyclical_columns(time))


def _magnus(x: Column) -> Column:
    return F.lit(MAGNUS_A) * x / (F.lit(MAGNUS_B) + x)


def relative_humidity(t, td) -> Column:
    """clip(100·exp(g(td) − g(t)), 0, 100); NULL when either input is NULL."""
    t, td = _c(t), _c(td)
    rh = F.lit(100.0) * F.exp(_magnus(td) - _magnus(t))
    clipped = F.when(rh < 0, F.lit(0.0)).when(rh > 100, F.lit(100.0)).otherwise(rh)
    return F.when(t.isNull() | td.isNull(), F.lit(None).cast("double")).otherwise(clipped)


def heat_index(t, rh) -> Column:
    """P10: Rothfusz in °F, returned in °C; t itself when t < 26.7 or rh is NULL."""
    t, rh = _c(t), _c(rh)
    tf = t * F.lit(9.0 / 5.0) + F.lit(32.0)
    c = [F.lit(v) for v in ROTHFUSZ]
    hi = (c[0] + c[1] * tf + c[2] * rh + c[3] * tf * rh + c[4] * tf * tf + c[5] * rh * rh
          + c[6] * tf * tf * rh + c[7] * tf * rh * rh + c[8] * tf * tf * rh * rh)
    hi_c = (hi - F.lit(32.0)) * F.lit(5.0 / 9.0)
    return (F.when(t.isNull(), F.lit(None).cast("double"))
            .when((t < F.lit(HEAT_INDEX_MIN_C)) | rh.isNull(), t)
            .otherwise(hi_c))


def humidity_and_heat(df: DataFrame, t: str = "temperature", td: str = "dewpoint") -> DataFrame:
    rh = relative_humidity(t, td)
    return df.select("*", rh.alias("relative_humidity"),
                     heat_index(t, rh).alias("heat_index"))


def interaction_columns(t="temperature", td="dewpoint", slp="sea_level_pressure",
                        wind="wind_speed", hour="hour", month="month") -> list[Column]:
    """The six interaction features; division is NULL-safe (try_divide)."""
    t_, td_ = _c(t), _c(td)
    out = [(t_ - td_).alias("temp_dewpoint_diff"),
           (t_ * td_).alias("temp_dewpoint_product"),
           F.try_divide(t_, td_ + F.lit(273.15)).alias("temp_dewpoint_ratio")]
    if slp is not None:
        out.append((t_ * _c(slp)).alias("temp_pressure_product"))
    if hour is not None and month is not None:
        out.append((_c(hour) * _c(month)).alias("hour_month_interaction"))
    if wind is not None:
        out.append((t_ - F.lit(0.5) * F.sqrt(_c(wind))).alias("wind_chill_approx"))
    return out


def point_flags(df: DataFrame, t: str = "temperature", hot: float = 30.0,
                cold: float = 0.0) -> DataFrame:
    """is_hot (t ≥ hot), is_cold (t ≤ cold); never NULL."""
    return df.select("*",
                     F.coalesce(F.col(t) >= F.lit(hot), F.lit(False)).alias("is_hot"),
                     F.coalesce(F.col(t) <= F.lit(cold), F.lit(False)).alias("is_cold"))


def null_sentinels(df: DataFrame, codes: dict[str, list]) -> DataFrame:
    """values equal to a sentinel code become NULL."""
    cols = []
    for name in df.columns:
        if name in codes:
            cond = F.col(name).isin(*codes[name])
            cols.append(F.when(cond, F.lit(None)).otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column (NULL semantics inside)."""
    cols = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            cols.append(F.when(F.isnan(name), F.lit(None)).otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def one_hot(df: DataFrame, col: str, values: list, prefix: str | None = None) -> DataFrame:
    """One integer indicator column per listed value (``{prefix}_{value}``).

    The value list is a parameter (the dimension table of the series), so the
    plan is fixed without collecting the distinct values first.
    """
    p = prefix or col
    return df.select("*", *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).alias(f"{p}_{v}")
                            for v in values])


def one_hot_from_dim(df: DataFrame, col: str, dim: DataFrame, dim_col: str,
                     prefix: str | None = None, max_values: int = 1024) -> DataFrame:
    """P12 when the categories live in a (bounded) dimension table."""
    vals = [r[0] for r in dim.select(dim_col).distinct().orderBy(dim_col).limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"{dim_col} has more than {max_values} values; use StringIndexer + OneHotEncoder")
    return one_hot(df, col, vals, prefix)
