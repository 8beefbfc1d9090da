"""Training-sequence assembly.

A sequence row keeps its key (station, time) so predictions align with the
truth by an equi-join (J07) instead of by position. Sequences are built with
``collect_list`` over a ROWS frame in the chunked window of
``operators.features`` (halo = L rows), so no task holds a whole station.
Output size is L × features per row (an L-fold blow-up of the input); use
``stride`` and a narrow feature list at scale, and write the result in
partitions rather than collecting it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.operators.features import CHUNK_ROWS, windowed
from stationflow.operators.joins import keyed_join
from stationflow.spec import SeriesSpec


def sequences(df: DataFrame, spec: SeriesSpec, features: list[str], target: str, length: int,
              label: str = "next", stride: int = 1, drop_tail: bool = False,
              chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """W04/W05 (``label='next'``): x = rows [t−L, t−1], y = target at t.
    W06 (``label='last'``): x = rows [t−L+1, t], y = target at t;
    ``drop_tail=True`` also drops each station's final row (n − L sequences).

    Returns ``station, time, [tiebreak], x array<array<float>>, y``.
    """
    vec = F.array(*[F.col(c).cast("float") for c in features])
    if label == "next":
        lo, hi, halo = -length, -1, length
    elif label == "last":
        lo, hi, halo = -(length - 1), 0, length - 1
    else:
        raise ValueError(label)
    d = df.withColumn("_vec", vec)
    need_index = stride > 1 or drop_tail
    out = windowed(d, spec, lambda w: [F.collect_list("_vec").over(w.rowsBetween(lo, hi)).alias("x")],
                   halo, chunk_rows, keep_index=need_index)
    out = out.where(F.size("x") == length)
    if stride > 1:
        first = length if label == "next" else length - 1
        out = out.where(F.pmod(F.col("_rix") - first, F.lit(stride)) == 0)
    if drop_tail:
        n = df.groupBy(spec.station).agg(F.count(F.lit(1)).alias("_n"))
        out = keyed_join(out, n, [spec.station], "inner").where(F.col("_rix") < F.col("_n") - 1).drop("_n")
    keys = [spec.station] + spec.order_names()
    return out.select(*keys, "x", F.col(target).alias("y"))


def sequence_count(df: DataFrame, spec: SeriesSpec, length: int) -> DataFrame:
    """Cardinality law of W04: Σ max(n_s − L, 0) over stations."""
    n = df.groupBy(spec.station).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum(F.greatest(F.col("n") - length, F.lit(0))).alias("n_sequences"))
