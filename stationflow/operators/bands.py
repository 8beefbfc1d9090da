"""Band rules over one feature by an interval index.

The limits of all bands cut the axis into segments: one for each limit and one
for each gap between two. A band covers a run of segments, which splits into at
most two nodes of each level of a binary tree over them; a row lies in one
segment and so under one node of each level. Rows and rules meet by an equi-join
on the nodes: a row compares log2(segments) nodes, however many rules there are
and however they overlap, and no band is compared with a row it does not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.operators.joins import keyed_join

WIDTH = 64  # limits compared in each step of the search for a segment


def _place(x: Column, heads: Column, tails: Column, strict: bool) -> Column:
    """How many of the sorted limits are below ``x`` (or at most ``x``)."""
    under = (lambda v: v < x) if strict else (lambda v: v <= x)
    head = F.size(F.filter(heads, under))
    return F.when(head == 0, 0).otherwise((head - 1) * WIDTH + F.size(F.filter(F.get(tails, F.greatest(head - 1, F.lit(0))), under)))


def _with_segment(df: DataFrame, limits: DataFrame, x: Column, out: str) -> DataFrame:
    """Adds the segment of ``x``: 2 i + 1 at the i-th limit, 2 i between limits."""
    d = df.withColumn("_l", limits.scalar())
    heads, tails = F.col("_l.heads"), F.col("_l.tails")
    no = _place(x, heads, tails, True) + _place(x, heads, tails, False)
    return d.withColumn(out, F.when(x.isNotNull(), no)).drop("_l")


def band_alerts(df: DataFrame, keys: list[str], feature: str, rules: DataFrame) -> DataFrame:
    """``keys`` and ``alerts`` of every row: the rules whose band holds the feature,
    worst first (severity falling, then rule_no).

    ``rules``: rule_no int, lo double, lo_inc boolean, hi double, hi_inc boolean
    (NULL limits are open ends), severity int. The catalogue is broadcast as its
    limits (one array) and joined by node as Spark plans it, so it may hold many
    thousands of rules. Rows with a NULL feature have no alerts; the keys identify a row."""
    ends = rules.select(F.explode(F.array("lo", "hi")).alias("v")).where("v is not null")
    every = ends.agg(F.array_sort(F.collect_set("v")).alias("e"))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("e") - 1) / WIDTH), F.lit(0)).cast("int")), lambda g: F.slice("e", g * WIDTH + 1, WIDTH))
    limits = every.select(F.when(F.size("e") > 0, groups).otherwise(F.array().cast("array<array<double>>")).alias("tails"), F.size("e").alias("n"))
    limits = limits.select(F.struct(F.transform("tails", lambda t: t[0]).alias("heads"), "tails", "n").alias("l"))
    # levels of the tree: enough that one node holds every segment
    levels = F.ceil(F.log2(2 * F.col("_l.n") + 2)).cast("int")

    r = _with_segment(_with_segment(rules, limits, F.col("lo"), "_a"), limits, F.col("hi"), "_b").withColumn("_l", limits.scalar())
    first = F.when(F.col("lo").isNull(), 0).when(F.col("lo_inc"), F.col("_a")).otherwise(F.col("_a") + 1)
    last = F.when(F.col("hi").isNull(), 2 * F.col("_l.n")).when(F.col("hi_inc"), F.col("_b")).otherwise(F.col("_b") - 1)
    r = r.select("rule_no", "severity", first.cast("long").alias("a"), (last + 1).cast("long").alias("z"), F.sequence(F.lit(0), levels).alias("_levels")).where("a < z")
    # nodes [k 2^l, (k + 1) 2^l) inside [a, z) whose parent is not: the leftmost and the rightmost of a level
    r = r.select("rule_no", "severity", "a", "z", F.explode("_levels").alias("l"))
    size = F.expr("shiftleft(cast(1 as bigint), l)")
    lo, hi = F.ceil(F.col("a") / size), F.floor(F.col("z") / size)
    up_lo, up_hi = F.ceil(F.col("a") / (2 * size)), F.floor(F.col("z") / (2 * size))
    left = F.when((lo < hi) & ((up_lo >= up_hi) | (lo < up_lo * 2)), lo)
    right = F.when((lo < hi) & ((up_lo >= up_hi) | (hi > up_hi * 2)), hi - 1)
    nodes = r.select("rule_no", "severity", "l", F.explode(F.array_distinct(F.array(left, right))).alias("k")).where("k is not null")

    d = _with_segment(df.select(*keys, F.col(feature).cast("double").alias("_x")), limits, F.col("_x"), "_s").withColumn("_l", limits.scalar())
    d = d.select(*keys, F.explode_outer(F.when(F.col("_s").isNotNull(), F.sequence(F.lit(0), levels))).alias("l"), "_s")
    d = d.select(*keys, "l", F.expr("shiftright(cast(_s as bigint), l)").alias("k"))
    met = d.join(nodes, ["l", "k"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("minus"), "rule_no"))).alias("m"))
    met = met.select(*keys, F.transform("m", lambda m: F.struct(m["rule_no"].alias("rule_no"), (-m["minus"]).alias("severity"))).alias("alerts"))
    none = F.array().cast("array<struct<rule_no:int,severity:int>>")
    return keyed_join(df.select(*keys), met, keys).select(*keys, F.coalesce("alerts", none).alias("alerts"))
