"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are sorted
by key in ranges: the key's leading bits deal them into ranges of bounded
expected size, so a source with a third of all rows has many ranges. The token
counts of ranges give each range its offset (a prefix sum over ranges, not
rows), the prefix sum inside a range adds the rest, and the source is cut at
its exact budget. A budget above the source's size takes whole epochs first.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.session import materialize

RANGE_ROWS = 2_000  # documents in one range, on average
MOST = 3  # epochs at most
SEED = "mix"


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) -> the same with weight and target.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. They share
    the sum of all sizes by weight; no target passes ``most`` times its source's
    size, and what is above is shared by weight among the others until none is
    above. That is a common level of target per weight: sources whose cap per
    weight is under the level stop at their cap. The table has one row for each
    source; its windows are over sources, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if the sources before this one stop at their caps
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the first source whose cap is above that level gives the common level
    s = s.withColumn("common", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct(F.col("ratio"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, range_rows: int = RANGE_ROWS, seed: str = SEED, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row.

    size is the number of words (runs of other than blank characters) of the
    text; null and empty texts have 0 and nothing is taken from them. Sources
    may be null (one source of its own, last in order). Rows are sorted within a
    source by the MD5 digest of seed, doc_id and text, then by doc_id (null first)
    and size; rows alike in all of these are interchangeable. The last document
    within the budget is cut, so each source's taken words are its target
    rounded down. An empty table gives an empty result. Other columns than
    doc_id, text and source are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words(F.col("text").cast("string")).alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("digest"))
    # the text counts too, so that rows without an id (or with the same) are spread over all ranges
    key = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    rows = materialize(rows.withColumn("key", F.md5(key.cast("binary"))).drop("digest")
                       .withColumn("lead", F.conv(F.substring("key", 1, 8), 16, 10).cast("long")))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(per.select("source", "source_size"), most)
    per = per.join(targets.drop("source_size"), per["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    per = materialize(per.withColumn("ranges", F.ceil(F.col("n") / range_rows).cast("long"))
                      .select(F.col("source").alias("s"), "source_size", "target", "ranges"))
    r = rows.join(per, rows["source"].eqNullSafe(per["s"])).drop("s")
    r = r.withColumn("range", F.floor(F.col("lead") * F.col("ranges") / F.lit(1 << 32)).cast("long"))
    sums = r.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("g"), F.coalesce(F.sum("range_size").over(run), F.lit(0)).alias("range_start"))
    r = r.join(sums, r["source"].eqNullSafe(sums["s"]) & (r["range"] == sums["g"])).drop("s", "g")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return r.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         MD5(CONCAT('{SEED}', COALESCE(doc_id::VARCHAR, ''), ':', MD5(COALESCE(text, '')))) AS k
  FROM {{docs}}),
p AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((ROW_NUMBER() OVER (ORDER BY source IS NULL, ENCODE(source)) - 1) % 3 + 1)::BIGINT AS weight FROM p),
c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight::DOUBLE AS ratio FROM w),
l AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY ratio, source IS NULL, ENCODE(source)
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / SUM(weight) OVER (ORDER BY ratio, source IS NULL, ENCODE(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE
         LEAST(cap::DOUBLE, (SELECT ARG_MIN(level, ratio) FROM l WHERE ratio >= level) * weight) END AS target
  FROM l),
b AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         FLOOR(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN FLOOR(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + GREATEST(0, LEAST(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM b"""
