"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, root) for every node of a link; root is the
    smallest node of its component.

    Every round hooks a node's parent under the grandparent of its neighbours
    and shortens the paths, so rounds grow with the logarithm of the longest
    path. Minima are combined before each shuffle; a node with very many links
    is a skewed side of joins only. Each round is checkpointed.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = materialize(edges.union(edges.select("v", "u")).where("u <> v").distinct())
    parent = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        g = parent.join(up, "root").select("node", "root", "grand")
        far = edges.join(g.select(F.col("node").alias("v"), F.col("grand").alias("far")), "v").groupBy("u").agg(F.min("far").alias("far"))
        g = g.join(far, g["node"] == far["u"]).select("node", "root", "grand", "far")
        hooks = g.select(F.explode(F.array(F.struct("node", F.least("grand", "far").alias("root")),
                                           F.struct(F.col("root").alias("node"), F.least("grand", "far").alias("root")))).alias("x")).select("x.*")
        new = materialize(hooks.union(parent.select("node", "root")).groupBy("node").agg(F.min("root").alias("root")))
        changed = new.join(parent.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        parent = new
        if not changed:
            return parent
