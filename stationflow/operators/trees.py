"""Tree models as data.

A model is a table of nodes: tree, node, feature, threshold, gain, left, right,
value (node 0 is a tree's root; leaves have no feature). The table compiles to a
column expression, so scoring is plain column arithmetic inside the scan's
stage, and to SQL, so any engine can score the same trees. MLlib's boosted trees
are exported to it, and boosted stumps are fitted here from aggregates alone.
The driver holds the nodes only, whose number is a parameter of the fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.operators.topk import top_k
from stationflow.session import work_path

NODE_SCHEMA = "tree int, node int, feature string, threshold double, gain double, left int, right int, value double"


def export_trees(model, features: list[str], spark: SparkSession) -> list[dict]:
    """The nodes of a fitted MLlib tree ensemble, from its saved table; leaf values
    are multiplied by the tree's weight, gains by the rows of their node."""
    path = work_path(spark, "trees")
    model.write().overwrite().save(path)
    weight = model.treeWeights
    out = []
    for r in spark.read.parquet(f"{path}/data").collect():  # nodes of the model, not rows of data
        n = r["nodeData"]
        inner = n["leftChild"] >= 0
        out.append({"tree": r["treeID"], "node": n["id"], "feature": features[n["split"]["featureIndex"]] if inner else None,
                    "threshold": n["split"]["leftCategoriesOrThreshold"][0] if inner else None, "gain": n["gain"] * n["rawCount"] if inner else 0.0,
                    "left": n["leftChild"] if inner else None, "right": n["rightChild"] if inner else None,
                    "value": n["prediction"] * weight[r["treeID"]]})
    return out


def _by_tree(nodes: list[dict]) -> dict[int, dict[int, dict]]:
    trees: dict = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n
    return dict(sorted(trees.items()))


def tree_column(nodes: list[dict], base: float = 0.0) -> Column:
    """``base`` plus the sum of all trees' values, as one expression. A row goes
    left where the feature is at most the threshold; NULL goes right."""
    def value(tree, i):
        n = tree[i]
        if n["feature"] is None:
            return F.lit(float(n["value"]))
        return F.when(F.col(n["feature"]) <= F.lit(float(n["threshold"])), value(tree, n["left"])).otherwise(value(tree, n["right"]))
    return sum((value(t, 0) for t in _by_tree(nodes).values()), F.lit(float(base)))


def tree_sql(nodes: list[dict], base: float = 0.0) -> str:
    """The expression of :func:`tree_column` as SQL text."""
    def value(tree, i):
        n = tree[i]
        if n["feature"] is None:
            return f"({float(n['value'])!r}::DOUBLE)"
        return f"CASE WHEN {n['feature']} <= {float(n['threshold'])!r}::DOUBLE THEN {value(tree, n['left'])} ELSE {value(tree, n['right'])} END"
    return " + ".join([f"({float(base)!r}::DOUBLE)", *[f"({value(t, 0)})" for t in _by_tree(nodes).values()]])


def node_table(nodes: list[dict], spark: SparkSession) -> DataFrame:
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(n[c] for c in names) for n in nodes], NODE_SCHEMA)


def gain_ranking(table: DataFrame, top: int | None = None) -> DataFrame:
    """A36 + O05: rank, feature, share of the total gain; the first ``top`` only."""
    g = table.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("gain").alias("gain"))
    whole = table.agg(F.sum("gain").alias("all")).scalar()
    g = g.select("feature", (F.col("gain") / whole).alias("importance")).withColumn("_all", F.lit(0))
    return top_k(g, ["_all"], [F.desc("importance"), F.asc("feature")], top or (1 << 30)).select(
        F.col("rank").cast("int").alias("rank"), "feature", "importance")


def fit_stumps(df: DataFrame, candidates: dict[str, list[float]], y: str, rounds: int = 10, rate: float = 0.5) -> tuple[list[dict], float]:
    """(nodes, base): least-squares boosting with trees of one split each. A round is
    one aggregate over the rows with all values: for every candidate (feature,
    threshold) the rows at or below it and the sum of their residuals; the split
    with the largest gain wins (the earlier candidate at ties). Residuals are an
    expression of the trees so far, so nothing is stored between rounds."""
    d = df.dropna(subset=[*candidates, y])
    cells = [(f, float(t)) for f, ts in candidates.items() for t in ts]
    base = d.agg(F.avg(y)).first()[0]
    nodes: list[dict] = []
    for k in range(rounds if base is not None else 0):
        rest = F.col(y).cast("double") - tree_column(nodes, base)
        at_most = [F.col(f) <= F.lit(t) for f, t in cells]
        r = d.select(rest.alias("_e"), *[c.alias(f"_c{i}") for i, c in enumerate(at_most)]).agg(
            F.count(F.lit(1)).alias("n"), F.sum("_e").alias("s"),
            *[F.count_if(f"_c{i}").alias(f"n{i}") for i in range(len(cells))],
            *[F.sum(F.when(F.col(f"_c{i}"), F.col("_e")).otherwise(0.0)).alias(f"s{i}") for i in range(len(cells))]).first()
        best = None
        for i, (f, t) in enumerate(cells):
            n, s = r[f"n{i}"], r[f"s{i}"]
            if 0 < n < r["n"]:
                gain = s * s / n + (r["s"] - s) ** 2 / (r["n"] - n) - r["s"] ** 2 / r["n"]
                if best is None or gain > best[0]:
                    best = (gain, f, t, rate * s / n, rate * (r["s"] - s) / (r["n"] - n))
        if best is None:
            break
        leaf = {"tree": k, "feature": None, "threshold": None, "gain": 0.0, "left": None, "right": None}
        nodes += [{"tree": k, "node": 0, "feature": best[1], "threshold": best[2], "gain": best[0], "left": 1, "right": 2, "value": 0.0},
                  {**leaf, "node": 1, "value": best[3]}, {**leaf, "node": 2, "value": best[4]}]
    return nodes, float(base or 0.0)
