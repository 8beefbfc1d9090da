"""Registered queries of tree models held as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import trees as T
from stationflow.operators.metrics import regression_metrics
from stationflow.plans.registry import query, rnd
from stationflow.sources.tables import read_table

SPLITS = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_discount": [0.025, 0.055, 0.085], "l_tax": [0.025, 0.045]}
ROUNDS, RATE = 5, 0.5
CUT = "1998-12-31 00:00:00"


def _boosting_sql() -> str:
    """The rounds as a chain of tables: c<k> the candidates, b<k> the best, t<k> the residuals."""
    cells = [(f, t) for f, ts in SPLITS.items() for t in ts]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*SPLITS, "l_extendedprice"])
    sql = f"""WITH li AS (SELECT *, l_shipdate <= TIMESTAMP '{CUT}' AS train FROM lineitem WHERE {whole}),
t0 AS (SELECT l_quantity, l_discount, l_tax, l_extendedprice AS y, train, l_extendedprice - (SELECT avg(l_extendedprice) FROM li WHERE train) AS e FROM li)"""
    side = "CASE f " + " ".join(f"WHEN '{f}' THEN {f}" for f in SPLITS) + " END <= t"
    for k in range(ROUNDS):
        parts = " UNION ALL ".join(f"SELECT {i} AS i, '{f}' AS f, {t}::DOUBLE AS t, COUNT(*) FILTER ({f} <= {t}) AS n1, SUM(e) FILTER ({f} <= {t}) AS s1, "
                                   f"COUNT(*) AS n, SUM(e) AS s FROM t{k} WHERE train" for i, (f, t) in enumerate(cells))
        sql += f""",
c{k} AS (SELECT *, s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) - s * s / n AS gain FROM ({parts}) WHERE n1 > 0 AND n1 < n),
b{k} AS (SELECT f, t, gain, {RATE} * s1 / n1 AS lo, {RATE} * (s - s1) / (n - n1) AS hi FROM c{k} ORDER BY gain DESC, i LIMIT 1),
t{k + 1} AS (SELECT l_quantity, l_discount, l_tax, y, train, e - CASE WHEN {side} THEN lo ELSE hi END AS e FROM t{k}, b{k})"""
    return sql


def _fitted(spark, d):
    li = read_table(spark, d, "lineitem").select(*SPLITS, "l_extendedprice", "l_shipdate")
    cut = F.to_timestamp_ntz(F.lit(CUT))
    train, test = li.where(F.col("l_shipdate") <= cut), li.where(F.col("l_shipdate") > cut)
    return *T.fit_stumps(train, SPLITS, "l_extendedprice", ROUNDS, RATE), test


@query("boosted_gain", _boosting_sql() + ",\ng AS (" + " UNION ALL ".join(f"SELECT f, gain FROM b{k}" for k in range(ROUNDS)) + """),
s AS (SELECT f AS feature, SUM(gain) / (SELECT SUM(gain) FROM g) AS importance FROM g GROUP BY f)
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, ROUND(importance, 6) AS importance FROM s""")
def q_boosted_gain(spark, d):
    """M02 + A36 + O05: boosted stumps fitted from aggregates, features ranked by their gain."""
    nodes, _, _ = _fitted(spark, d)
    return T.gain_ranking(T.node_table(nodes, spark)).select("rank", "feature", rnd("importance").alias("importance"))


@query("boosted_predict", _boosting_sql() + f"""
SELECT COUNT(*) AS n, ROUND(sqrt(avg(e * e)), 4) AS rmse, ROUND(avg(abs(e)), 4) AS mae, ROUND(1 - avg(e * e) / var_pop(y), 6) AS r2
FROM t{ROUNDS} WHERE NOT train""")
def q_boosted_predict(spark, d):
    """The trees as one column expression over later ship dates, with A21 of the result."""
    nodes, base, test = _fitted(spark, d)
    p = test.dropna(subset=[*SPLITS, "l_extendedprice"]).withColumn("y_hat", T.tree_column(nodes, base))
    m = regression_metrics(p, "l_extendedprice", "y_hat")
    return m.select("n", rnd("rmse", 4).alias("rmse"), rnd("mae", 4).alias("mae"), rnd("r2").alias("r2"))
