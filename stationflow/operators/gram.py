"""Cross-products of columns in one pass.

The columns are cut into blocks of BLOCK. A row sends one record for each pair of
blocks, and one aggregate sums the products of a pair of blocks by its key, so
the generated code stays small however many columns there are, and the sums are
combined map-side. Correlations, scenario regressions and ridge solutions are
all read from the resulting table, which has one row for each pair of columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4
# Up to so many columns one plain aggregate may hold the sums of all pairs.
PLAIN = 8
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def cross_products(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b and the sums n, sx, sy, sxx, syy, sxy over rows where both columns are
    there, for every pair of columns in their order (a column with itself too)."""
    blocks = [cols[i:i + BLOCK] for i in range(0, len(cols), BLOCK)]
    values = [F.array(*[F.col(c).cast("double") for c in b], *[F.lit(None).cast("double")] * (BLOCK - len(b))) for b in blocks]
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), values[i].alias("x"), values[j].alias("y"))
             for i in range(len(blocks)) for j in range(i, len(blocks))]
    d = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    aggs = []
    for a in range(BLOCK):
        for b in range(BLOCK):
            x, y = F.col("x")[a], F.col("y")[b]
            both = x.isNotNull() & y.isNotNull()
            for name, e in (("n", F.lit(1.0)), ("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y)):
                aggs.append(F.sum(F.when(both, e)).alias(f"{name}_{a}_{b}"))
    g = d.groupBy("i", "j").agg(*aggs)
    cells = [F.struct((F.col("i") * BLOCK + a).alias("ia"), (F.col("j") * BLOCK + b).alias("ib"),
                      *[F.coalesce(F.col(f"{s}_{a}_{b}"), F.lit(0.0)).alias(s) for s in SUMS]) for a in range(BLOCK) for b in range(BLOCK)]
    out = g.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where((F.col("ia") <= F.col("ib")) & (F.col("ib") < len(cols)))
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(names[F.col("ia")].alias("a"), names[F.col("ib")].alias("b"), "n", *SUMS[1:])


def correlation() -> Column:
    """Pearson correlation of a row of :func:`cross_products`; NULL where a column
    is constant or no row has both."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in SUMS)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy))


class Gram:
    """The cross-products of complete rows on the driver: one cell for each pair of
    columns, whatever the number of rows."""

    def __init__(self, df: DataFrame, cols: list[str], plain: int = 0):
        """Up to ``plain`` columns are summed without a record for each pair of blocks."""
        at = {c: i for i, c in enumerate(cols)}
        self.at, k = at, len(cols)
        self.n, self.sums, self.products = 0.0, np.zeros(k), np.zeros((k, k))
        if k <= plain:
            x = [F.col(c).cast("double") for c in cols]
            pairs = [(i, j) for i in range(k) for j in range(i, k)]
            n, *sums = df.dropna(subset=cols).agg(F.count(F.lit(1)), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
            if n:
                self.n, self.sums = float(n), np.array(sums[:k])
                for (i, j), s in zip(pairs, sums[k:]):
                    self.products[i, j] = self.products[j, i] = s
            return
        for r in cross_products(df.dropna(subset=cols), cols).collect():
            i, j = at[r["a"]], at[r["b"]]
            self.n, self.sums[i], self.sums[j] = r["n"], r["sx"], r["sy"]
            self.products[i, j] = self.products[j, i] = r["sxy"]

    def ridge(self, features: list[str], y: str, penalty: float) -> tuple[list[float], float]:
        """(coefficients, intercept) of least squares with ``penalty`` times the
        squared coefficients of the centred features added to the sum of squares."""
        f, t = [self.at[c] for c in features], self.at[y]
        cov = self.products - np.outer(self.sums, self.sums) / max(self.n, 1.0)
        coef = np.linalg.solve(cov[np.ix_(f, f)] + penalty * np.eye(len(f)), cov[f, t])
        return coef.tolist(), float((self.sums[t] - coef @ self.sums[f]) / max(self.n, 1.0))

    def ridge_scaled(self, features: list[str], y: str, penalty: float) -> tuple[list[float], float]:
        """(coefficients, intercept) of MLlib's ``LinearRegression(regParam=penalty,
        elasticNetParam=0)``: the penalty is on features and label of unit deviation.
        A constant feature (but for rounding of the sums), and every feature of a
        constant label, gets 0."""
        cov = self.products - np.outer(self.sums, self.sums) / max(self.n, 1.0)
        var = np.array([cov[self.at[c], self.at[c]] for c in features])
        spread = np.sqrt(max(cov[self.at[y], self.at[y]], 0.0) / max(self.n, 1.0))
        live = [c for c, v in zip(features, var) if v > 1e-12 * self.products[self.at[c], self.at[c]] and spread > 0]
        coef = dict(zip(live, self.ridge(live, y, penalty / spread * var[[c in live for c in features]])[0])) if live else {}
        out = [coef.get(c, 0.0) for c in features]
        return out, float((self.sums[self.at[y]] - sum(b * self.sums[self.at[c]] for b, c in zip(out, features))) / max(self.n, 1.0))

    def ranked(self, features: list[str], y: str) -> list[str]:
        """The features by falling absolute correlation with ``y``, ties by name."""
        cov = self.products - np.outer(self.sums, self.sums) / max(self.n, 1.0)
        t = self.at[y]
        r = {c: abs(cov[self.at[c], t]) / np.sqrt(cov[self.at[c], self.at[c]] * cov[t, t]) if cov[self.at[c], self.at[c]] > 0 else 0.0 for c in features}
        return sorted(features, key=lambda c: (-round(r[c], 9), c))


def ridge_scenarios(train: DataFrame, test: DataFrame, scenarios: dict[str, list[str]], y: str, penalty: float = 1.0,
                    top: int | None = None) -> DataFrame:
    """Ridge for each scenario (named set of features) from one pass over the
    complete train rows, and the errors of all on the complete test rows from
    one more: scenario, n_features, n, rmse, mae, r2. ``top`` adds the scenario
    TOP<k> of the k features most correlated with ``y`` in train."""
    every = list(dict.fromkeys(c for f in scenarios.values() for c in f))
    gram = Gram(train, [*every, y])
    if top:
        scenarios = {**scenarios, f"TOP{top}": gram.ranked(every, y)[:top]}
    t = F.col(y).cast("double")
    rows = []
    for name, feats in scenarios.items():
        coef, base = gram.ridge(feats, y, penalty)
        e = t - sum((F.lit(c) * F.col(f) for c, f in zip(coef, feats)), F.lit(base))
        rows.append(F.struct(F.lit(name).alias("scenario"), F.lit(len(feats)).alias("n_features"), F.count(F.lit(1)).alias("n"),
                             F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                             (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(t))).alias("r2")))
    return test.dropna(subset=[*every, y]).agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
