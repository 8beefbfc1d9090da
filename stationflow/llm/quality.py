"""Quality classifier: a convolutional network over bytes, in numpy.

Every text is cut into overlapping chunks that cover all of it. Learned filters
run over the embedded bytes of a chunk and are max-pooled over its places; a
small layer turns the pooled filters into chunk features, whose mean and
maximum over all chunks give one probability. Fitting is on the driver, over a
bounded sample of labelled rows; scoring is a map over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.sample import hashed_sample
from stationflow.llm.text import flat, spread

CHUNK, OVERLAP = 512, 64  # bytes
WIDTH, STRIDE = 8, 2  # of a filter, in bytes
EMBED, FILTERS, HIDDEN = 8, 32, 16
SAMPLE_ROWS = 2400  # labelled rows for fitting, half of each label where there are so many
SAMPLE_BYTES = 8192  # only texts up to this size are fitted on
EPOCHS, BATCH, RATE = 8, 32, 4e-3
STEPS = 600  # mini-batches at least; small samples go round more often, 40 times at most
THRESHOLD = 0.3
PLACES = 1 + (CHUNK - WIDTH) // STRIDE


def chunks(data: np.ndarray, offsets: np.ndarray):
    """(chunk bytes, padded with 0; number of chunks of each text). A text has one
    chunk at least."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
    start = spread(np.zeros(len(n), np.int64), n) * (CHUNK - OVERLAP) + np.repeat(offsets[:-1], n)
    long = np.minimum(CHUNK, np.repeat(offsets[1:], n) - start)
    out = np.zeros((len(start), CHUNK), np.uint8)
    out.reshape(-1)[spread(np.arange(len(start)) * CHUNK, long)] = data[spread(start, long)]
    return out, n


class Network:
    """The parameters, scoring and fitting."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda fan, *shape: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
        self.p = {"embed": draw(1, 256, EMBED), "conv": draw(WIDTH * EMBED, WIDTH * EMBED, FILTERS), "conv_b": np.zeros(FILTERS, np.float32),
                  "dense": draw(FILTERS, FILTERS, HIDDEN), "dense_b": np.zeros(HIDDEN, np.float32),
                  "out": draw(2 * HIDDEN, 2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        self.shift = 0.0

    def _windows(self, x):
        """Embedded bytes under each place of a filter: (chunks * places, width * embed)."""
        e = self.p["embed"][x]
        v = np.lib.stride_tricks.as_strided(e, (len(x), PLACES, WIDTH * EMBED), (e.strides[0], STRIDE * e.strides[1], e.strides[2]))
        return v.reshape(-1, WIDTH * EMBED)

    def _pooled(self, x):
        z = (self._windows(x) @ self.p["conv"]).reshape(len(x), PLACES, FILTERS)
        return z.max(1) + self.p["conv_b"]

    def _top(self, pooled, n):
        h = np.maximum(np.maximum(pooled, 0) @ self.p["dense"] + self.p["dense_b"], 0)
        at = np.concatenate(([0], np.cumsum(n)))[:-1]
        mean = np.add.reduceat(h, at) / n[:, None]
        return h, np.concatenate([mean, np.maximum.reduceat(h, at)], 1)

    def score(self, data, offsets, part: int = 256) -> np.ndarray:
        """Probability of label 1 for each text."""
        x, n = chunks(data, offsets)
        pooled = np.concatenate([self._pooled(x[i:i + part]) for i in range(0, len(x), part)])
        z = self._top(pooled, n)[1] @ self.p["out"] + self.p["out_b"][0] + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def _gradients(self, x, n, y):
        p, places = self.p, len(x)
        e = self._windows(x)
        z = (e @ p["conv"]).reshape(places, PLACES, FILTERS)
        top = z.argmax(1)
        pooled = np.take_along_axis(z, top[:, None], 1)[:, 0] + p["conv_b"]
        h, d = self._top(pooled, n)
        s = 1 / (1 + np.exp(-np.clip(d @ p["out"] + p["out_b"][0], -30, 30)))
        gz = ((s - y) / len(y)).astype(np.float32)
        g = {"out": d.T @ gz, "out_b": gz.sum(keepdims=True)}
        gd = gz[:, None] * p["out"]
        doc = np.repeat(np.arange(len(n)), n)
        gh = gd[doc, :HIDDEN] / n[doc][:, None]
        most = d[:, HIDDEN:][doc]
        is_max = (h == most) & (h > 0)
        gh = gh + gd[doc, HIDDEN:] * is_max
        gh = gh * (h > 0)
        r = np.maximum(pooled, 0)
        g["dense"], g["dense_b"] = r.T @ gh, gh.sum(0)
        gp = (gh @ p["dense"].T) * (pooled > 0)
        g["conv_b"] = gp.sum(0)
        # each filter's gradient goes to the place that it was pooled from
        row = (np.arange(places)[:, None] * PLACES + top).reshape(-1)
        under = e[row].reshape(places, FILTERS, -1)
        g["conv"] = np.einsum("cfk,cf->kf", under, gp, optimize=True)
        ge = (gp[:, :, None] * p["conv"].T[None]).reshape(places, FILTERS, WIDTH, EMBED)
        spot = top[:, :, None] * STRIDE + np.arange(WIDTH)
        byte = np.take_along_axis(x, spot.reshape(places, -1), 1).reshape(-1)
        flat_ge = ge.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(byte, flat_ge[:, k], 256) for k in range(EMBED)], 1)
        return g

    def fit(self, data, offsets, y, epochs: int = EPOCHS, prior: float | None = None, seed: int = 0) -> "Network":
        """Adam over mini-batches of texts; ``prior`` is the share of label 1 where
        the sample's differs from it."""
        x, n = chunks(data, offsets)
        at = np.concatenate(([0], np.cumsum(n)))
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        total = epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                docs = order[i:i + BATCH]
                g = self._gradients(x[spread(at[docs], n[docs])], n[docs], y[docs])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, gk in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v2[k] = 0.999 * v2[k] + 0.001 * gk * gk
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        share = float(np.mean(y))
        if prior is not None and 0 < share < 1:
            self.shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
        return self


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Fits on at most ``rows`` labelled rows outside the held-out fold, those with
    the smallest hashes of their ids, half of each label, of texts of at most
    ``most_bytes`` bytes. Without rows of both labels the network scores the
    share of label 1 (0.5 without labels) for every text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(_remainder() != 0)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    net = Network()
    got = []
    for label in (0, 1):
        sample = hashed_sample(docs, rows // 2, "fit", F.octet_length("text").between(1, most_bytes), known.where(F.col("y") == label))
        got += [(t.encode(), label) for _, t in sample]
    y = np.array([b for _, b in got], np.float32)
    if not len(y) or y.min() == y.max():
        for k in ("out", "conv", "dense"):
            net.p[k][:] = 0
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        net.p["out_b"][:] = np.log(prior / (1 - prior))
        return net
    data = np.frombuffer(b"".join(t for t, _ in got), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t, _ in got])))
    epochs = max(EPOCHS, min(40, -(-STEPS * BATCH // len(y))))
    return net.fit(data, offsets, y, epochs=epochs, prior=prior)


def score_quality(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with quality_score and quality_label (1 from
    ``threshold``); columns of these names are replaced, all others stay. Texts
    of any length are scored whole; null and empty texts get the score of one
    chunk of padding."""
    cols = [c for c in docs.columns if c not in ("quality_score", "quality_label")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols] + ["quality_score double"])

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column("text"))
            score, i = np.zeros(b.num_rows), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
                score[i:j] = net.score(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                i = j
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(score)], cols + ["quality_score"])

    return docs.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema).withColumn(
        "quality_label", (F.col("quality_score") >= threshold).cast("int"))
