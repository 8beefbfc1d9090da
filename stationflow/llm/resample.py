"""Importance resampling towards a target distribution.

Features are runs of one to two words, hashed into buckets. The corpus and the
target table are each counted once into an array of buckets; the log of their
ratio is a bucket's gain. A document's weight is the mean gain of its features,
read from that array. Gumbel noise from a hash of the id turns the highest
scores into a draw without replacement.

The cutoff is found without sorting the scores: a quantile sketch gives a
bracket of scores around it, exact counts of the documents above and inside
confirm the bracket or widen it, and only documents inside are sorted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.text import LOWER, flat, word_spans
from stationflow.session import materialize

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = "7:"
SKETCH = 1000  # accuracy of the quantile sketch: rank errors of n / SKETCH
RANGE_ROWS = 200_000  # documents in one range of the sort, about
BLOCK = 1 << 22  # bytes of text at once, or one text

# Bytes that are in no word: all but ASCII letters, digits and bytes over 0x7F.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
NEAR = 32  # words up to this length are joined to pairs by table


def _shift_tables() -> np.ndarray:
    """[n, i, b]: what the byte b at place i of a checksum becomes after n zero bytes."""
    out = np.empty((NEAR + 1, 4, 256), np.uint32)
    out[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
    for n in range(1, NEAR + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ CRC[out[n - 1] & np.uint32(255)]
    return out


SHIFT = _shift_tables()


def _bytes_after(crc: np.ndarray, byte) -> np.ndarray:
    return (crc >> np.uint32(8)) ^ CRC[(crc ^ byte) & np.uint32(255)]


def span_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Checksum registers after the bytes of each span, from the registers ``crc``."""
    crc = crc.copy()
    order = np.argsort(-size, kind="stable")
    by_size = -size[order]
    for k in range(int(size.max(initial=0))):
        at = order[:np.searchsorted(by_size, -k, "left")]
        crc[at] = _bytes_after(crc[at], data[start[at] + k])
    return crc


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksums of all words and pairs, their documents, words per document):
    CRC-32 of the UTF-8 bytes, of pairs with one space between. A checksum is
    linear over bits, so that of a pair is that of the first word and the space
    moved on by the second word's length, with the second word's added."""
    data = LOWER[data]
    s, e = word_spans(data, offsets, GAP)
    first = np.searchsorted(s, offsets)
    n_words = np.diff(first)
    own = np.repeat(np.arange(len(n_words)), n_words)
    full = np.uint32(0xFFFFFFFF)
    one = span_crcs(data, s, e - s, np.full(len(s), full, np.uint32))
    pair = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
    size = (e - s)[pair + 1]
    head = _bytes_after(one[pair], np.uint32(32))
    near = size <= NEAR
    # the second word's register began at full, not at the head: both differ by a shift
    moved, two = (head ^ full)[near], np.empty(len(pair), np.uint32)
    n = size[near]
    lift = SHIFT[n, 0, moved & np.uint32(255)]
    for i in (1, 2, 3):
        lift ^= SHIFT[n, i, (moved >> np.uint32(8 * i)) & np.uint32(255)]
    two[near] = lift ^ one[pair + 1][near]
    far = np.flatnonzero(~near)
    two[far] = span_crcs(data, s[pair + 1][far], size[far], head[far])
    return np.concatenate((one, two)) ^ full, np.concatenate((own, own[pair])), n_words


def _text_blocks(b: pa.RecordBatch):
    """(slice, bytes, offsets) of about BLOCK bytes of the text column."""
    data, off = flat(b.column("text"))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
        yield slice(at, to), data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. Each task adds up one
    array; the driver gets at most one row for each bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, off in _text_blocks(b):
                total += np.bincount(features(data, off)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the log ratio of both smoothed distributions, rounded down."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from SHA-256 of the seed and the id; all null
    ids have the same."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    buckets = len(gain)

    def run(batches):
        for b in batches:
            for at, data, off in _text_blocks(b):
                crc, own, n_words = features(data, off)
                n = np.bincount(own, minlength=len(n_words))
                total = np.zeros(len(n_words), np.int64)
                np.add.at(total, own, gain[crc % np.uint32(buckets)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at], pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                                                  pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def cutoff(scores: DataFrame, draw: int, total: int) -> int:
    """The score of rank ``draw`` (1 to ``total``, from the highest)."""
    share, step = 1 - draw / total, 4 / SKETCH
    while True:
        ends = [max(0.0, share - step), min(1.0, share + step)]
        low, high = scores.agg(F.percentile_approx("score", ends, F.lit(SKETCH))).first()[0]
        c = scores.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score").between(low, high)).alias("inside")).first()
        if c["above"] < draw <= c["above"] + c["inside"]:
            break
        step *= 8  # at 1 and more the bracket holds every score
    inside = scores.where(F.col("score").between(low, high)).groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score"))  # over one row for each score inside the bracket
    at = inside.withColumn("upto", c["above"] + F.sum("n").over(down)).where(F.col("upto") >= draw)
    return at.agg(F.max("score")).first()[0]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
             seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters
    beyond ASCII; null and empty texts have no features and weight 0. Of the N
    rows with ``least_words`` words or more, percent * N / 100, rounded down, are
    drawn: the highest scores, ties to the smaller doc_id (null last). rank
    numbers them from 1; it is null for all others. Repeated ids get the same
    noise; rows alike in score and id share their places in any order. Only
    doc_id and text of ``docs`` and text of ``target`` are read. Empty tables
    give an empty result; with an empty target all gains come from the smoothing.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= least_words).select("row", "doc_id", "score")
    total = able.count()
    draw = percent * total // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    edge = cutoff(able.select("score"), draw, total)
    ranked = _ranks(able.where(F.col("score") >= edge), draw)
    return rows.join(ranked.where(F.col("rank") <= draw), "row", "left").select(*out, "rank")


def _ranks(rows: DataFrame, draw: int) -> DataFrame:
    """row and rank by falling score and rising doc_id: ranges of the sorted rows
    are numbered inside, and the sizes of the ranges before are added."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            nth = np.arange(n + 1, n + 1 + b.num_rows, dtype=np.int64)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(nth)], ["row", "part", "nth"])

    ranges = max(1, math.ceil(draw / RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.mapInArrow(number, "row long, part int, nth long"))
    per = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return dealt.join(per, "part").select("row", (F.col("ahead") + F.col("nth")).alias("rank"))
