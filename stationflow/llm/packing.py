"""Best-fit packing by a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence. The
program asks for the fewest configurations that use every piece of the length
histogram. It is solved by multiplicative weights: each length has a price, a
knapsack dynamic program finds the configurations worth most under the prices,
they are taken a little at a time, and lengths that lag behind get dearer. The
shares are rounded down, whole configurations that still fit are added, and what
is left of the histogram goes best-fit into the space that is left.

The histogram has one entry for each length up to the capacity, so the program's
size does not depend on the data; it is solved on the driver. Pieces are never
collected: each gets its rank among the pieces of its length (a count inside its
task and a prefix sum over tasks), and a table of ranks of the plan, bounded by
the number of configurations, tells its place.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationflow.llm.text import spread
from stationflow.session import materialize

CAPACITY = 4096
END = 1  # id after each document
ROUNDS = 100  # rounds of prices
SLACK = 1e-3  # how far below the best configuration of a round others may be worth
RATE = 1.0  # how much a length that lags by all of its pieces gains in price
WORDS = 10_000  # words encoded at once
STOPS = ".,;:!?"
BLOCK = 16 << 20  # bytes of text tokenised at once, or one text
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of texts, word by word. The tokenizer drops white space and joins
    nothing over it, so the ids of a text are those of its blank-separated words
    one after the other; each distinct word of a block of texts is tokenised
    once. Only its spelling in lower case counts, save where a special token may
    be written out."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        at = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        got = self._each(words.dictionary.to_pylist())
        n = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(n.sum()))
        code = words.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(n[code])))
        return ids[spread((np.cumsum(n) - n)[code], n[code])], ends[at - at[0]]

    def _each(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. ASCII letters are one unit to the tokenizer and stops
        behind them another, so these go to its model directly."""
        out: list = [None] * len(words)
        other, model, tails = [], self.tok.model.tokenize, {}
        for i, w in enumerate(words):
            v = w.rstrip(STOPS)
            if v.isascii() and v.isalpha():
                out[i] = [t.id for t in model(v.lower())]
                if len(v) < len(w):
                    tail = w[len(v):]
                    if tail not in tails:
                        tails[tail] = self.tok.encode(tail, add_special_tokens=False).ids
                    out[i] += tails[tail]
            else:
                other.append(i)
        for at in range(0, len(other), WORDS):
            some = other[at:at + WORDS]
            for i, g in zip(some, self.tok.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = g.ids
        return out


def _blocks(texts: pa.Array):
    """Slices of a column of texts of about BLOCK bytes, at least one text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
        yield slice(at, to)
        at = to


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with ``part`` and
    ``nth``: the task that made it and its number among that task's pieces of its
    length. The file's text goes to the executors with the function."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    def run(batches):
        ids, seen, part = WordIds(spec), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for at in _blocks(b.column("text")):
                rows, doc = [], b.column("doc_id")[at].to_pylist()
                every, ends = ids(b.column("text")[at])
                for i, d in enumerate(doc):
                    x = np.append(every[ends[i]:ends[i + 1]], np.uint32(end)).astype("<u4")
                    for k, s in enumerate(range(0, len(x), capacity)):
                        y = x[s:s + capacity]
                        rows.append((d, k, s, len(y), zlib.crc32(y.tobytes()), part, int(seen[len(y)])))
                        seen[len(y)] += 1
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, PIECE + ", part int, nth long")


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(worth, first) for every space up to ``capacity``: the most that lengths
    filling it are worth, and one length of such a filling (0: leave a token)."""
    worth, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    down = price[::-1]
    for c in range(1, capacity + 1):
        v = worth[:c] + down[capacity - c:capacity]  # the longest length first, so that it wins ties
        k = int(v.argmax())
        if v[k] > worth[c - 1]:
            worth[c], first[c] = v[k], c - k
        else:
            worth[c] = worth[c - 1]
    return worth, first


def _filling(space: int, first: np.ndarray) -> Counter:
    out = Counter()
    while space > 0:
        k = int(first[space])
        if k:
            out[k] += 1
        space -= k or 1
    return out


def solve(count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict, float]:
    """Shares of configurations, as {configuration: times}, that use no length more
    often than ``count`` says, and a lower bound of the number of sequences. A
    configuration is a tuple of (length, copies)."""
    n = count.astype(float)
    some = np.flatnonzero(n)
    size = np.arange(capacity + 1, dtype=float)
    price, bound = size / capacity, 0.0
    used = np.zeros(capacity + 1)  # by all configurations so far
    taken: dict = {}
    for turn in range(rounds):
        live = np.full(capacity + 1, -np.inf)
        live[some] = price[some]
        worth, first = knapsack(live, capacity)
        # any prices under which no configuration is worth over 1 bound the program
        bound = max(bound, float((n[some] * price[some]).sum() / worth[capacity]))
        through = live + worth[::-1]  # the most a configuration with this length is worth
        best = np.flatnonzero(through >= (1 - SLACK) * worth[capacity])
        best = best[np.argsort(used[best] / n[best], kind="stable")]
        fresh = np.zeros(capacity + 1)  # used in this round
        for k in best.tolist():
            if fresh[k] >= n[k]:
                continue
            fill = _filling(capacity - k, first)
            fill[k] += 1
            times = min(max(0.0, n[i] - fresh[i]) / a for i, a in fill.items())
            if times > 0:
                key = tuple(sorted(fill.items(), reverse=True))
                taken[key] = taken.get(key, 0.0) + times
                for i, a in fill.items():
                    fresh[i] += a * times
        used += fresh
        ahead = fresh[some] / n[some] - (fresh[some] * size[some]).sum() / (n[some] * size[some]).sum()
        price[some] = np.maximum(price[some] * np.exp(-RATE * ahead / (1 + turn) ** 0.5), 1e-9)
    # the rounds in proportion, as much of them as there are pieces for
    scale = (n[some] * size[some]).sum() / max(1e-9, (used[some] * size[some]).sum())
    left, share = n.copy(), {}
    for key, x in sorted(taken.items(), key=lambda kx: (-kx[1], kx[0])):
        x = min(x * scale, *(left[i] / a for i, a in key))
        if x > 0:
            share[key] = x
            for i, a in key:
                left[i] -= a * x
    return share, bound


def plan(count: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list, float]:
    """([(times, configuration)], lower bound): whole numbers of configurations
    that use every piece of the histogram ``count`` exactly once."""
    if not count.any():
        return [], 0.0
    left, used = count.astype(np.int64).copy(), {}

    def take(key, times):
        times = min(times, *(int(left[i]) // a for i, a in key))
        if times > 0:
            used[key] = used.get(key, 0) + times
            for i, a in key:
                left[i] -= a * times

    share, bound = solve(left, capacity, rounds)
    for key, x in share.items():
        take(key, int(x + 1e-6))
    for key, x in sorted(share.items(), key=lambda kx: (-(kx[1] % 1), kx[0])):
        take(key, 1)
    return best_fit([(t, k) for k, t in used.items()], left, capacity), bound


def best_fit(groups: list, left: np.ndarray, capacity: int) -> list:
    """Adds what is ``left`` of the histogram, longest first, to the fullest
    sequences it fits into, else to new ones. Sequences alike are one group, so
    the work depends on the number of groups and lengths only."""
    by_space: dict[int, list] = {}
    for times, key in groups:
        by_space.setdefault(capacity - sum(i * a for i, a in key), []).append((times, key))
    for size in range(capacity, 0, -1):
        need = int(left[size])
        while need:
            space = min((s for s, g in by_space.items() if s >= size and g), default=capacity)
            each = min(space // size, need)
            times, key = by_space[space].pop() if by_space.get(space) else (need // each, ())
            take = min(times, need // each)
            if take < times and key:
                by_space[space].append((times - take, key))
            fill = Counter(dict(key))
            fill[size] += each
            by_space.setdefault(space - each * size, []).append((take, tuple(sorted(fill.items(), reverse=True))))
            need -= take * each
    return [g for s in sorted(by_space) for g in by_space[s]]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every
    piece of every row.

    A row's ids are those of its text by the tokenizer file ``tokenizer`` (without
    special ids added; null texts are empty) and then ``end``, so an empty text is
    one piece of one id. Rows of more than ``capacity`` ids are cut into pieces of
    that length, the last may be shorter; other rows are one piece. Pieces of a
    sequence follow each other from offset 0 without gaps. Rows with null or
    repeated ids are packed like all others; pieces of equal length change places
    freely, so which of them goes where may depend on how the table is read. An
    empty table gives an empty result. Only doc_id and text are read. A text is
    held whole by one task.
    """
    made = materialize(pieces(docs, tokenizer, capacity, end))
    per = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = materialize(per.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    count = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        count[r["length"]] = r["n"]
    place = _places(plan(count, capacity)[0], count)

    def run(batches):
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(place["from"], place["first"][size] + rank, "right") - 1
            nth = place["first"][size] + rank - place["from"][at]
            copies = place["copies"][at]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(place["sequence"][at] + nth // copies), pa.array(place["offset"][at] + nth % copies * size)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(per.select("length", "part", "ahead"), ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    return ranked.mapInArrow(run, PIECE + ", sequence_id long, offset long")


def _places(groups: list, count: np.ndarray) -> dict[str, np.ndarray]:
    """For each configuration and length in it the ranks that it takes, the number
    of its first sequence and the offset there, by length and rank."""
    rows, taken, sequence = [], np.zeros(len(count), np.int64), 0
    for times, key in groups:
        offset = 0
        for size, copies in key:
            rows.append((size, int(taken[size]), copies, sequence, offset))
            taken[size] += times * copies
            offset += size * copies
        sequence += times
    if (taken != count).any():
        raise AssertionError("the plan does not use every piece once")
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    first = np.cumsum(count) - count
    return {"from": first[cols[0]] + cols[1], "copies": cols[2], "sequence": cols[3], "offset": cols[4], "first": first}
