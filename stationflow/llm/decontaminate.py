"""Benchmark decontamination with a stored positional inverted index.

:func:`write_index` stores the postings of all training tokens once, partitioned
by document: a row holds a document's distinct terms (word hashes, ascending),
their counts and their positions. Nothing is shuffled for it, so it grows as the
documents do, and a lost task writes its own rows again. Every later step reads
this table and no text.

The test windows are broadcast in blocks of at most ``BLOCK`` windows (13 words
each), so the size of a block is bounded whatever the benchmark's size. The terms
of a window are ordered by their count over the whole index; a search starts from
the list of the rarest term, shifts it by the term's offset in the window, and
keeps the starts that the shifted lists of the next rarest terms hold as well,
until all thirteen agree. Lists that agree within a distance give the proximity
matches. Each block is searched against the same index; only its marks are kept.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.shards import first_of
from stationflow.llm.text import LOWER, U64, covered, flat, owner, spread, words
from stationflow.session import materialize, work_path

WINDOW = 13
BLOCK = 1 << 17  # test windows in one broadcast
CHUNK = 1 << 20  # postings or words that are searched at once

# Bytes outside words: ASCII but for digits and (lower-cased) letters.
GAP = np.ones(256, bool)
GAP[ord("0"):ord("9") + 1] = False
GAP[ord("a"):ord("z") + 1] = False
GAP[ord("A"):ord("Z") + 1] = False
GAP[0x80:] = False

ROW_GROUP = 16 << 20  # bytes of the index that a writer holds
POSTINGS = "n_words long, terms binary, counts binary, positions binary"
MARKS = "hits array<int>, items array<string>, near array<struct<item:string,first:int,last:int>>"


def _tokens(col):
    data, offsets = flat(col)
    _, _, h, first = words(data, offsets, GAP, LOWER)
    return h, first


class Block:
    """Test windows in one broadcast: distinct windows, rarest term first."""

    def __init__(self, terms: list[np.ndarray], items: list[list[str]]):
        self.vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, U64)
        self.size = np.array([len(t) for t in terms], np.int64)
        self.width = int(self.size.max()) if terms else 1
        self.term = np.full((len(terms), self.width), -1, np.int64)
        for i, t in enumerate(terms):
            self.term[i, :len(t)] = np.searchsorted(self.vocabulary, t)
        self.names = sorted({x for xs in items for x in xs})
        number = {x: i for i, x in enumerate(self.names)}
        self.item_first = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)
        self.item = np.array([number[x] for xs in items for x in xs], np.int64)
        self.bits = max(10, math.ceil(math.log2(len(self.vocabulary) * 8 + 1)))
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.slot[(self.vocabulary >> U64(64 - self.bits)).astype(np.int64)] = np.arange(len(self.vocabulary))

    def rank_by(self, counts: np.ndarray) -> None:
        """Orders each window's terms by ascending count; padding comes last."""
        self.counts = counts
        c = np.where(self.term >= 0, counts[self.term], np.iinfo(np.int64).max)
        order = np.argsort(c, axis=1, kind="stable")
        self.offset = order
        self.term = np.take_along_axis(self.term, order, 1)

    def items_of(self, window: np.ndarray):
        """Number of items of each window, and the items, by window."""
        each = self.item_first[window + 1] - self.item_first[window]
        return each, self.item[spread(self.item_first[window], each)]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term number of each hash, -1 for words outside the test."""
        if not len(self.vocabulary):
            return np.full(len(h), -1, np.int64)
        t = self.slot[(h >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero((t >= 0) & (self.vocabulary[t] != h))
        if len(wrong):
            at = np.minimum(np.searchsorted(self.vocabulary, h[wrong]), len(self.vocabulary) - 1)
            t[wrong] = np.where(self.vocabulary[at] == h[wrong], at, -1)
        return t


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, terms (packed word hashes) of each window of each item; an item of
    fewer words is one window, one without words has none."""
    def cut(batches):
        for b in batches:
            h, first = _tokens(b.column("text"))
            item, terms = [], []
            for i, name in enumerate(b.column("item").to_pylist()):
                t = h[first[i]:first[i + 1]]
                for j in range(max(1, len(t) - window + 1) if len(t) else 0):
                    item.append(name)
                    terms.append(t[j:j + window].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(terms, pa.binary())], ["item", "terms"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, terms binary").distinct()


def write_index(docs: DataFrame) -> DataFrame:
    """Stores the index of ``docs`` (a column text and others) in the shared folder
    and reads it: for each row its columns but ``text``, its number of words, and
    for each of its terms (``terms``: 8-byte hashes, ascending) the number of
    positions (``counts``) and the positions, as packed 4-byte integers."""
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [POSTINGS])

    def index(batches):
        for b in batches:
            for part in _slices(b, b.column("text"), 4 << 20):
                h, first = _tokens(part.column("text"))
                term, number = np.unique(h, return_inverse=True)
                own = owner(first, np.arange(len(h)))
                key = (own.astype(np.int64) << 32) | number
                at = np.argsort(key, kind="stable")
                key, own = key[at], own[at]
                run = first_of(key)
                n = np.arange(part.num_rows + 1)
                run_first = np.searchsorted(own[run], n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep]
                    + [pa.array(np.diff(first)), _packed(term[key[run] & 0xFFFFFFFF], run_first),
                       _packed(np.diff(np.append(run, len(key))).astype(np.int32), run_first),
                       _packed((at - first[own]).astype(np.int32), np.searchsorted(own, n))],
                    keep + ["n_words", "terms", "counts", "positions"])

    path = work_path(docs.sparkSession, "postings")
    rows = docs.mapInArrow(index, schema)
    (rows.write.option("compression", "zstd").option("parquet.enable.dictionary", "false")
     .option("parquet.block.size", ROW_GROUP).parquet(path))
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * size).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _slices(batch, col, most: int):
    """Parts of a batch of about ``most`` bytes of one column, one row at least."""
    _, off = flat(col)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def term_counts(index: DataFrame, block: Block) -> np.ndarray:
    """Occurrences of each test term over the whole index; each task sends its sums."""
    n = len(block.vocabulary)

    def count(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            t = block.lookup(flat(b.column("terms"))[0].view(U64))
            c = flat(b.column("counts"))[0].view(np.int32)
            total += np.bincount(t[t >= 0], c[t >= 0], minlength=n).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(n, np.int64)
    for r in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def _search(block: Block, n_words, terms, counts, positions, near: int):
    """(window, start) of all occurrences and (window, first, last) of all proximity
    matches over the postings of some documents; places count all words of all
    documents, with a gap behind each document."""
    t, tf = flat(terms)
    p, pf = flat(positions)
    t = block.lookup(t.view(U64))
    c = flat(counts)[0].view(np.int32).astype(np.int64)
    gap = max(block.width, near) + 1
    base = np.concatenate(([0], np.cumsum(n_words + gap)))
    some = np.flatnonzero(t >= 0)
    at = spread((np.cumsum(c) - c)[some], c[some])
    key = (np.repeat(t[some], c[some]) << 40) | (np.repeat(base[owner(tf // 8, some)], c[some]) + p.view(np.int32)[at])
    key.sort()
    none = np.zeros(0, np.int64)
    if not len(key) or not len(block.term):
        return base, (none, none), (none, none, none)

    def lists(which):
        lo, hi = np.searchsorted(key, which << 40), np.searchsorted(key, (which + 1) << 40)
        return lo, hi - lo

    lo, n = lists(block.term[:, 0])
    window = np.repeat(np.arange(len(n)), n)
    at = key[spread(lo, n)] & ((1 << 40) - 1)
    start = at - block.offset[window, 0]
    exact, close, left, right = np.arange(len(at)), np.arange(len(at)), at, at
    for r in range(1, block.width):
        exact = exact[_held(key, block.term[window[exact], r], start[exact] + block.offset[window[exact], r])]
        found, place = _near(key, block.term[window[close], r], at[close], near)
        close, place = close[found], place[found]
        left, right = np.minimum(left[found], place), np.maximum(right[found], place)
    return base, (window[exact], start[exact]), (window[close], left, right)


def _held(key, term, place):
    want = (term << 40) | place
    got = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
    return got | (term < 0)


def _near(key, term, place, near):
    """Whether each term is within ``near`` words of its place, and where first;
    padding is at the place itself."""
    at = np.searchsorted(key, (term << 40) | np.maximum(place - near, 0))
    got = key[np.minimum(at, len(key) - 1)]
    held = (at < len(key)) & (got <= ((term << 40) | (place + near))) & (got >> 40 == term)
    return held | (term < 0), np.where(term < 0, place, got & ((1 << 40) - 1))


def search(index: DataFrame, block: Block, near: int = 2 * WINDOW) -> DataFrame:
    """Searches an index for one block: instead of the postings its rows get
    ``hits`` (positions of words under an occurrence), ``items`` (items with an
    occurrence) and ``near`` (proximity matches: item, and the positions of the
    first and last word). A proximity match has all words of a window within
    ``near`` words of one of its rarest word; the narrowest of each window and
    document is returned, of equal ones the first."""
    keep = [c for c in index.columns if c not in ("terms", "counts", "positions")]
    schema = ", ".join([f"`{c}` {index.schema[c].dataType.simpleString()}" for c in keep] + [MARKS])
    names = pa.array(block.names, pa.string())

    def run(batches):
        for b in batches:
            for part in _slices(b, b.column("positions"), 4 * CHUNK):
                n_words = part.column("n_words").to_numpy().astype(np.int64)
                base, (w, s), (cw, left, right) = _search(block, n_words, part.column("terms"), part.column("counts"), part.column("positions"), near)
                rows = np.arange(part.num_rows + 1)
                under = np.flatnonzero(covered(s, block.size[w], int(base[-1]) + 1)) if len(s) else np.zeros(0, np.int64)
                own = owner(base, under)
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, rows), pa.int32()), pa.array(under - base[own], pa.int32()))
                each, item = block.items_of(w)
                pair = np.unique((np.repeat(owner(base, s), each) << 32) | item)
                items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair >> 32, rows), pa.int32()), names.take(pa.array(pair & 0xFFFFFFFF)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [hits, items, _spans(block, names, base, cw, left, right)],
                                                 keep + ["hits", "items", "near"])

    return index.mapInArrow(run, schema)


def _spans(block: Block, names: pa.Array, base, window, left, right) -> pa.Array:
    """Proximity matches by document, each once, by item and place."""
    own = owner(base, left)
    order = np.lexsort((left, right - left, window, own))
    order = order[first_of((own[order] << 32) | window[order])]
    each, item = block.items_of(window[order])
    own, left, right = (np.repeat(x[order], each) for x in (own, left, right))
    order = np.lexsort((right, left, item, own))
    same = np.zeros(len(order), bool)
    same[1:] = np.all([x[order][1:] == x[order][:-1] for x in (own, item, left, right)], axis=0)
    order = order[~same]
    own = own[order]
    match = pa.StructArray.from_arrays([names.take(pa.array(item[order])), pa.array(left[order] - base[own], pa.int32()), pa.array(right[order] - base[own], pa.int32())],
                                       ["item", "first", "last"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(base))), pa.int32()), match)


def _blocks(windows: DataFrame, parts: int):
    """The windows in ``parts`` blocks by hash, one held at a time."""
    for i in range(parts):
        some = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("terms"), F.lit(parts)) == i)
        got = sorted((bytes(r["terms"]), sorted(r["names"])) for r in some.toLocalIterator())
        yield Block([np.frombuffer(t, U64) for t, _ in got], [x for _, x in got])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = 2 * WINDOW,
                  block_windows: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """Marks of every row of ``docs`` (all its columns stay, but for ``text`` with
    ``keep_text`` off): _n_words, _hits (array of hit word positions), _items
    (ids of items with an occurring window, sorted as strings), _near (proximity
    matches, see :func:`search`).

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters.
    Null and empty texts have no words and no marks; benchmark rows without words
    have no windows; a null item_id reads as an empty string; an empty benchmark
    marks nothing; no documents give no rows. Repeated rows are marked alike, each
    on its own. A text is indexed whole by one task. Columns of ``docs`` named like
    the marks are replaced by them, other extra columns pass.
    """
    marks = ["_n_words", "_hits", "_items", "_near"]
    windows = materialize(test_windows(benchmark, window).groupBy("terms").agg(F.collect_set("item").alias("names")))
    parts = max(1, math.ceil(windows.count() / block_windows))
    kept = [c for c in docs.columns if c not in marks and (keep_text or c != "text")]
    index = write_index(docs.select(F.monotonically_increasing_id().alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
                                    F.col("text").cast("string").alias("text")))
    narrow = index.select("key", *[c.split()[0] for c in POSTINGS.split(", ")])
    found = []
    for block in _blocks(windows, parts):
        block.rank_by(term_counts(index, block))
        if parts == 1:
            marked = search(index, block, near)
        else:
            some = search(narrow, block, near).where((F.size("hits") > 0) | (F.size("near") > 0))
            found.append(materialize(some.select("key", "hits", "items", "near")))
    if parts > 1:
        every = functools.reduce(DataFrame.unionByName, found).groupBy("key").agg(
            *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near")])
        rows = index.drop("terms", "counts", "positions").join(every, "key", "left")
        marked = rows.withColumns({c: F.coalesce(c, F.array().cast(every.schema[c].dataType)) for c in ("hits", "items", "near")})
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("n_words").alias("_n_words"), F.col("hits").alias("_hits"),
                         F.array_sort("items").alias("_items"), F.array_sort("near").alias("_near"))


def verdicts(marked: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items, the number of proximity matches, and the
    verdict: contaminated if a word is hit and 20 times the hit words are at least
    the words."""
    n = F.size("_hits").cast("long")
    return marked.select("doc_id", F.col("_n_words").alias("n_words"), n.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                         F.col("_items").alias("items"), ((n > 0) & (20 * n >= F.col("_n_words"))).alias("contaminated"), F.size("_near").cast("long").alias("n_near"))
