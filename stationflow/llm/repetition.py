"""Quality rules on repetition, from suffix arrays over words.

The words of a batch of texts form one array, salted by text so that no two
texts share a word. Its suffix array comes from Larsson-Sadakane refinement
(each round doubles the sorted depth and sorts only suffixes that are still
tied), the common prefixes from Kasai's rule: the prefix shared at place i is
at least that at i - 1 less one, so only places where the rule starts anew are
compared. A maximal interval of suffixes with a common prefix of n words is a
maximal repeated substring; a place's longest one is the larger of its common
prefixes with the suffix before and after it. The spans of all repeats of a
least length are joined; the rules limit the fraction of words under them and
the longest repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.text import BASE, SPACE, U64, _inverse_powers, _powers, flat, mix, spans_hash, word_spans

# Fixed values of the base rules.
BASE_WINDOW = 5
BASE_WORDS = 10
BASE_PERCENT = 20
SYMBOLS = "#*$%&|<>"
# Limits of the method.
MIN_REPEAT = 10
MAX_FRACTION = 0.15
MAX_REPEAT = 100
PART = 1 << 20  # bytes of text that are sorted at once

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[ord("\n")] = True

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_long_repeat_words long, longest_repeat long")


def suffix_array(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of an array of numbers, and the rank of each place."""
    n = len(sym)
    sa = np.argsort(sym, kind="stable")
    tied = sym[sa]
    new = np.ones(n, bool)
    new[1:] = tied[1:] != tied[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    slots = np.flatnonzero(~(new & np.append(new[1:], True))) if n else np.zeros(0, np.int64)
    depth = 1
    while len(slots):
        items = sa[slots]
        key = (rank[items].astype(U64) << U64(32)) | rank[np.minimum(items + depth, n)].astype(U64)
        order = np.argsort(key, kind="stable")
        key, items = key[order], items[order]
        sa[slots] = items
        turn = np.ones(len(slots), bool)
        turn[1:] = key[1:] != key[:-1]
        new[slots] = turn
        rank[items] = slots[np.maximum.accumulate(np.where(turn, np.arange(len(slots)), 0))] + 1
        slots = slots[~(turn & np.append(turn[1:], True))]
        depth *= 2
    return sa, rank[:n] - 1


def common_prefixes(sym: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each place's suffix with the one before it in ``sa``, by
    place. Where the symbols in front of both agree, Kasai's rule gives it from
    the place before; elsewhere a binary search over prefix hashes does."""
    n = len(sym)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ruled = np.zeros(n, bool)
    ruled[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (sym[:-1] == sym[np.maximum(before[1:] - 1, 0)]) & (before[1:] >= 0)
    fresh = np.flatnonzero(~ruled)
    a, b = fresh, before[fresh]
    got = np.zeros(len(fresh), np.int64)
    live = np.flatnonzero(b >= 0)
    live = live[sym[a[live]] == sym[b[live]]]
    acc = np.zeros(n + 1, U64)
    np.cumsum(mix(sym + U64(BASE)) * _powers(n), out=acc[1:])
    inv = _inverse_powers(n + 1)

    def same(i, size):
        x, y = a[i], b[i]
        return (acc[x + size] - acc[x]) * inv[x] == (acc[y + size] - acc[y]) * inv[y]

    got[live] = 1
    step = 1
    growing = live
    while len(growing):  # doubles while all symbols agree
        room = np.maximum(a[growing], b[growing]) + 2 * step <= n
        growing = growing[room]
        growing = growing[same(growing, 2 * step)]
        step *= 2
        got[growing] = step
    low = got[live]
    high = np.minimum(2 * low, n + 1 - np.maximum(a[live], b[live]))  # differs or ends below this
    while np.any(high - low > 1):
        mid = (low + high) // 2
        ok = same(live, mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid)
    got[live] = low
    lcp = np.zeros(n, np.int64)
    lcp[fresh] = got
    last = np.maximum.accumulate(np.where(ruled, 0, np.arange(n)))
    return np.maximum(lcp[last] - (np.arange(n) - last), 0)


def longest_repeats(sym: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring from it that occurs
    again in ``sym``."""
    sa, rank = suffix_array(sym)
    lcp = common_prefixes(sym, sa)
    after = np.zeros(len(sym), np.int64)
    after[sa[:-1]] = lcp[sa[1:]]
    return np.maximum(lcp, after)


def _under(rep: np.ndarray, least: int) -> np.ndarray:
    """Places under a repeat of ``least`` symbols or more."""
    reach = np.where(rep >= least, np.arange(len(rep)) + rep, 0)
    return np.maximum.accumulate(reach) > np.arange(len(rep)) if len(rep) else np.zeros(0, bool)


def _sums(flags, offsets):
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _facts(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    n = len(offsets) - 1
    s, e = word_spans(data, offsets)
    first = np.searchsorted(s, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    salt = mix(np.arange(1, n + 1).astype(U64))
    sym = spans_hash(data, s, e) ^ salt[doc]
    rep = longest_repeats(sym)
    in_word = np.zeros(len(data) + 1, np.int32)
    in_word[s] += 1
    np.add.at(in_word, e, -1)
    chars = (np.cumsum(in_word[:-1]) > 0) & ((data & 0xC0) != 0x80)
    ls, le = word_spans(data, offsets, _NEWLINE)
    with_word = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[with_word], le[with_word]
    lf = np.searchsorted(ls, offsets)
    ld = np.repeat(np.arange(n), np.diff(lf))
    line = spans_hash(data, ls, le) ^ salt[ld]
    _, at = np.unique(line, return_index=True)
    distinct = np.bincount(ld[at], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, rep)
    values = [np.diff(first), _sums(chars, offsets), _sums(_SYMBOL[data], offsets), np.diff(lf) - distinct,
              _sums(_under(rep, BASE_WINDOW), first), _sums(_under(rep, MIN_REPEAT), first), longest]
    return pa.RecordBatch.from_arrays([ids] + [pa.array(v.astype(np.int64)) for v in values],
                                      [c.split()[0] for c in SCHEMA.split(", ")])


def repetition_facts(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of SCHEMA for every row of ``docs`` (other columns
    than doc_id and text are not read). Null and empty texts have no words and
    zeros; repeated rows are measured each on their own; a null doc_id stays
    null. A text is held whole by one task."""
    def run(batches):
        for b in batches:
            data, offsets = flat(b.column("text"))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1)
                yield _facts(b.column("doc_id").slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                i = j

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*cols).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The measures, base_failed and kept. base_failed: fewer than 10 words, or
    over 20 % of the words in repeated five-word windows. kept: not base_failed,
    at most ``max_fraction`` of the words under repeats of ten words or more, and
    no repeat longer than ``max_repeat`` words."""
    f = repetition_facts(docs)
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    fine = (F.col("n_long_repeat_words") <= max_fraction * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return f.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
