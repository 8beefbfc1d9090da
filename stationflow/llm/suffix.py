"""Exact substring deduplication with suffix arrays.

Behind the sieve of :mod:`windows`, stretches of text that an earlier document
holds whole are settled by their hash. Where copies differ in part, each shard
sorts the suffixes of the text that may be repeated: Larsson-Sadakane refinement, where suffixes are first
sorted by a few symbols and then only the groups that are still tied are sorted
again by the rank of the suffix that begins where the sorted prefix ends.
Common prefixes of neighbours, compared directly up to the window in place of
Kasai's rule, cut the sorted list into groups of equal windows. Suffix arrays of
different shards are not merged: the groups meet by 64-bit hash in key order,
and a group with a smaller id elsewhere is repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stationflow.llm import windows as W
from stationflow.llm.shards import Shard
from stationflow.llm.substring import strings
from stationflow.llm.text import BYTE, U64, covered, grams, mix, spans_hash, spread

WINDOW = 50
PACKED = 7  # symbols of 9 bits in one uint64
SCHEMA = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,stop:long>>"


def packed(sym: np.ndarray) -> np.ndarray:
    """Seven symbols (0 to 256) from each place as one number; 0 beyond the end."""
    x = np.concatenate((sym.astype(U64), np.zeros(PACKED, U64)))
    out = np.zeros(len(sym), U64)
    for j in range(PACKED):
        out = (out << U64(9)) | x[j:j + len(sym)]
    return out


def suffix_array(sym: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``sym`` sorted by their first ``depth`` symbols at least (ties in
    any order). Symbols are 0 to 256."""
    n = len(sym)
    head = packed(sym)
    sa = np.argsort(head, kind="stable")
    tied = head[sa]
    new = np.ones(n, bool)
    new[1:] = tied[1:] != tied[:-1]
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)  # 0 for the end of the text
    rank[sa] = slot + 1
    rank[n] = 0
    done = PACKED
    while done < depth:
        shift = min(done, depth - done)
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        items = sa[slots]
        key = (rank[items].astype(U64) << U64(32)) | rank[np.minimum(items + shift, n)].astype(U64)
        order = np.argsort(key, kind="stable")
        key, items = key[order], items[order]
        sa[slots] = items
        turn = np.ones(len(slots), bool)
        turn[1:] = key[1:] != key[:-1]
        new[slots] = turn
        rank[items] = slots[np.maximum.accumulate(np.where(turn, np.arange(len(slots)), 0))] + 1
        done += shift
    return sa


def common_prefixes(sym: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``sa``,
    up to ``most``: all neighbours at once, seven symbols a step, going on only
    where all were equal so far."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    head = np.concatenate((packed(sym), np.zeros(1, U64)))
    live = np.arange(1, n)
    for at in range(0, most, PACKED):
        a = head[np.minimum(sa[live] + at, n)]
        b = head[np.minimum(sa[live - 1] + at, n)]
        same = a == b
        part = live[~same]
        x = a[~same] ^ b[~same]
        top = np.full(len(x), 0, np.int64)
        for j in range(1, PACKED):  # whole symbols that agree
            top += (x >> U64(9 * (PACKED - j))) == 0
        lcp[part] = at + top
        live = live[same]
        lcp[live] = at + PACKED
    return np.minimum(lcp, most)


def _symbols(shard: Shard):
    return BYTE[shard.data], shard.offsets


def _groups(shard: Shard, sym: np.ndarray, starts: np.ndarray, size: int):
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    starts_sorted = starts if np.all(np.diff(starts) > 0) else np.unique(starts)
    cut = np.flatnonzero(np.diff(starts_sorted, prepend=-2) != 1)
    begin = starts_sorted[cut]
    long = np.diff(np.append(cut, len(starts_sorted)))
    # candidate text: regions of windows, each with a 0 behind it
    region = long + size - 1
    at = np.concatenate(([0], np.cumsum(region + 1)))
    text = np.zeros(at[-1], np.uint16)
    text[spread(at[:-1], region)] = shard.data[spread(begin, region)].astype(np.uint16) + 1
    place = spread(at[:-1], long)  # of each window's start
    sa = suffix_array(text, size)
    number = np.cumsum(common_prefixes(text, sa, size) < size) - 1
    group_of = np.empty(len(text), np.int64)
    group_of[sa] = number
    used, first, group = np.unique(group_of[place], return_index=True, return_inverse=True)
    table = np.concatenate((np.zeros(1, U64), BYTE))
    keys = mix(grams(table[text], size)[place[first]])
    order = np.argsort(keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    group = rank[group]
    if starts_sorted is not starts:
        group = group[np.searchsorted(starts_sorted, starts)]
    return keys[order], group


def _out(shard: Shard, w: W.Windows) -> pa.Table:
    offsets, starts, _, _ = W.repeats(shard, w)
    n = np.diff(offsets)
    gone = covered(starts, w.size, len(shard.data))
    for i in np.flatnonzero(shard.copy & (n >= w.size)):
        gone[offsets[i]:offsets[i + 1]] = True
    before = np.concatenate(([0], np.cumsum(gone)))
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(gone)]
    begin[edge] = gone[edge]
    stop = gone.copy()
    stop[:-1] &= ~gone[1:]
    edge = offsets[1:-1]
    edge = edge[edge > 0] - 1
    stop[edge] = gone[edge]
    b, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(b, offsets)
    base = np.repeat(offsets[:-1], np.diff(first))
    spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()),
                                     pa.StructArray.from_arrays([pa.array(b - base), pa.array(e - base)], ["start", "stop"]))
    kept = shard.data[~gone]
    return pa.table({"doc_id": shard.doc_id, "n_bytes": n, "n_removed": before[offsets[1:]] - before[offsets[:-1]],
                     "kept": strings(kept, offsets[1:] - before[offsets[1:]], pa.binary()), "spans": spans})


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = 0, shard_bytes: int = 2 << 20) -> DataFrame:
    """Removes every byte under a ``window`` of bytes that also starts in a
    document with a smaller doc_id; overlaps count, matches never cross
    documents, windows are judged on the input.

    Reads ``doc_id`` and ``text`` (UTF-8); other columns are not read. One row
    for each input row: doc_id, n_bytes, n_removed, kept (bytes) and spans
    (maximal removed runs, end exclusive). A null or empty text has no bytes and
    no spans. A null doc_id counts as larger than all others; rows with one
    doc_id are not sources for each other. An empty table gives an empty result.
    A text is held whole by one task, with about 40 times its size in arrays.
    """
    gram = gram or max(1, window * 12 // 25)
    w = W.Windows(window, gram, _symbols, lambda sh, sym, st: _groups(sh, sym, st, window),
                  stretches=lambda sh, start, end: spans_hash(sh.data, start, end))
    return W.run(docs, w, _out, SCHEMA, window, shard_bytes)
