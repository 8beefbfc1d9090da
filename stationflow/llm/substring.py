"""Substring deduplication by phrases, after relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. All reference
blocks (shards) index the phrases of 50 words that they hold; a document's
phrases are looked up against all of them, each by its hash. This replaces the
greedy parse: the words that go are those under a repeated phrase, so that a
passage that is cut between two sources is still found whole. Factors only
report sources: a run of phrases whose holder with the least id is one document
is a factor, also where an earlier factor's source would go on, and neighbouring
factors may overlap by 49 words. They have 50 words at least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stationflow.llm import windows as W
from stationflow.llm.shards import SHARD_BYTES, Shard
from stationflow.llm.text import covered, grams, mix, spread, words

PHRASE = 50
SCHEMA = ("doc_id long, n_words long, n_removed long, kept string, "
          "factors array<struct<start:long,n_words:long,source:long>>")


def _symbols(shard: Shard):
    _, _, sym, offsets = words(shard.data, shard.offsets)
    return sym, offsets


def _groups(shard, sym, starts, size):
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, group = np.unique(mix(grams(sym, size)[starts]), return_inverse=True)
    return keys, group


def strings(data: np.ndarray, ends: np.ndarray, kind=pa.string()) -> pa.Array:
    """Arrow strings that end at ``ends`` of the flat bytes; plain offsets take
    2 GB, beyond that the large kind is cut back by Spark's schema."""
    off = np.concatenate(([0], ends))
    big = off[-1] >= 1 << 31
    kind = (pa.large_string() if kind == pa.string() else pa.large_binary()) if big else kind
    bufs = [None, pa.py_buffer(off.astype(np.int64 if big else np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(kind, len(ends), bufs)


def joined(data, start, end, first) -> tuple[np.ndarray, np.ndarray]:
    """Words [start, end) joined by one space; word offsets ``first`` by text.
    Returns the bytes and where each text ends."""
    long = end - start + 1
    has = np.diff(first) > 0
    last = first[1:][has] - 1
    long[last] -= 1
    at = np.concatenate(([0], np.cumsum(long)))
    out = np.full(at[-1], 32, np.uint8)
    size = end - start
    out[spread(at[:-1], size)] = data[spread(start, size)]
    return out, at[first[1:]]


def _out(shard: Shard, w: W.Windows) -> pa.Table:
    s, e, _, offsets = words(shard.data, shard.offsets)
    _, starts, own, source = W.repeats(shard, w)
    n = np.diff(offsets)
    gone = covered(starts, w.size, len(s))
    for i in np.flatnonzero(shard.copy & (n >= w.size)):
        gone[offsets[i]:offsets[i + 1]] = True
    kept = np.flatnonzero(~gone)
    text, ends = joined(shard.data, s[kept], e[kept], np.searchsorted(kept, offsets))
    # factors: runs of consecutive phrases with one source
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (source[1:] != source[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(starts))) + w.size - 1
    facts = pa.StructArray.from_arrays([pa.array(starts[at] - offsets[own[at]]), pa.array(length), pa.array(source[at])],
                                       ["start", "n_words", "source"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[at], np.arange(len(n) + 1)), pa.int32()), facts)
    before = np.concatenate(([0], np.cumsum(gone)))
    return pa.table({"doc_id": shard.doc_id, "n_words": n, "n_removed": before[offsets[1:]] - before[offsets[:-1]],
                     "kept": strings(text, ends), "factors": lists})


def dedup_substrings(docs: DataFrame, phrase: int = PHRASE, gram: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Removes every word under a window of ``phrase`` words that also starts in
    a document with a smaller doc_id; windows are judged on the input.

    Reads ``doc_id`` and ``text``; other columns are not read, whatever their
    names. One row for each input row: doc_id, n_words, n_removed, kept (the
    words that stay, joined by one space) and factors (start and length in
    words, and the source's doc_id). A document that is a whole copy of an
    earlier one has no factors: all of its words go, if it has ``phrase`` words.

    A null or empty text has no words and keeps an empty text. A null doc_id
    counts as larger than all others. Rows with one doc_id are not sources for
    each other. An empty table gives an empty result. A text is held whole by
    one task, with about 40 times its size in arrays.
    """
    gram = gram or max(1, phrase // 5)
    w = W.Windows(phrase, gram, _symbols, lambda sh, sym, st: _groups(sh, sym, st, phrase), True)
    return W.run(docs, w, _out, SCHEMA, 2 * phrase - 1, shard_bytes)
