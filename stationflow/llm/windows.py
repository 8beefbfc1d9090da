"""Windows of consecutive symbols that also start in a document with a smaller
id: the part that relative Lempel-Ziv and suffix-array deduplication share.

Round one is a sieve. Every window chooses one of its k-grams by content, so
two equal windows choose equal grams at equal places; a window whose gram is in
one document only is in one document only. The last round is exact: the windows
that are left are grouped within each shard (by the operator's own method) and
the groups of all shards meet by key range.

Between them there may be a round for stretches, the runs of windows that chose
one gram. A stretch that an earlier document holds whole is repeated whole; one
whose gram has no other stretch anywhere has no window elsewhere. What is left
are stretches that differ in part, and only their windows go on: the earliest
document with a window always sends it, as no earlier one holds its stretch.

Keys are 64-bit hashes, compared within one key range: the chance that two
different windows are taken for one is about n**2 / 2**65 for n windows behind
the sieve.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from stationflow.llm import shards as S
from stationflow.llm.text import U64, anchors, owner, spread, window_starts


@dataclass(frozen=True)
class Windows:
    """``symbols(shard)`` -> (uint64 symbols, offsets of each document's symbols);
    ``groups(shard, symbols, starts)`` -> (key, group number of each start), groups
    numbered by ascending key."""

    size: int
    gram: int
    symbols: Callable
    groups: Callable
    sources: bool = False
    stretches: Callable | None = None  # (shard, starts, ends) -> hash of each span of symbols


def _kept(shard: S.Shard, offsets: np.ndarray, w: Windows) -> np.ndarray:
    valid = window_starts(offsets, w.size)
    for i in np.flatnonzero(shard.copy):
        valid[offsets[i]:offsets[i + 1]] = False
    return valid


def _grams(shard: S.Shard, w: Windows):
    sym, offsets = w.symbols(shard)
    first, length, key = anchors(sym, _kept(shard, offsets, w), w.size, w.gram)
    key &= ~U64(0xFFFF)
    order = np.argsort(key, kind="stable")
    at = S.first_of(key[order])
    return sym, offsets, first, length, key, order, at


def sieve(shard: S.Shard, w: Windows):
    _, offsets, first, _, key, order, at = _grams(shard, w)
    doc = owner(offsets, first[order])
    last = np.append(at[1:], len(doc)) - 1
    several = doc[at] != doc[last] if len(at) else np.zeros(0, bool)
    return key[order][at], several, 6


def _hits(shard: S.Shard, w: Windows):
    """Symbols, document offsets, and the runs of windows behind the sieve."""
    sym, offsets, first, length, key, order, at = _grams(shard, w)
    common = shard.answer(1)
    hit = np.zeros(len(key), bool)
    hit[order] = np.repeat(common, np.diff(np.append(at, len(key)))) if len(at) else False
    return sym, offsets, first[hit], length[hit], key[hit]


def _stretches(shard: S.Shard, w: Windows, offsets, first, length, key):
    """Distinct stretches by gram and hash: gram, hash, least id, and the number
    of the stretch of each run."""
    whole = w.stretches(shard, first, first + length + w.size - 1)
    own = shard.ids[owner(offsets, first)]
    order = np.lexsort((own, whole, key))
    k, h = key[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return k[new], h[new], own[order][new], number, own


def stretch_round(shard: S.Shard, w: Windows):
    _, offsets, first, length, key = _hits(shard, w)
    k, h, least, _, _ = _stretches(shard, w, offsets, first, length, key)
    return k, h.view(np.int64), least, 8


EARLIER, SEVERAL = 1, 2


def stretch_answers(keys, hashes, least):
    """Of each stretch whether another shard holds it under a smaller id, and
    whether its gram has several stretches."""
    k, h, d = np.concatenate(keys), np.concatenate(hashes), np.concatenate(least)
    order = np.lexsort((h, k))
    ks, hs = k[order], h[order]
    new = np.ones(len(k), bool)
    new[1:] = (ks[1:] != ks[:-1]) | (hs[1:] != hs[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return [np.zeros(0, np.uint8) for _ in keys]
    first = np.repeat(np.minimum.reduceat(d[order], at), np.diff(np.append(at, len(k))))
    gram = S.first_of(ks)
    kinds = np.repeat(np.add.reduceat(new.astype(np.int64), gram), np.diff(np.append(gram, len(k))))
    code = np.empty(len(k), np.uint8)
    code[order] = EARLIER * (first < d[order]) + SEVERAL * (kinds > 1)
    return np.split(code, np.cumsum([len(x) for x in keys])[:-1])


def _candidates(shard: S.Shard, w: Windows):
    """Symbols, document offsets, starts of windows that are known to be repeated,
    and the starts of undecided windows with their groups' keys, group numbers
    and owners."""
    sym, offsets, first, length, key = _hits(shard, w)
    known = np.zeros(0, np.int64)
    if w.stretches:
        _, _, least, number, own = _stretches(shard, w, offsets, first, length, key)
        code = shard.answer(3, np.uint8)[number] if len(number) else np.zeros(0, np.uint8)
        again = (own > least[number]) | (code & EARLIER > 0) if len(number) else np.zeros(0, bool)
        known = spread(first[again], length[again])
        rest = ~again & (code & SEVERAL > 0)
        first, length = first[rest], length[rest]
    starts = spread(first, length)
    keys, group = w.groups(shard, sym, starts)
    return sym, offsets, known, starts, keys, group, owner(offsets, starts)


def _least(shard, group, own, n):
    least = np.full(n, S.NO_ID, np.int64)
    np.minimum.at(least, group, shard.ids[own])
    return least


def meet(shard: S.Shard, w: Windows):
    _, _, _, _, keys, group, own = _candidates(shard, w)
    return keys, _least(shard, group, own, len(keys)), 8


def earlier(keys, vals):
    """Whether another shard holds the key under a smaller id."""
    return [least < mine for least, mine in zip(S.least_values(keys, vals), vals)]


def repeats(shard: S.Shard, w: Windows):
    """(document offsets, starts of repeated windows, their documents and the ids
    of their sources, if the operator asks for them)."""
    _, offsets, known, starts, _, group, own = _candidates(shard, w)
    answer = shard.answer(2)
    if w.sources:
        source = answer[group] if len(group) else np.zeros(0, np.int64)
        again = shard.ids[own] > source
        return offsets, starts[again], own[again], source[again]
    least = _least(shard, group, own, len(answer))
    again = (shard.ids[own] > least[group]) | answer[group] if len(group) else np.zeros(0, bool)
    return offsets, np.concatenate((known, starts[again])), None, None


def run(docs: DataFrame, w: Windows, out, schema: str, min_bytes: int, shard_bytes: int = S.SHARD_BYTES,
        bucket_bytes: int = S.BUCKET_BYTES) -> DataFrame:
    """``out(shard, windows)`` -> Arrow table of each shard's documents."""
    sh = S.Shards(docs, min_bytes, shard_bytes, bucket_bytes)
    told = sh.answers()
    one = sh.ask(told, lambda s: sieve(s, w), S.seen_twice, 1)
    told = sh.answers(one)
    if w.stretches:
        told = told.unionByName(sh.ask(told, lambda s: stretch_round(s, w), stretch_answers, 3))
    two = sh.ask(told, lambda s: meet(s, w), S.least_values if w.sources else earlier, 2)
    return sh.each(told.unionByName(two), lambda s: out(s, w), schema)
