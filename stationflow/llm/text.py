"""Array helpers for texts inside Arrow tasks: flat UTF-8 bytes, words, hashes.

Spans of bytes are hashed by mixing in eight bytes at a time, very long ones by
BLAKE2b; short windows of symbols (up to some dozens) by a polynomial modulo
2**64 that ends in a bit mix. Hashes depend on content alone, so that tasks on
different executors agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

# Whitespace of the word definition [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mix of a uint64 array (splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


# One 64-bit symbol per byte value.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def owner(offsets: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(offsets, pos, "right") - 1


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), BASE, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _inverse_powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), pow(BASE, -1, 1 << 64), U64)
    p[0] = 1
    return np.multiply.accumulate(p)


LONG_SPAN = 1 << 12  # bytes from which a span is hashed on its own
SPANS = 1 << 16  # spans hashed at once


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Hash of each byte span [start, end), of bytes as ``fold`` maps them. Every
    eight bytes are mixed into the hash of those before, so that no arrangement
    of the same bytes cancels out as it can in a polynomial. Work is in blocks of
    spans, so that what it holds besides the result stays small."""
    out = np.empty(len(start), U64)
    for at in range(0, len(start), SPANS):
        out[at:at + SPANS] = _hash_block(data, start[at:at + SPANS], end[at:at + SPANS], fold)
    return out


def _hash_block(data, start, end, fold):
    size = end - start
    out = mix(size.astype(U64) * U64(BASE) + U64(0xD6E8FEB86659FD93))
    every = np.flatnonzero(size < LONG_SPAN)
    if len(every):
        lo, hi = int(start[every].min()), int(end[every].max())
        some = np.zeros(hi - lo + 8, np.uint8)
        some[:hi - lo] = data[lo:hi] if fold is None else fold[data[lo:hi]]
        eight = np.ndarray(hi - lo + 1, "<u8", some, strides=(1,))  # the eight bytes from each place
        every = every[np.argsort(-size[every], kind="stable")]
        rank = -size[every]
        for k in range(0, int(-rank[0]), 8):
            at = every[:np.searchsorted(rank, -k, "left")]  # spans of more than k bytes
            rest = size[at] - k
            x = eight[start[at] + (k - lo)]
            short = rest < 8
            x[short] &= (U64(1) << (rest[short].astype(U64) * U64(8))) - U64(1)
            out[at] = mix((out[at] ^ mix(x + U64(BASE))) * U64(0xC2B2AE3D27D4EB4F) + U64(k + 1))
    for i in np.flatnonzero(size >= LONG_SPAN):
        x = data[start[i]:end[i]]
        out[i] = int.from_bytes(hashlib.blake2b((x if fold is None else fold[x]).tobytes(), digest_size=8).digest(), "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """(start, end) of every maximal run of bytes outside ``gap``; a run ends at
    the end of its text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data, offsets, gap=SPACE, fold=None):
    """Words of all texts: start, end, hash and the offsets of each text's words."""
    s, e = word_spans(data, offsets, gap)
    return s, e, spans_hash(data, s, e, fold), np.searchsorted(s, offsets)


def grams(sym: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position (length n - k + 1), unmixed;
    by doubling, so that no power grows with the position. For windows of some
    dozens of symbols: sequences that cancel out in such a polynomial have
    hundreds."""
    if len(sym) < k:
        return np.zeros(0, U64)
    power, size, acc, done = sym, 1, None, 0
    while True:
        if k & size:
            if acc is None:
                acc, done = power, size
            else:
                n = len(sym) - done - size + 1
                acc = acc[:n] * U64(pow(BASE, size, 1 << 64)) + power[done:done + n]
                done += size
        size *= 2
        if size > k:
            return acc[:len(sym) - k + 1]
        half = size // 2
        n = len(sym) - size + 1
        power = power[:n] * U64(pow(BASE, half, 1 << 64)) + power[half:half + n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of w consecutive entries from each position."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def window_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    """Whether a whole window of ``size`` symbols of one text starts at each position."""
    n = int(offsets[-1])
    edge = np.zeros(n + 1, np.int32)
    lo = np.maximum(offsets[:-1], offsets[1:] - size + 1)
    np.add.at(edge, lo, 1)
    np.add.at(edge, offsets[1:], -1)
    return np.cumsum(edge[:n]) == 0


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Positions under any of the spans [start, start + size)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:n]) > 0


def anchors(sym: np.ndarray, valid: np.ndarray, window: int, k: int):
    """The minimal k-gram of every window, a choice by content alone: equal
    windows choose equal grams at equal places. Returns, for each run of
    windows with one choice, the first window, the number of windows from it
    on, and the hash of the gram. Work is in blocks; a run may be cut there."""
    first, length, key = [], [], []
    n, block, low = len(sym) - window + 1, 1 << 18, U64((1 << 19) - 1)
    for at in range(0, max(n, 0), block):
        to = min(n, at + block)
        h = mix(grams(sym[at:to + window - 1], k))
        packed = (h & ~low) | np.arange(len(h), dtype=U64)
        m = sliding_min(packed, window - k + 1) & low
        ok = valid[at:to]
        turn = np.empty(len(m), bool)
        turn[0] = True
        turn[1:] = (m[1:] != m[:-1]) | (ok[1:] != ok[:-1])
        i = np.flatnonzero(turn)
        long = np.diff(np.append(i, len(m)))
        keep = ok[i]
        i, long = i[keep], long[keep]
        first.append(i + at)
        length.append(long)
        key.append(h[m[i].astype(np.int64)])
    join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return join(first, np.int64), join(length, np.int64), join(key, U64)


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the runs [first, first + length)."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(first - (ends - length), length)
