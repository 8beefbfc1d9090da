"""Shards of documents, and keys that meet across shards.

A shard is a bounded group of whole documents, dealt by a hash of the id (of the
text, where the id is null). A
round over all shards has two shuffles of packed arrays: every shard sends its
distinct keys, sorted and cut by key range into buckets; a bucket merges the
sorted lists by binary search and answers each shard in the order in which it
asked. A key appears at most once for each shard, however many documents hold
it, so a hot key never makes a hot task. Lost tasks are recomputed from the
shuffled texts; what is used more than once is checkpointed in the shared
folder.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.text import U64, flat
from stationflow.session import materialize

SHARD_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
NO_ID = (1 << 63) - 1  # stands for a null doc_id: larger than any other

ANSWERS = "shard int, kind int, bucket int, num long, blob binary"
ASKED = "bucket int, shard int, keys binary, vals binary"


class Shards:
    """``docs`` (doc_id, text; other columns are not read) dealt into shards.

    ``copies_from``: whole copies of at least so many bytes are found by digest
    first; all but those with the smallest id are told to their shards, as rows
    of kind 0 with the id as num and the digest as blob. Ids need not be unique:
    a row is a copy only if id and digest are told together.
    """

    def __init__(self, docs: DataFrame, copies_from: int = 0, shard_bytes: int = SHARD_BYTES,
                 bucket_bytes: int = BUCKET_BYTES):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        salt = F.coalesce(F.when(F.col("doc_id").isNull(), F.xxhash64("text")), F.xxhash64("doc_id"))
        cols = [F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.octet_length("text").cast("long").alias("size"), salt.alias("salt")]
        if copies_from:
            cols.append(F.when(F.octet_length("text") >= copies_from, F.unhex(F.sha2("text", 256))).alias("digest"))
        self.facts = materialize(docs.select(*cols))
        total = self.facts.agg(F.sum("size")).first()[0] or 0
        self.n = max(1, math.ceil(total / shard_bytes))
        self.bits = max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))
        self.texts = docs.withColumn("shard", self._shard(salt)).select("shard", "doc_id", "text")
        self.copies = None
        if copies_from:
            had = self.facts.where("digest is not null")
            first = had.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
            again = had.join(first, "digest").where("doc_id > first")
            self.copies = again.select(self._shard(F.col("salt")).alias("shard"), F.lit(0).alias("kind"),
                                       F.lit(0).alias("bucket"), F.col("doc_id").alias("num"), F.col("digest").alias("blob")).distinct()

    def _shard(self, salt):
        return F.pmod(salt, F.lit(self.n)).cast("int")

    def answers(self, *more: DataFrame) -> DataFrame:
        """What shards have been told so far."""
        rows = [x for x in (self.copies, *more) if x is not None]
        if not rows:
            return self.texts.sparkSession.createDataFrame([], ANSWERS)
        out = rows[0]
        for x in rows[1:]:
            out = out.unionByName(x)
        return out

    def each(self, told: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(Shard)`` -> Arrow table, for every shard."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return fn(Shard(left, right))
        return self.texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(run, schema)

    def ask(self, told: DataFrame, fn, merge, kind: int) -> DataFrame:
        """A round: ``fn(Shard)`` returns sorted uint64 keys, arrays of values, and how
        many leading bytes of the keys are sent; ``merge(keys, values, ...)`` gets
        lists by shard and returns an answer array for each."""
        bits = self.bits

        def send(shard: Shard) -> pa.Table:
            keys, *vals, width = fn(shard)
            cut = cuts(keys, bits)
            some = np.flatnonzero(np.diff(cut))
            raw = keys.view(np.uint8).reshape(-1, 8)[:, 8 - width:]
            return pa.table({"bucket": pa.array(some, pa.int32()), "shard": pa.array(np.full(len(some), shard.number), pa.int32()),
                             "keys": pa.array([raw[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
                             "vals": pa.array([packs(v[cut[b]:cut[b + 1]] for v in vals) for b in some], pa.binary())})

        def meet(rows: pa.Table) -> pa.Table:
            keys, vals = [], []
            for k, v in zip(rows["keys"].to_pylist(), rows["vals"].to_pylist()):
                vals.append(unpacks(v))
                raw = np.zeros((len(vals[-1][0]), 8), np.uint8)
                width = len(k) // max(1, len(raw))
                raw[:, 8 - width:] = np.frombuffer(k, np.uint8).reshape(len(raw), width)
                keys.append(raw.reshape(-1).view(U64))
            out = merge(keys, *zip(*vals))
            n = rows.num_rows
            return pa.table({"shard": rows["shard"], "kind": pa.array(np.full(n, kind), pa.int32()), "bucket": rows["bucket"],
                             "num": pa.nulls(n, pa.int64()), "blob": pa.array([pack(x) for x in out], pa.binary())})

        asked = self.each(told, send, ASKED)
        return asked.groupBy("bucket").applyInArrow(meet, ANSWERS)


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits key ranges begins in the sorted keys."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def pack(x: np.ndarray) -> bytes:
    """Bits, bytes or integers as bytes, with the kind and the count in front;
    integers take 4 bytes where they fit."""
    if x.dtype == bool:
        return b"b" + len(x).to_bytes(4, "little") + np.packbits(x).tobytes()
    if x.dtype == np.uint8:
        return b"c" + x.tobytes()
    if not len(x) or (x.min() >= -(1 << 31) and x.max() < 1 << 31):
        return b"i" + x.astype(np.int32).tobytes()
    return b"q" + x.astype(np.int64).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if b[:1] == b"b":
        return np.unpackbits(np.frombuffer(b, np.uint8, offset=5), count=int.from_bytes(b[1:5], "little")).astype(bool)
    if b[:1] == b"c":
        return np.frombuffer(b, np.uint8, offset=1)
    return np.frombuffer(b[1:], np.int32 if b[:1] == b"i" else np.int64).astype(np.int64)


def packs(arrays) -> bytes:
    out = [pack(x) for x in arrays]
    return b"".join(len(x).to_bytes(4, "little") + x for x in out)


def unpacks(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at:at + 4], "little")
        out.append(unpack(b[at + 4:at + 4 + n]))
        at += 4 + n
    return out


def first_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


class Shard:
    """Documents of one shard, by ascending id, and what the shard was told."""

    def __init__(self, docs: pa.Table, told: pa.Table):
        self.number = int((docs["shard"] if docs.num_rows else told["shard"])[0].as_py())
        ids = pc.fill_null(docs["doc_id"], NO_ID).to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.data, self.offsets = flat(docs["text"].take(pa.array(order)) if len(order) else docs["text"])
        kind = told["kind"].to_numpy()
        self._told = {}
        for i in np.flatnonzero(kind > 0):
            self._told.setdefault(int(kind[i]), []).append((told["bucket"][int(i)].as_py(), told["blob"][int(i)].as_py()))
        copies = told.filter(pa.array(kind == 0, pa.bool_()))
        copied = set(zip(copies["num"].to_pylist(), copies["blob"].to_pylist()))
        self.copy = np.zeros(len(ids), bool)
        for i in np.flatnonzero(np.isin(self.ids, copies["num"].to_numpy())) if copied else ():
            self.copy[i] = (int(self.ids[i]), self.digest(i)) in copied

    def digest(self, i: int) -> bytes:
        """SHA-256 of a document's text."""
        return hashlib.sha256(self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()).digest()

    @property
    def doc_id(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)

    def answer(self, kind: int, none=bool) -> np.ndarray:
        """The answers for this shard's sorted keys."""
        got = [unpack(b) for _, b in sorted(self._told.get(kind, []))]
        return np.concatenate(got) if got else np.zeros(0, none)


def seen_twice(keys: list[np.ndarray], several: list[np.ndarray]) -> list[np.ndarray]:
    """Whether each key is in two shards' lists, or several times in one."""
    every = np.sort(np.concatenate(keys))
    common = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate([k[s] for k, s in zip(keys, several)]))
    return [found(common, k) for k in keys]


def found(sorted_keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Binary search: whether each probe is among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(probe), bool)
    at = np.minimum(np.searchsorted(sorted_keys, probe), len(sorted_keys) - 1)
    return sorted_keys[at] == probe


def least_values(keys: list[np.ndarray], vals: list[np.ndarray]) -> list[np.ndarray]:
    """The least value of each key over all shards."""
    k, v = np.concatenate(keys), np.concatenate(vals)
    order = np.argsort(k, kind="stable")
    ks = k[order]
    at = first_of(ks)
    least = np.minimum.reduceat(v[order], at) if len(at) else v
    uniq = ks[at]
    return [least[np.searchsorted(uniq, x)] for x in keys]
