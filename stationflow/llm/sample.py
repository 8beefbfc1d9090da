"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_ids(docs: DataFrame, rows: int, salt: str, where: Column | None = None, among: DataFrame | None = None) -> list[int]:
    """At most ``rows`` ids, those with the smallest hashes of id and ``salt``, in
    that order. ``among`` limits the ids to those of a table. Rows with null ids or
    texts are left out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.where("doc_id is not null and text is not null")
    d = (d if where is None else d.where(where)).select("doc_id")
    if among is not None:
        d = d.join(among.select("doc_id"), "doc_id", "left_semi")
    hashed = d.distinct().withColumn("h", F.xxhash64("doc_id", F.lit(salt)))
    return [r["doc_id"] for r in hashed.orderBy("h", "doc_id").limit(rows).collect()]


def texts_of(docs: DataFrame, ids: list[int]) -> DataFrame:
    """doc_id and text of the rows with these ids."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.where(F.col("doc_id").isin(ids) if ids else F.lit(False)).where("text is not null")


def hashed_sample(docs: DataFrame, rows: int, salt: str, where: Column | None = None,
                  among: DataFrame | None = None) -> list[tuple[int, str]]:
    """(doc_id, text) of :func:`sample_ids`, in that order. The ids are chosen
    first, so only their texts move. Of repeated ids the least text is taken."""
    ids = sample_ids(docs, rows, salt, where, among)
    text = {}
    rows_ = texts_of(docs, ids)
    for r in (rows_ if where is None else rows_.where(where)).collect():
        text[r["doc_id"]] = min(r["text"], text.get(r["doc_id"], r["text"]))
    return [(i, text[i]) for i in ids]
