"""The corpus pipeline: quality classifier, near duplicates, decontamination,
personal data, mixing. Every stage works on what the one before it kept."""

from __future__ import annotations

import os
import sys

sys.path[:0] = [p for p in [os.path.dirname(os.path.abspath(__file__))] if p not in sys.path]

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from stationflow.llm import decontaminate, jaccard, mixing, pii, quality  # noqa: E402
from stationflow.session import work_path  # noqa: E402
from stationflow.sources.tables import read_table  # noqa: E402

ORACLE_SQL = None  # a fitted classifier and a fitted field aren't SQL; tests compare the stages with plain versions in order, and run() with them


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    net = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, net).where("quality_label = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, of rows
    with one id or none that with the smallest digest of its text; of rows alike
    in id and text, one."""
    return jaccard.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    marked = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), keep_text=True)
    hit = F.size("_hits")
    return marked.where(~((hit > 0) & (20 * hit >= F.col("_n_words")))).select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; n_chars is the new length."""
    found = pii.find_personal_data(docs, pii.fit_field(docs))
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("n_chars").isNotNull(), F.length("redacted")).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [("quality classifier", keep_quality), ("n-gram Jaccard join", one_of_each_group), ("benchmark decontamination", drop_contaminated),
          ("personal data", hide_personal_data), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the
    shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
