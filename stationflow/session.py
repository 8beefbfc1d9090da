"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "stationflow") -> SparkSession:
    """Local/test session with AQE on. On a cluster the submitter's config wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small local inputs: keep one task per core in CPU-heavy stages (windows)
        # instead of coalescing a few MB of shuffle data into one or two tasks
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Settings for a large cluster (100 TB inputs). Shuffles start with many
# partitions and AQE coalesces them to the advisory size at run time, splits
# skewed join partitions, and turns shuffle joins into broadcasts only when a
# side is measured under the threshold.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.windowExec.buffer.spill.threshold": str(1 << 20),
}


def apply_scale_conf(spark: SparkSession, overrides: dict | None = None) -> None:
    """Sets every SCALE_CONF key the submitter has not set explicitly."""
    conf = dict(SCALE_CONF, **(overrides or {}))
    set_keys = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for k, v in conf.items():
        if k not in set_keys:
            spark.conf.set(k, v)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be configured (a shared file system).
    Only a local session without the setting gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="stationflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df):
    """Computes ``df`` once into the shared checkpoint folder and cuts its
    lineage (``checkpoint``, never ``localCheckpoint``): later fits and
    transforms read the stored rows instead of recomputing the plan, and a
    lost executor does not force a recomputation from the sources."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    root = checkpoint_root(spark)
    return os.path.join(root.rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")
