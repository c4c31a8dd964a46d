"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (zone) or plans (adaptive execution, skew joins).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffles start in many small pieces that are joined up to a size, so that the memory
    # Scans and shuffles are cut into pieces of a size, so that a task holds a piece however
    # large the input is: many small parts of a shuffle are joined up to that size.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def build(master: str | None = None, app: str = "closeline", **extra: str) -> SparkSession:
    """A session with the settings above; the cluster's own values win for the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the one set on the context.

    Only where neither exists, on one machine, is one made here.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder the cluster names."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: columns that repeat take less room than in a checkpoint."""
    spark = frame.sparkSession
    path = posixpath.join(shared_folder(spark), f"stored-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
