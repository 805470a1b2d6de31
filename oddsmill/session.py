"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only; resources stay the cluster's business.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on asset_id is often followed by a grouping on asset_id. Without this flag AQE keeps the
    # co-partitioning and leaves a hot asset in one task; with it the hot side is split and re-shuffled.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A table may have tens of thousands of day folders; by default each is listed by a task of its own.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one the cluster names in spark.checkpoint.dir; a temporary one only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stored(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder, for results that several steps read; its plan starts anew from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
