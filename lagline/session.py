"""Session settings the operators rely on, and the folder for intermediates."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings: safe to set on a session somebody else has built.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Splits that do not grow with the input; a small file counts as 4 MB, so one takes four at most.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Exact percentiles are object aggregates; keep them hash based for more groups
    # per task before they fall back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes (UTC instants, adaptive plans)."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def build_session(app_name: str = "lagline", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates, as `spark.checkpoint.dir` names it.

    Only a local session (tests) may go without: it gets a temporary folder of its own. On a
    cluster a folder of one machine would be lost to the others, so it is an error there.
    """
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()
