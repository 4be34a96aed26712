"""Columnar intermediates in the folder all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from lagline.session import ensure_checkpoint_dir

_WRITTEN: list[str] = []


def staged(frame: DataFrame, name: str = "stage", own: list[str] | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write `frame` once as compressed Parquet and return a frame that reads it.

    Later passes then scan only the columns they use, and a lost executor costs a read
    of the file, not a recomputation. Column order and row counts per file are those of
    the writing tasks; `release` removes the files when the results have been written. The
    folder's name is added to `own`, for callers that remove theirs while others still work.
    With `rows_per_file`, files are cut at so many rows, for readers whose tasks hold much more
    per row than the file does; a split takes at most a few files.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    _WRITTEN.append(path)
    if own is not None:
        own.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def written(since: int = 0) -> list[str]:
    """Folders that this driver has staged, from the given one on."""
    return _WRITTEN[since:]


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Remove the given staged folders, or all; frames that still read one become unusable."""
    removed = 0
    for name in list(_WRITTEN if paths is None else paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
        if name in _WRITTEN:
            _WRITTEN.remove(name)
    return removed


def tidy(spark: SparkSession) -> None:
    """Let go of frames that nobody holds any more, so that Spark removes their shuffle files."""
    gc.collect()
    spark._jvm.java.lang.System.gc()
