"""Replaying recorded rows through a streaming job, with restarts, into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline.session import ensure_checkpoint_dir
from lagline.staging import staged
from lagline.streaming.forecasts import ROCKSDB


def replayed(
    spark: SparkSession,
    inputs: dict[str, tuple[DataFrame, str]],
    job: Callable[[dict[str, DataFrame]], DataFrame],
    steps: int = 3,
    closing: list[dict[str, DataFrame]] = (),
) -> DataFrame:
    """The table that `job` appends to while the inputs land in time order.

    Each input is (rows, landing time column); its rows land in `steps` slices of time, then
    those of `closing`, one after another, which serve to move watermarks on. After every
    landing a query starts from the stored checkpoint, works off what has landed and ends, so
    each slice but the first is met by a restarted query and the state of the one before it.
    Landings, checkpoint and table lie in the shared folder.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    held = {name: (staged(rows, "recorded"), at) for name, (rows, at) in inputs.items()}
    for name, (rows, _) in held.items():
        rows.where("false").write.parquet(f"{folder}/{name}")  # the streams need a folder to watch
    ends = [rows.agg(F.min(at), F.max(at)).first() for rows, at in held.values()]
    known = [e for e in ends if e[0] is not None]
    first, last = (pick(e[i] for e in known) if known else None for i, pick in ((0, min), (1, max)))
    bounds = [first + (last - first) * k / steps for k in range(1, steps)] if known else []
    streams = {n: spark.readStream.schema(rows.schema).parquet(f"{folder}/{n}") for n, (rows, _) in held.items()}
    result = job(streams)
    landings = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        landings.append({n: reduce(
            lambda f, c: f.where(c), [c for c in (None if low is None else F.col(at) >= low, None if high is None else F.col(at) < high) if c is not None], rows,
        ) for n, (rows, at) in held.items()})
    for landing in [*landings, *closing]:
        for name, rows in landing.items():
            rows.write.mode("append").parquet(f"{folder}/{name}")
        query = (
            result.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/table")


def row_of(frame: DataFrame, **values) -> DataFrame:
    """One row of the columns of `frame`, null but for the given values."""
    row = tuple(values.get(f.name) for f in frame.schema.fields)
    return frame.sparkSession.createDataFrame([row], frame.schema)
