"""Committed builds: tables written aside and made valid together by one small file.

A build is a folder of tables and, once all of them are written, `build.json`. Readers go
through that file, so a build that stopped halfway is not there for them. It states for
every table its folder, format, schema, row count and digest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

COMMIT = "build.json"


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def digest(frame: DataFrame) -> dict[str, Column]:
    """Aggregates that state a table whatever the order of its rows: row count and sum of row hashes.

    A hash runs over the columns by name, each with whether it is null, so a value that moves
    to another column shows; repeated rows count as often as they stand. Maps, which have no
    hash, go by their JSON text. The sum is a decimal of 38 digits: 10^18 rows cannot overflow it.
    """
    parts = []
    for f in sorted(frame.schema.fields, key=lambda f: f.name):
        value = F.col(f"`{f.name}`")
        parts += [F.to_json(F.struct(value)) if _has_map(f.dataType) else value, value.isNull()]
    row = F.xxhash64(*parts).cast("decimal(28,0)")
    return {"rows": F.count(F.lit(1)), "digest": F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)"))}


@dataclass
class Build:
    """One attempt at a build. `write` as many tables as wanted, then `commit` once."""

    spark: SparkSession
    folder: str
    tables: dict[str, dict] = field(default_factory=dict)

    def write(
        self, name: str, frame: DataFrame, format: str = "parquet", partition_by: list[str] = (), facts: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Write a table, take its digest and any `facts` (aggregates) on the way, and return it as stored.

        Both are observed after the last exchange, in the tasks that write: a task that is
        repeated counts once, and nothing is read again. Partitioned tables are rebalanced, so
        a large partition has several writers.
        """
        if name in self.tables:
            raise ValueError(f"table {name} is already part of the build")
        if partition_by:
            frame = frame.hint("rebalance", *[F.col(c) for c in partition_by])
        seen = Observation(f"build-{name}-{uuid.uuid4().hex}")
        asked = digest(frame) | {f"fact_{k}": v for k, v in (facts or {}).items()}
        writer = frame.observe(seen, *[v.alias(k) for k, v in asked.items()]).write.mode("errorifexists").format(format)
        if format == "parquet":
            writer = writer.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(f"{self.folder}/{name}")
        found = seen.get
        self.tables[name] = {
            "format": format, "schema": json.loads(frame.schema.json()), "rows": found["rows"], "digest": str(found["digest"]),
            "facts": {k: _plain(found[f"fact_{k}"]) for k in facts or {}},
        }
        return _stored(self.spark, self.folder, name, self.tables[name])

    def commit(self, **facts) -> dict:
        """Make the build valid: state its tables and `facts` in one file, written aside and renamed."""
        if committed(self.spark, self.folder) is not None:
            raise ValueError(f"{self.folder} holds a committed build")
        stated = {"tables": self.tables, **facts}
        at = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = at(COMMIT).getFileSystem(self.spark._jsc.hadoopConfiguration())
        aside = at(f"_{uuid.uuid4().hex}")
        out = system.create(aside, False)
        out.write(bytearray(json.dumps(stated, indent=1, sort_keys=True).encode()))
        out.close()
        if not system.rename(aside, at(COMMIT)):
            raise ValueError(f"the build in {self.folder} could not be committed")
        return stated


def _plain(value):
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _stored(spark: SparkSession, folder: str, name: str, table: dict) -> DataFrame:
    schema = T.StructType.fromJson(table["schema"])
    return spark.read.schema(schema).format(table["format"]).load(f"{folder}/{name}").select(*[f"`{c}`" for c in schema.names])


def committed(spark: SparkSession, folder: str) -> dict | None:
    """What the build states of itself; None if it was never committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{COMMIT}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(spark.read.text(f"{folder}/{COMMIT}", wholetext=True).first()[0])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a committed build."""
    return _stored(spark, folder, name, _committed_tables(spark, folder)[name])


def verify_build(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, rows_found, as_written) of every table, read again from what is stored.

    Raises if the folder holds no committed build. Each table costs one scan and one aggregate.
    """
    checks = []
    for name, table in _committed_tables(spark, folder).items():
        stored = _stored(spark, folder, name, table)
        taken = digest(stored)
        same = (F.col("rows_found") == table["rows"]) & (F.col("_digest").cast("string") == table["digest"])
        checks.append(
            stored.agg(taken["rows"].alias("rows_found"), taken["digest"].alias("_digest"))
            .select(F.lit(name).alias("name"), F.lit(table["rows"]).cast("bigint").alias("rows"), "rows_found", same.alias("as_written"))
        )
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


def require_as_written(spark: SparkSession, folder: str) -> None:
    """Raise unless every table of the build holds the rows that were written."""
    bad = [r["name"] for r in verify_build(spark, folder).where("not as_written").collect()]  # one row a table
    if bad:
        raise ValueError(f"Stored rows differ from the written ones in {', '.join(sorted(bad))} of {folder}.")


def _committed_tables(spark: SparkSession, folder: str) -> dict[str, dict]:
    stated = committed(spark, folder)
    if stated is None:
        raise ValueError(f"{folder} holds no committed build")
    if not stated["tables"]:
        raise ValueError(f"the build in {folder} has no tables")
    return stated["tables"]
