"""Clean a corpus: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage reads what its predecessor kept and is written as Parquet before the next one.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline import staging
from lagline.llm import lyndon_dedup, packing, parity_join, rule_cascade, sanitize
from lagline.llm.queries import prepare
from lagline.session import ensure_checkpoint_dir


_LEFT: dict[str, list[str]] = {}  # by input folder: what the last stage staged


def stage_of(function):
    """A stage that first removes what the stages before it staged.

    Each stage is written before the next one starts, so those intermediates are not read again.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        staging.release(spark, _LEFT.pop(sf_dir, []))
        staging.tidy(spark)
        mark = len(staging.written())
        frame = function(spark, docs, sf_dir)
        _LEFT[sf_dir] = staging.written(mark)
        return frame

    return run_stage


def with_text(frame: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of `docs`, with another text and its number of characters."""
    made = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return frame.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


@stage_of
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule, unchanged. A null or empty text fails."""
    judged = rule_cascade.apply_cascade(docs, rule_cascade.plan_cascade(docs))
    return judged.where("kept").select(*docs.columns)


@stage_of
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id."""
    return parity_join.keep_one(docs).select(*docs.columns)


@stage_of
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 400 bytes or more that stand elsewhere too."""
    return with_text(lyndon_dedup.remove_repeats(docs), docs, "kept_text")


@stage_of
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it masked."""
    return with_text(sanitize.mask(sanitize.find(docs)), docs, "text")


@stage_of
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, one sequence each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("personal_data", personal_data), ("packing", pack),
]
ORACLE_SQL = None  # tokens and sketches have no SQL form; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored in the shared folder until the next one is written."""
    prepare(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            staging.release(spark, [last])
        last = path
    staging.release(spark, _LEFT.pop(sf_dir, []))
    return docs
