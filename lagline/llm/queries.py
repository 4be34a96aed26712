"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lagline.llm import angular_negatives, bpe_codec, html_crf, lexical_blocks, license_scan, lyndon_dedup, metric_tree, packing, parity_join, rp_forest, rule_cascade, sanitize, sharding
from lagline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that stay small where rows are long."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def query(oracle: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        QUERIES[function.__name__] = run
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def text_or_empty() -> Column:
    return F.coalesce("text", F.lit(""))


@query()
def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket",
    )


@query()
def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 by law `rows`; rows are numbered by id, then by text hash."""
    body = F.encode(text_or_empty(), "UTF-8")
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text_or_empty()) + 8).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), F.xxhash64("text").alias("text_hash"),
    )
    placed = sharding.assign_shards(rows, [F.col("doc_id"), F.col("text_hash"), F.col("size")], 24, seed=7)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP7_SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS row_key FROM documents
), parts AS (
  SELECT doc_id, row_key, body,
    [x FOR x IN regexp_split_to_array(body, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(body, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM tokens
), places AS (
  SELECT row_key, unnest(range(1, len(w) - 1)) AS i, w FROM parts WHERE len(w) >= 3
), windows AS (
  SELECT row_key, i, count(*) OVER (PARTITION BY row_key, w[i], w[i + 1], w[i + 2]) AS c FROM places
), covered AS (
  SELECT row_key, count(DISTINCT i + d) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS d) WHERE c > 1 GROUP BY row_key
), facts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
  FROM parts LEFT JOIN covered USING (row_key)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM facts
"""


@query(OP7_SQL)
def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = rule_cascade.apply_cascade(docs, rule_cascade.plan_cascade(docs), with_statistics=True)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept",
    )


@query()
def op9_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_codec.encode(documents(spark, sf_dir), ranks).drop("text")
    return bpe_codec.decode(coded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_rare_word_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    )


@query()
def op5_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitize.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(sanitize.KINDS[:4])],
        F.sha2(F.encode(sanitize.spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        sanitize.spans_text(F.col("spans")).alias("spans"),
    )


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), places AS (
  SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS s FROM places
), sizes AS (
  SELECT k, count(*) AS n FROM shingles GROUP BY k
), links AS (
  SELECT a, b FROM (SELECT x.k AS a, y.k AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.k <> y.k GROUP BY ALL) p
  JOIN sizes p1 ON p1.k = a JOIN sizes p2 ON p2.k = b WHERE 100 * c >= 80 * (p1.n + p2.n - c)
), reach AS (
  SELECT k AS node, doc_id AS root FROM d UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM d LEFT JOIN sizes USING (k) JOIN reach ON node = d.k GROUP BY d.k, d.doc_id
"""


@query(OP10_SQL)
def op10_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(documents(spark, sf_dir))


@query()
def op8_lyndon_group_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lyndon_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Exact by all pairs; the forest finds them all where a leaf holds every vector, as at small scale.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0 AS valid
  FROM embeddings
), links AS (
  SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
  WHERE a.valid AND b.valid AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT k AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = k)::BIGINT AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM v JOIN reach ON node = k GROUP BY k, vec_id
"""


@query(OP4_SQL)
def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def op6_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_crf.extract(pages).select("page_id", "url", "text", "n_chars")


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x) FOR x IN embedding::DOUBLE[]] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id) AS place FROM scored WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ak, place ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.ak = n.ak AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query(OP11_SQL)
def op11_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return angular_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, label)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, [floor(256 * x) FOR x IN embedding::DOUBLE[]] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT a.k, a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query(OP12_SQL)
def op12_metric_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), sums AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0
), tf AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sums GROUP BY term, n_docs
), i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark
), asked AS (
  SELECT i, item_id, term, count(*) AS c FROM (SELECT i, item_id, unnest(t) AS term FROM i) GROUP BY ALL
), scored AS (
  SELECT i, item_id, doc_id, k, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (k), sums GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@query(OP13_SQL)
def op13_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_blocks.rank(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))
