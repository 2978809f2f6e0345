"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, language, mixing, neighbours, ngram_join, pii, secrets, sharding, suffix_dedup, toxicity
from sparkloom.llm.spans import joined
from sparkloom.storage import stage

SHARDS = 8
TOXIC_AT = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = stage(mixing.slim_rows(table(spark, sf_dir, "documents")), "mix-rows")
    mixed = mixing.apply_mix(slim, mixing.plan_mix(slim))
    return mixed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken", "copies")


def op6_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_documents(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return linked.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _digest(found: DataFrame, kinds: tuple[str, ...], counted: int) -> DataFrame:
    """Counts and digests of spans that an operator found."""
    count = lambda i: F.size(F.filter("base", lambda t: t["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kinds[i]}") for i in range(counted)],
        F.sha2(joined(F.col("base"), kinds), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), kinds).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS, 3)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_personal(table(spark, sf_dir, "documents")), pii.KINDS, 4)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language.fit_languages(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model).select("doc_id", F.col("toxicity.score").alias("score"), F.size("toxicity.segments").alias("n_segments"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "n_segments")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix": op1_mix, "op2_language": op2_language, "op3_secrets": op3_secrets, "op4_decontaminate": op4_decontaminate, "op5_neighbours": op5_neighbours, "op6_join": op6_join, "op7_shard": op7_shard, "op8_pii": op8_pii, "op9_toxicity": op9_toxicity, "op10_suffixes": op10_suffixes}


#: Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more.
JOIN_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM worded
), shingled AS MATERIALIZED (SELECT doc_id, unnest(s) AS shingle, len(s) AS size FROM listed),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN links ON b = u)
SELECT l.doc_id, CAST(len(l.s) AS BIGINT) AS n_shingles, c.component_id
FROM listed l JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON l.doc_id = c.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_join": JOIN_SQL}
