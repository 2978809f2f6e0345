"""From raw documents to shards: toxicity, near duplicates, benchmark leaks, mix, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again before the next.  All but the last return the columns of
``docs``, whatever they are.  Rows with null texts or ids are judged as the
operators say: an empty or null text is not toxic, has no near duplicate and no
leak, weighs nothing in the mix and takes a place in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, mixing, ngram_join, sharding, toxicity
from sparkloom.storage import stage

TOXIC_AT = 0.7
SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(docs: DataFrame) -> DataFrame:
    """The whole row beside id and text, so that added columns clash with none of ``docs``."""
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC_AT``."""
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(_judged(docs), model, text_col="_text", out="_toxicity")
    return scored.where(F.col("_toxicity.score") < TOXIC_AT).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_join.keep_one(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.find_leaks(_judged(docs), _table(spark, sf_dir, "benchmark"), text_col="_text", out="_leaks")
    return found.where(F.size("_leaks") == 0).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.expand(docs, mixing.plan_mix(stage(mixing.slim_rows(docs), "mix-rows")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: No SQL: the model of the first stage and the components of the second are iterative.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
