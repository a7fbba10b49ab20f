"""A corpus pipeline of five operators: each stage takes documents and returns documents; the last adds their shards."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, language_id, mixing, sharding, simhash
from gradeloom.llm.common import discard, stored, table

SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and long ones far from every language's profile; a short text's distance says nothing."""
    profiles = language_id.learn_profiles(docs)
    judged = language_id.predict_language(docs, profiles, grams_col="_n_grams")
    near = (F.col("score") >= language_id.MIN_SCORE) | (F.col("_n_grams") < language_id.MIN_GRAMS)
    kept = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & near)
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    return simhash.keep_representatives(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover 5 % or more.

    The texts are kept, so each shard of the index is searched when it is made and isn't stored; with a benchmark of
    several blocks it is.
    """
    judged = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source up to its target, range-sorted by training position; a document taken twice stands there twice.

    The document at which a source's target ends is given up to the last word taken.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot``.  Slots follow the order in which the rows are stored, which is that of training."""
    sharded = sharding.assign_shards(docs.withColumns(stored_order(docs)), leaves=SHARDS, categories=["source", "lang"])
    order = [F.col(c) for c in sharded.columns if c in ("_file", "_at")]
    placed = sharding.with_slots(sharded, tie=F.col("text"), order=order or None)
    return placed.select(*docs.columns, "shard", "slot")


def stored_order(docs: DataFrame) -> dict[str, Column]:
    """File and place in it of each row of a table read from files; nothing for other tables."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return {}
    return {"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")}


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's table is deleted once the next one is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
