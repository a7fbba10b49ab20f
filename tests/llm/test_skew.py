"""A key that very many rows share is split: the plans that ran say so."""

import re
from contextlib import contextmanager

from pyspark.sql import functions as F

from gradeloom.llm import line_dedup, simhash

LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in LIMITS}
    for k, v in LIMITS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def splits(df) -> int:
    """How many joins of the plan that ran were split, after running it."""
    df.collect()
    return len(re.findall(r"skew=true", df._jdf.queryExecution().executedPlan().toString()))


def test_a_hot_window_is_split(spark):
    docs = spark.range(6000).repartition(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\nc\n"), F.md5(F.col("id").cast("string")), F.lit("\nx\n"), F.md5((F.col("id") % 3000).cast("string"))).alias("text"))
    with small_limits(spark):
        assert splits(line_dedup.dedup_lines(docs)) >= 1


def test_a_hub_is_split(spark, monkeypatch):
    """The joins that ``components`` stores, over a star of 6,000 rays: both joins of the first round are split."""
    keep, seen = simhash.stored, []

    def spy(df):
        seen.append(splits(df))
        return keep(df)

    monkeypatch.setattr(simhash, "stored", spy)
    with small_limits(spark):
        links = spark.range(1, 6000).repartition(12).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
        got = simhash.components(links)
        assert got.count() == 5999 and got.filter("root <> 0").count() == 0
    # Links, least, large, smallest, following: the hub's own rows are in the joins of the third and the fifth.
    assert seen[2] >= 1


def test_a_shard_that_many_share_is_split(spark):
    """20,000 fingerprints agree in three blocks of bits: the join that finds the sizes of shards is split."""
    nodes = spark.range(20_000).repartition(12).select(F.col("id").alias("node"), (F.col("id") * F.lit(1 << 39)).alias("fp"))
    with small_limits(spark):
        assert splits(simhash.near_links(nodes)) >= 1


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "d e f g", "z")], "doc_id long, text string, fp string").withColumn("node", F.lit("n")).withColumn("component_id", F.lit("c"))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.fp for r in kept.collect()} == {1: "x", 3: "z"}


def test_repeats_are_cut_before_the_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 50 + [(None, "e f g h")] * 50, "doc_id long, text string")
    kept = simhash.keep_representatives(docs)
    assert kept.count() == 2
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
