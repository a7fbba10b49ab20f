"""Nested hypothesis records to flat (clip, hypothesis, gold) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .partitions import prefix_by_partition

# The keys of each task's hypothesis map, in reading order, with their gold labels.
TASK_KEYS = {
    "nli": [("entailment", "ENTAILMENT"), ("neutral", "NEUTRAL"), ("contradiction", "CONTRADICTION")],
    "consistency": [("consistent", "CONSISTENT"), ("inconsistent", "INCONSISTENT")],
    "plausibility": [("plausible", "PLAUSIBLE"), ("implausible", "IMPLAUSIBLE")],
    "restraint": [("supported", "SUPPORTED"), ("unsupported", "UNSUPPORTED")],
    "accent_drift": [("accent_invariant", "TRUE"), ("accent_sensitive_lures", "FALSE")],
    "intent": [("intent", "INTENT")],
    "commonsense": [("commonsense_inference", "COMMONSENSE")],
}


def as_list(v: Column) -> Column:
    """VARIANT to array of VARIANT: null gives none, a list its elements, anything else itself alone."""
    return F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<variant>")).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))


def hypothesis_list(output: Column, task: str, order: list[str] | None = None) -> Column:
    """array<struct<hypothesis, gold, difficulty>> over the task's keys, in ``order`` if given; blank ones left out."""
    keys = dict(TASK_KEYS[L.task_family(task)])

    def entry(gold: str):
        def fields(v: Column) -> Column:
            text = F.coalesce(F.try_variant_get(v, "$.hypothesis", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
            return F.struct(L.strip(text).alias("hypothesis"), F.coalesce(F.upper(F.try_variant_get(v, "$.label", "string")), F.lit(gold)).alias("gold"), F.try_variant_get(v, "$.difficulty", "string").alias("difficulty"))

        return fields

    lists = [F.transform(as_list(F.try_variant_get(output, f"$.{k}", "variant")), entry(keys[k])) for k in order or list(keys)]
    return F.filter(F.concat(*lists), lambda s: s["hypothesis"] != "")


def explode_hypotheses(df: DataFrame, task: str, output: str = "output", file_name: str = "file_name", order: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """One row per hypothesis with ``item_id`` ({stem}__hyp_{position over all keys}); ``row_id`` names clips without a
    file; without it such a clip is an error.

    The outer explode keeps Spark from testing the list's size before it, which would parse and build every list twice.
    """
    listed = df.withColumn("_h", hypothesis_list(F.col(output), task, order))
    name = F.coalesce(F.nullif(L.stem(L.strip(F.col(file_name))), F.lit("")), F.concat(F.lit("row"), F.col(row_id).cast("string")) if row_id else F.raise_error(F.lit("a clip has no file name: pass row_id, or item ids would clash")))
    rows = listed.select(*[c for c in df.columns if c != output], name.alias("_stem"), F.posexplode_outer("_h").alias("pos", "_x"))
    return rows.filter("pos is not null").select(*[c for c in df.columns if c != output], F.concat("_stem", F.lit("__hyp_"), "pos").alias("item_id"), "pos", "_x.hypothesis", "_x.gold", "_x.difficulty")


def explode_interview(df: DataFrame, hypotheses: str = "hypotheses", audio_id: str = "audio_id") -> DataFrame:
    """Records with a list of (label, difficulty, text)."""
    rows = df.select(F.concat(F.col(audio_id), F.lit(".wav")).alias("file_name"), F.posexplode(hypotheses).alias("pos", "h"))
    return rows.select("file_name", F.concat(L.stem(F.col("file_name")), F.lit("__hyp_"), "pos").alias("item_id"), F.upper("h.label").alias("gold"), F.lower("h.difficulty").alias("difficulty"), L.strip(F.col("h.text")).alias("hypothesis"))


def flat_or_nested(nested: Column, hypothesis: Column, gold: Column, label: Column) -> Column:
    """The nested list, or a list of the record's own flat hypothesis."""
    own = F.array(F.struct(hypothesis.alias("hypothesis"), F.upper(F.coalesce(gold, label)).alias("gold"), F.lit(None).cast("string").alias("difficulty")))
    return F.when(F.size(nested) > 0, nested).when(hypothesis.isNotNull(), own).otherwise(nested)


def option_list(hypotheses: Column) -> Column:
    return F.array_join(F.transform(hypotheses, lambda h: F.concat(F.lit("- "), h["hypothesis"])), "\n")


def question_prefix(question: Column, hypothesis: Column) -> Column:
    return F.concat_ws(" ", question, hypothesis)


def named_clips(df: DataFrame, order: str, transcript: str = "transcript", file_name: str = "file_name") -> DataFrame:
    """Clips with a transcript; those without a name are called by their place in the table's order, skipped ones counted.

    ``order`` is a column of distinct numbers.  Rows are counted range by range, so no task orders the whole table.
    """
    placed = prefix_by_partition(df.withColumn("_one", F.lit(1)), order, ["_one"])
    name = F.coalesce(F.nullif(L.strip(F.col(file_name)), F.lit("")), F.concat(F.lit("row_"), F.col("_one_before") + 1, F.lit(".wav")))
    return placed.withColumn(file_name, name).filter(L.strip(F.col(transcript)) != "").drop("_one", "_one_before")


def composition(df: DataFrame) -> DataFrame:
    """Clips and hypotheses of a subset, by difficulty and by label."""
    return df.sparkSession.sql("SELECT difficulty, gold, count(*) AS n, count(DISTINCT file_name) AS clips FROM {df} GROUP BY GROUPING SETS ((), (difficulty), (gold))", df=df)
