"""Cosine scores of embedding columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12

#: Labels that ``score_labels`` broadcasts at most.
MAX_LABELS = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """dot / ((|a| + e) (|b| + e)); 0 for zero vectors, null if either is null."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + EPSILON) * (F.sqrt(dot(b, b)) + EPSILON))


def best_label(scores: Column) -> Column:
    """From array<struct<score, ord, label>>: the entry of the largest score, the first in order of equal ones."""
    return F.element_at(F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("k"), s["ord"].alias("ord"), s["label"].alias("label"), s["score"].alias("score")))), 1)


def score_labels(vectors: DataFrame, texts: DataFrame, id_col: str, vec_col: str, label_col: str, text_vec: str) -> DataFrame:
    """Each vector against all label texts: ``scores`` (label -> cosine), the best label ``pred``, and the margin to the second.

    The label texts (one per label, ``MAX_LABELS`` at most, else the job fails) are broadcast as one row; ties go to the
    first label in order.  Where each item has texts of its own, use ``score_pairs``.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(label_col).alias("label"), F.col(text_vec).alias("v"))))
    # One row more than allowed is enough to tell.
    few = texts.limit(MAX_LABELS + 1).agg(listed.alias("_labels"))
    labels = F.broadcast(few.select(F.when(F.size("_labels") <= MAX_LABELS, F.col("_labels")).otherwise(F.raise_error(F.lit(f"more than {MAX_LABELS} labels"))).alias("_labels")))
    return _ranked(vectors.crossJoin(labels), id_col, vec_col)


def _ranked(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Scores of ``_labels`` (array of label and vector) against the row's vector."""
    scored = rows.withColumn("_s", F.transform("_labels", lambda x, i: F.struct(cosine(F.col(vec_col), x["v"]).alias("score"), i.alias("ord"), x["label"].alias("label"))))
    ranked = F.array_sort(F.transform("_s", lambda s: F.struct((-s["score"]).alias("k"), s["ord"].alias("ord"), s["label"].alias("label"), s["score"].alias("score"))))
    return scored.withColumn("_r", ranked).select(
        id_col,
        F.map_from_entries(F.transform("_s", lambda s: F.struct(s["label"], s["score"]))).alias("scores"),
        F.col("_r")[0]["label"].alias("pred"),
        F.col("_r")[0]["score"].alias("top1"),
        (F.col("_r")[0]["score"] - F.try_element_at(F.col("_r"), F.lit(2))["score"]).alias("margin"),
    )


def score_pairs(vectors: DataFrame, texts: DataFrame, item: str, vec_col: str, label_col: str, text_vec: str) -> DataFrame:
    """Each item's vector against the label texts of its own: ``scores``, ``pred``, ``top1`` and ``margin`` as in ``score_labels``.

    Both sides meet in a join on the item, so neither has to be small; an item's label texts are few.
    """
    lists = texts.groupBy(F.col(item).alias("_item")).agg(F.sort_array(F.collect_list(F.struct(F.col(label_col).alias("label"), F.col(text_vec).alias("v")))).alias("_labels"))
    return _ranked(vectors.join(lists, F.col(item) == F.col("_item")), item, vec_col)
