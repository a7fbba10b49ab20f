"""Threshold sweeps, selective prediction, AUROC and separability of scored predictions.

Every sweep first counts rows per (run, score), then takes running sums over the distinct scores: n log n, where checking
each threshold against each row would be quadratic.  A run is ordered by one task, or with ``buckets`` part by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.scratch import stored
from .keys import join_on
from .metrics import from_confusion
from .partitions import in_order

EDGE = 1e-6


def positive_label(labels: Column) -> Column:
    """The first of the usual positive labels that the run has, else its first label."""
    out = F.element_at(F.array_sort(labels), 1)
    for x in reversed(L.POSITIVE_LABELS):
        out = F.when(F.array_contains(labels, x), F.lit(x)).otherwise(out)
    return out


def ranked_scores(scores: Column) -> Column:
    """map label -> score to array<struct<k, label, score>>, best first; ties by label."""
    return F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("label"), e["value"].alias("score"))))


def scored_rows(df: DataFrame, keys: list[str], scores: str = "scores", order: str | None = None) -> DataFrame:
    """Argmax prediction, margin to the second, and the run's positive label and its score.

    A run's labels are those of its first non-empty map in ``order``, or without one the most that any map has; a row
    that lacks one of them, or a score, is left out.
    """
    full = df.filter(F.size(scores) > 0)
    named = full.select(*keys, F.sort_array(F.map_keys(scores)).alias("_set"), *([F.col(order).alias("_order")] if order else []))
    named = named if order else named.withColumn("_order", -F.size("_set"))
    runs = named.groupBy(*keys).agg(F.min(F.struct("_order", "_set")).alias("_first")).select(*keys, F.col("_first._set").alias("_labels"))
    scored = F.map_keys(F.map_filter(scores, lambda k, v: v.isNotNull()))
    rows = join_on(full.withColumn("_scored", scored), runs, keys, "inner").filter(F.size(F.array_except("_labels", "_scored")) == 0).drop("_scored")
    best = ranked_scores(F.map_filter(F.col(scores), lambda k, v: F.array_contains("_labels", k)))
    rows = rows.withColumn("_r", best).withColumn("positive", positive_label(F.col("_labels")))
    return rows.withColumns({"pred": F.col("_r")[0]["label"], "margin": F.col("_r")[0]["score"] - F.try_element_at("_r", F.lit(2))["score"], "score": F.try_element_at(F.col(scores), F.col("positive"))}).drop("_r")


def score_counts(df: DataFrame, keys: list[str], score: str = "score", is_pos: str = "is_pos") -> DataFrame:
    """Positives and negatives per distinct score: all that the sweeps need, combined before the shuffle."""
    return df.groupBy(*keys, score).agg(F.count_if(is_pos).alias("n_pos"), F.count_if(~F.col(is_pos)).alias("n_neg"))


def auroc(counts: DataFrame, keys: list[str], score: str = "score", buckets: int | None = None) -> DataFrame:
    """(pairs won + half the ties) / pairs; null if a class is empty.  ``buckets``: see ``in_order``, for runs of very many scores."""
    ranked = in_order(counts, keys, score, ["n_pos", "n_neg"], buckets)
    # As doubles: the products of two counts pass the range of whole numbers.
    won = F.sum(F.col("n_pos").cast("double") * (2.0 * F.col("n_neg_before") + F.col("n_neg")))
    pairs = F.sum("n_pos").cast("double") * F.sum("n_neg").cast("double")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, won / (2 * pairs)).alias("auroc"))


def _candidates(counts: DataFrame, keys: list[str], score: str, buckets: int | None) -> DataFrame:
    """``thresholds`` with ``won``: twice the pairs that the positives of a score win, so AUROC comes from the same rows."""
    rows = in_order(counts, keys, score, ["n_pos", "n_neg"], buckets).withColumnsRenamed({"n_pos_all": "P", "n_neg_all": "N"})
    won = F.col("n_pos").cast("double") * (2.0 * F.col("n_neg_before") + F.col("n_neg"))
    at = F.when(F.col("_prev").isNull(), F.col(score) - EDGE).otherwise((F.col("_prev") + F.col(score)) / 2)
    here = F.struct(at.alias("t"), (F.col("P") - F.col("n_pos_before")).alias("tp"), (F.col("N") - F.col("n_neg_before")).alias("fp"), won.alias("won"))
    above = F.struct((F.col(score) + EDGE).alias("t"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("won"))
    return rows.select(*keys, "P", "N", F.explode(F.when(F.col("_next").isNull(), F.array(here, above)).otherwise(F.array(here))).alias("c")).select(*keys, "P", "N", "c.*")


def thresholds(counts: DataFrame, keys: list[str], score: str = "score", buckets: int | None = None) -> DataFrame:
    """Candidates: just below the least score, halfway between neighbours, just above the largest; with the counts at or above."""
    return _candidates(counts, keys, score, buckets).drop("won")


def threshold_figures(counts: DataFrame, keys: list[str], score: str = "score", buckets: int | None = None) -> DataFrame:
    """AUROC and the best threshold's figures of each run, ``auroc`` and ``best``, from one ordering of its scores."""
    c = _candidates(counts, keys, score, buckets).withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = (ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")) + ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn"))) / 2
    c = c.withColumns({"macro_f1": f1, "accuracy": (F.col("tp") + F.col("tn")) / (F.col("P") + F.col("N")), "balanced_accuracy": (ratio(F.col("tp"), F.col("P")) + ratio(F.col("tn"), F.col("N"))) / 2})
    pairs = F.max("P").cast("double") * F.max("N").cast("double")
    best = F.max_by(F.struct("macro_f1", "accuracy", "balanced_accuracy", F.col("t").alias("threshold")), F.struct("macro_f1", -F.col("t")))
    return c.groupBy(*keys).agg(F.when(pairs > 0, F.sum("won") / (2 * pairs)).alias("auroc"), best.alias("best"))


def best_threshold(counts: DataFrame, keys: list[str], score: str = "score", buckets: int | None = None) -> DataFrame:
    """The threshold (positive at or above) of the best macro-F1; the smallest of equal ones.  With its accuracies.

    The best of each part of a run is found by itself, then the best of those.  ``buckets``: see ``in_order``.
    """
    return threshold_figures(counts, keys, score, buckets).select(*keys, "best.*")


def selective(df: DataFrame, keys: list[str], margin: str = "margin", correct: str = "correct", coverage: float = 0.8, buckets: int | None = None) -> DataFrame:
    """The margin threshold with the best accuracy of the rows kept, among those that keep ``coverage`` of all; smallest of equal ones."""
    return selective_figures(score_counts(df, keys, margin, correct), keys, margin, coverage, buckets)


def selective_figures(counts: DataFrame, keys: list[str], margin: str = "margin", coverage: float = 0.8, buckets: int | None = None) -> DataFrame:
    """``selective`` from the right (``n_pos``) and wrong (``n_neg``) rows of each margin."""
    c = thresholds(counts, keys, margin, buckets).withColumns({"kept": F.col("tp") + F.col("fp"), "all": F.col("P") + F.col("N")})
    c = c.filter((F.col("kept") > 0) & (F.col("kept") / F.col("all") >= coverage)).withColumns({"coverage": F.col("kept") / F.col("all"), "kept_accuracy": F.col("tp") / F.col("kept")})
    best = c.groupBy(*keys).agg(F.max_by(F.struct("coverage", "kept_accuracy", F.col("t").alias("threshold")), F.struct("kept_accuracy", -F.col("t"))).alias("b"))
    return best.select(*keys, "b.*")


def d_prime(df: DataFrame, keys: list[str], score: str = "score", is_pos: str = "is_pos") -> DataFrame:
    """(mean of positives - mean of negatives) / root of the mean population variance; null if a class or that is empty."""
    s1, s0 = F.when(F.col(is_pos), F.col(score)), F.when(~F.col(is_pos), F.col(score))
    pooled = F.sqrt((F.var_pop(s1) + F.var_pop(s0)) / 2)
    return df.groupBy(*keys).agg(F.when(pooled > 0, (F.avg(s1) - F.avg(s0)) / pooled).alias("d_prime"), F.avg(s1).alias("mean_pos"), F.avg(s0).alias("mean_neg"))


def mean_margins(df: DataFrame, keys: list[str], margin: str = "margin", correct: str = "correct") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(margin).alias("mean_margin"), F.avg(F.when(F.col(correct), F.col(margin))).alias("mean_margin_correct"), F.avg(F.when(~F.col(correct), F.col(margin))).alias("mean_margin_wrong"))


def histogram(df: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    """Rows per (keys, gold, pred, is_pos, score, margin, ``_k``: the run's number of labels), stored; all that an audit needs.

    Rows that the audit leaves out are there with a null gold.  The input is read once: its maps are stored first, since a
    run's labels come from all of them.
    """
    taken = [*keys, "gold", scores]
    maps = stored(df.select(*taken))
    judged = scored_rows(maps, keys, scores).withColumn("gold", F.upper("gold")).filter(F.array_contains("_labels", F.col("gold")))
    figures = ["gold", "pred", "is_pos", "score", "margin", "_k"]
    judged = judged.withColumns({"is_pos": F.col("gold") == F.col("positive"), "_k": F.size("_labels")})
    counted = judged.groupBy(*keys, *figures).agg(F.count(F.lit(1)).alias("n"))
    everything = maps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    left_out = everything.select(*keys, *[F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in figures], "n")
    return stored(counted.union(left_out))


def audit(df: DataFrame, keys: list[str], scores: str = "scores", buckets: int | None = None) -> DataFrame:
    """One row per run with all of the above; threshold figures for runs of two labels only.

    Rows without a score for each of the run's labels, or with a gold label that isn't one of them, are left out and
    counted in ``n_skipped``; a run without any row left has no row.  The baseline is the label of the best score.  All
    figures come from one stored histogram.  ``buckets``: see ``in_order``, for runs of very many scores.
    """
    rows = histogram(df, keys, scores).withColumn("correct", F.col("gold") == F.col("pred"))
    n, right, pos = F.col("n"), F.col("correct"), F.col("is_pos")
    some = lambda cond, x=n: F.sum(F.when(cond, x))
    mean = lambda cond, x: some(cond, n * F.col(x)) / some(cond)
    kept, two = F.col("gold").isNotNull(), F.col("_k") == 2
    ratio = lambda a, b: F.coalesce(F.coalesce(a, F.lit(0)) / b, F.lit(0.0))
    base = rows.groupBy(*keys).agg(
        F.coalesce(some(kept), F.lit(0)).alias("n"),
        (some(~kept) - F.coalesce(some(kept), F.lit(0))).alias("n_skipped"),
        ratio(some(right), some(kept)).alias("baseline_accuracy"),
        F.max("_k").alias("_k"),
        F.when(F.max("_k") == 2, (ratio(some(two & pos & right), some(two & pos)) + ratio(some(two & ~pos & right), some(two & ~pos))) / 2).alias("baseline_balanced_accuracy"),
        mean(kept, "margin").alias("mean_margin"),
        mean(right, "margin").alias("mean_margin_correct"),
        mean(~right, "margin").alias("mean_margin_wrong"),
        mean(two & pos, "score").alias("mean_pos"),
        mean(two & ~pos, "score").alias("mean_neg"),
    ).filter("n > 0")
    # Deviations from the means, in a second pass over the histogram: sums of squares would lose digits.
    spread = join_on(rows.filter(kept & two), base.select(*keys, "mean_pos", "mean_neg"), keys, "inner")
    square = lambda m: n * F.pow(F.col("score") - F.col(m), 2)
    variance = lambda cond, m: some(cond, square(m)) / some(cond)
    spread = spread.groupBy(*keys).agg(F.sqrt((variance(pos, "mean_pos") + variance(~pos, "mean_neg")) / 2).alias("_pooled"))
    confused = rows.filter(kept).groupBy(*keys, "gold", "pred").agg(F.sum("n").alias("n"))
    # The run's labels that no row shows count with an F1 of 0.
    seen = from_confusion(confused, keys, None).select(*keys, F.col("F1_macro").alias("_f1"))
    shown = confused.select(*keys, F.explode(F.array("gold", "pred")).alias("_x")).groupBy(*keys).agg(F.count_distinct("_x").alias("_seen"))
    tally = lambda by, hit: rows.filter(kept & two).groupBy(*keys, by).agg(F.coalesce(some(hit), F.lit(0)).alias("n_pos"), F.coalesce(some(~hit), F.lit(0)).alias("n_neg"))
    best = threshold_figures(tally("score", pos), keys, "score", buckets)
    margins = selective_figures(tally("margin", right), keys, "margin", buckets=buckets)
    best = best.select(*keys, "auroc", *[F.col(f"best.{c}").alias(f"threshold_best_{c}") for c in ("macro_f1", "accuracy", "balanced_accuracy", "threshold")])
    margins = margins.select(*keys, *[F.col(c).alias(f"margin_selective_{c}") for c in margins.columns if c not in keys])
    out = base
    for part in (spread, seen, shown, best, margins):
        out = join_on(out, part, keys)
    d_prime_ = F.when(F.col("_pooled") > 0, (F.col("mean_pos") - F.col("mean_neg")) / F.col("_pooled"))
    out = out.withColumns({"baseline_macro_f1": F.col("_f1") * F.col("_seen") / F.col("_k"), "type": F.when(F.col("_k") == 2, "binary").otherwise("multiclass"), "d_prime": d_prime_})
    return out.drop("_k", "_pooled", "_f1", "_seen")


def calibration_gain(audited: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of (best threshold - argmax) accuracy and macro-F1 over the binary runs."""
    gains = [F.avg(F.when(F.col("type") == "binary", F.col(f"threshold_best_{c}") - F.col(f"baseline_{c}"))).alias(f"{c}_gain") for c in ("accuracy", "macro_f1")]
    return audited.groupBy(*keys).agg(*gains) if keys else audited.agg(*gains)
