"""Classification metrics, all derived from one table of confusion counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.scratch import stored
from .keys import join_on

OTHER = "__other__"
#: Observed labels that get a column each at most.
MOST_LABELS = 1_000


def apply_null_policy(df: DataFrame, policy: str = "drop") -> DataFrame:
    """``drop`` rows without gold or pred; ``failed`` counts a missing pred as FAILED; ``none_label`` as none; ``unparseable`` as that."""
    if policy == "drop":
        return df.dropna(subset=["gold", "pred"])
    word = {"failed": "FAILED", "none_label": "none", "unparseable": "unparseable"}[policy]
    return df.withColumn("pred", F.coalesce("pred", F.lit(word)))


def fold_other(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Predictions outside ``labels`` as one bucket, unless they are right; all as they are without labels."""
    if labels is None:
        return df
    known = F.col("pred").isin(labels) | (F.col("pred") == F.col("gold"))
    return df.withColumn("pred", F.when(known, F.col("pred")).otherwise(F.lit(OTHER)))


def confusion(df: DataFrame, keys: list[str], labels: list[str] | None = None) -> DataFrame:
    """Rows per (keys, gold, pred).  With fixed labels, all other predictions are one bucket, so free text can't widen the groups."""
    return fold_other(df, labels).groupBy(*keys, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """tp, support and predicted rows per (keys, label), over the labels that gold or pred show."""
    side = counts.select(*keys, F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("s"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    return side.groupBy(*keys, "s.label").agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0)).alias("tp"))


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def metrics(df: DataFrame, keys: list[str], labels: list[str] | None = None, policy: str = "drop", absent: float | None = None, per_class: bool = True) -> DataFrame:
    """N, ACC, P_macro, R_macro, F1_macro per group, and ``ACC_<label>`` (or EACC, NACC, CACC) for fixed labels.

    With ``labels`` the means are over those, 0 where undefined; without, over the labels that occur in the group.  An
    absent class has accuracy ``absent`` (null by default).
    """
    return from_confusion(confusion(apply_null_policy(df, policy), keys, labels), keys, labels, absent, per_class)


def from_confusion(counts: DataFrame, keys: list[str], labels: list[str] | None, absent: float | None = None, per_class: bool = True) -> DataFrame:
    classes = class_counts(counts, keys)
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    inside = F.col("label").isin(labels) if labels is not None else F.lit(True)
    k = F.lit(len(labels)) if labels is not None else F.count(F.lit(1))
    mean = lambda x: F.coalesce(F.sum(F.when(inside, x)), F.lit(0.0)) / k
    aggs = [F.sum("support").alias("N"), (F.sum("tp") / F.sum("support")).alias("ACC"), mean(p).alias("P_macro"), mean(r).alias("R_macro"), mean(f1).alias("F1_macro")]
    if labels is not None and per_class:
        for x in labels:
            hit = F.sum(F.when(F.col("label") == x, F.col("tp")))
            all_ = F.sum(F.when(F.col("label") == x, F.col("support")))
            aggs.append(_ratio(hit, all_, absent).alias(L.ACCURACY_NAMES.get(x.upper(), f"ACC_{L.safe_name(x)}")))
    return classes.groupBy(*keys).agg(*aggs) if keys else classes.agg(*aggs)


def metrics_by_task(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form for many tasks in one job: macro means over each task's own labels (tasks without a list: observed ones),
    with the accuracies of its classes as a map.  ``keys`` includes ``task``."""
    family = F.create_map(*[F.lit(x) for t, ls in L.LABELS.items() for x in (t, F.array(*[F.lit(v) for v in ls]))])
    known = F.try_element_at(family, F.when(F.col("task").isin("interview_nli", "nli_caption"), F.lit("nli")).otherwise(F.col("task")))
    counts = confusion(apply_null_policy(df), keys)
    classes = class_counts(counts, keys).withColumn("_labels", known)
    inside = F.col("_labels").isNull() | F.array_contains("_labels", F.col("label"))
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    k = F.when(F.max(F.col("_labels").isNotNull()), F.max(F.size("_labels"))).otherwise(F.count(F.lit(1)))
    mean = lambda x: F.coalesce(F.sum(F.when(inside, x)), F.lit(0.0)) / k
    accs = F.map_from_entries(F.sort_array(F.collect_list(F.when(inside & (F.col("support") > 0), F.struct("label", (F.col("tp") / F.col("support")).alias("acc"))))))
    return classes.groupBy(*keys).agg(F.sum("support").alias("N"), (F.sum("tp") / F.sum("support")).alias("ACC"), mean(p).alias("P_macro"), mean(r).alias("R_macro"), mean(f1).alias("F1_macro"), accs.alias("class_acc"))


def pooled(df: DataFrame, levels: list[list[str]], labels: list[str], unparseable: str = "unparseable") -> DataFrame:
    """Metrics at several levels from the same counts (never means of means), with the share of unparseable answers and the
    accuracy on the others.  Columns outside a level are null."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    # Unparseable answers stay apart; they only differ from others in being counted.  Stored: two aggregations read them.
    counts = stored(confusion(df.withColumn("_u", F.col("pred") == unparseable), [*keys, "_u"], labels))
    cell = ["gold", "pred", "_u"]
    rolled = counts.groupingSets([[*level, *cell] for level in levels], *keys, *cell).agg(F.sum("n").alias("n"), F.grouping_id().alias("_level"))
    at = ["_level", *keys]
    figures = from_confusion(rolled, at, labels, absent=0.0)
    right = F.col("gold") == F.col("pred")
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    share = rolled.groupBy(*at).agg(some(F.col("_u")).alias("_bad"), F.sum("n").alias("_all"), some(right).alias("_ok"))
    share = share.select(*at, (F.col("_bad") / F.col("_all")).alias("unparseable_rate"), _ratio(F.col("_ok"), F.col("_all") - F.col("_bad"), None).alias("parseable_ACC"))
    # A bit for each column that a level rolls up, the first column's the highest.
    bits = lambda level: sum((k not in level) << (len(keys) + len(cell) - 1 - i) for i, k in enumerate(keys))
    named = F.create_map(*[x for level in levels for x in (F.lit(bits(level)).cast("long"), F.lit("/".join(level)))])
    return join_on(figures, share, at).withColumn("level", named[F.col("_level")]).drop("_level")


def comprehensive(df: DataFrame) -> DataFrame:
    """By model and difficulty over entailment, contradiction, neutral and unparseable; other answers leave N."""
    words = ["entailment", "contradiction", "neutral", "unparseable"]
    rows = df.filter(F.col("difficulty").isin(L.DIFFICULTIES)).withColumns({"gold": F.lower("gold"), "pred": F.lower("pred")})
    rows = rows.filter(F.col("gold").isin(words) & F.col("pred").isin(words))
    counts = confusion(rows, ["model", "difficulty"])
    base = from_confusion(counts, ["model", "difficulty"], None)
    accs = from_confusion(counts, ["model", "difficulty"], words, absent=0.0).select("model", "difficulty", "EACC", "NACC", "CACC", "ACC_UNPARSEABLE")
    return join_on(base, accs, ["model", "difficulty"])


def summary(table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Unweighted means over the rows of each model, rounded to three places, and the rank by the first column."""
    means = table.groupBy(by).agg(*[F.round(F.avg(c), 3).alias(c) for c in columns])
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.col(columns[0]).desc(), by)))


def top_models(table: DataFrame, by: str, score: str, n: int = 5) -> DataFrame:
    return table.groupBy(by).agg(F.avg(score).alias(score)).orderBy(F.col(score).desc(), by).limit(n)


def business_order(df: DataFrame, *keys: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(d) for d in L.DIFFICULTIES]), F.col("difficulty"))
    return df.orderBy(*keys, F.nullif(rank, F.lit(0)).asc_nulls_last())


def prediction_shares(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys, "pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def balanced_accuracy(df: DataFrame, keys: list[str], positive: str) -> DataFrame:
    g, p = F.col("gold") == positive, F.col("pred") == positive
    tpr = _ratio(F.count_if(g & p), F.count_if(g))
    tnr = _ratio(F.count_if(~g & ~p), F.count_if(~g))
    return df.groupBy(*keys).agg(((tpr + tnr) / 2).alias("balanced_accuracy"))


def restraint_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hallucination: SUPPORTED said of unsupported; support: of supported; SRA: hallucinated of all rows."""
    said = F.col("pred") == "SUPPORTED"
    un, sup = F.col("gold") == "UNSUPPORTED", F.col("gold") == "SUPPORTED"
    return df.groupBy(*keys).agg(_ratio(F.count_if(un & said), F.count_if(un), None).alias("hallucination"), _ratio(F.count_if(sup & said), F.count_if(sup), None).alias("support"), (F.count_if(un & said) / F.count(F.lit(1))).alias("SRA"))


def accent_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    said = F.col("pred") == "TRUE"
    lure, true = F.col("gold") == "FALSE", F.col("gold") == "TRUE"
    return df.groupBy(*keys).agg(_ratio(F.count_if(lure & said), F.count_if(lure), None).alias("bias"), _ratio(F.count_if(true & said), F.count_if(true), None).alias("accept"))


def over_inference(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of neutral rows called entailment, and accuracy on easy less that on hard rows."""
    acc = lambda d: _ratio(F.count_if((F.col("difficulty") == d) & (F.col("gold") == F.col("pred"))), F.count_if(F.col("difficulty") == d), None)
    neutral = F.col("gold") == "NEUTRAL"
    return df.groupBy(*keys).agg(_ratio(F.count_if(neutral & (F.col("pred") == "ENTAILMENT")), F.count_if(neutral), None).alias("over_inference"), (acc("easy") - acc("hard")).alias("easy_to_hard_drop"))


def variant_consistency(df: DataFrame, model: str, clip: str) -> DataFrame:
    """Per model: mean and variance of correctness within (clip, gold), and the share of such sets that agree throughout."""
    right = (F.col("gold") == F.col("pred")).cast("double")
    sets = df.groupBy(model, clip, "gold").agg(F.avg(right).alias("m"), F.var_pop(right).alias("v"))
    return sets.groupBy(model).agg(F.avg("m").alias("mean_correct"), F.avg("v").alias("mean_variance"), F.avg((F.col("v") == 0).cast("double")).alias("agreeing"))


def error_asymmetry(df: DataFrame, model: str, domain: str) -> DataFrame:
    errors = df.groupBy(model, domain).agg(F.avg((F.col("gold") != F.col("pred")).cast("double")).alias("e"))
    return errors.groupBy(model).agg((F.max("e") - F.min("e")).alias("error_asymmetry"))


def accounting(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def report(table: DataFrame, keys: list[str]) -> DataFrame:
    """Short names and four decimals as text; null as ''."""
    names = {"ACC": "ACC", "P_macro": "P", "R_macro": "R", "F1_macro": "F1"}
    return table.select(*keys, "N", *[F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("")).alias(n) for c, n in names.items()])


def distinct_sketches(df: DataFrame, keys: list[str], column: str, bits: int = 12) -> DataFrame:
    """(keys, ``sketch``, ``bits``): a HyperLogLog sketch of the column's values for each part, to be stored and united later."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(column), bits).alias("sketch")).withColumn("bits", F.lit(bits))


def united_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``estimate``): distinct values over all parts; within 3 x 1.04 / sqrt(2^bits) in all but some of a thousand cases."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def column_names(labels: list[str | None], prefix: str = "ACC_", upper: bool = True) -> dict[str | None, str]:
    """A column name for each label: safe (letters, digits and underscores), and unlike any other's whatever the case.

    Labels are taken in order, the missing one last; one whose name is taken gets the next free number.
    """
    names, taken = {}, set()
    for label in sorted(labels, key=lambda x: (x is None, x)):
        plain = re.sub(r"\W", "_", L.safe_name("null" if label is None else label, upper))
        name, k = f"{prefix}{plain}", 1
        while name.lower() in taken:
            k += 1
            name = f"{prefix}{plain}_{k}"
        taken.add(name.lower())
        names[label] = name
    return names


def metrics_observed(df: DataFrame, keys: list[str], policy: str = "drop", upper: bool = True, absent: float | None = None) -> DataFrame:
    """``metrics`` over the labels that occur, with a column for the accuracy of each label that gold or pred shows.

    The confusion counts are stored and their labels collected: at most MOST_LABELS, more are an error, since each is a
    column.  A class that a group's gold labels lack has ``absent``, so one that is only predicted has it everywhere.
    """
    counts = stored(confusion(apply_null_policy(df, policy), keys))
    labels = [r["x"] for r in counts.select(F.explode(F.array("gold", "pred")).alias("x")).distinct().limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels; a column for each is of no use")
    names = column_names(labels, upper=upper)
    hit = lambda x: F.col("gold").eqNullSafe(F.lit(x))
    accs = [_ratio(F.sum(F.when(hit(x) & (F.col("gold") == F.col("pred")), F.col("n")).otherwise(0)), F.sum(F.when(hit(x), F.col("n")).otherwise(0)), absent).alias(name) for x, name in names.items()]
    base = from_confusion(counts, keys, None)
    if not accs:
        return base
    return join_on(base, counts.groupBy(*keys).agg(*accs), keys)
