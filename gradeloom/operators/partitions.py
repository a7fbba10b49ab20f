"""Running sums over a whole group without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .keys import join_on

#: Rank error of the quantile sketches is one in this many.
ACCURACY = 10_000


def quantile_cuts(df: DataFrame, keys: list[str], order: str, buckets: int) -> DataFrame:
    """(keys, ``_cuts``): values that cut each group's rows into ``buckets`` parts of about as many, from one sketch a group.

    The values come as a list of lists of about their square root, so that a row finds its part in two short steps.
    """
    side = max(1, round(buckets**0.5))
    kind = df.schema[order].dataType
    sketch = F.percentile_approx(order, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), ACCURACY) if buckets > 1 else F.lit(None)
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.coalesce(sketch.cast(T.ArrayType(kind)), F.array().cast(T.ArrayType(kind)))).alias("_all"))
    lists = f"CASE WHEN size(_all) > 0 THEN transform(sequence(0, cast((size(_all) - 1) div {side} AS int)), b -> slice(_all, b * {side} + 1, {side})) END"
    return cuts.select(*keys, F.expr(lists).alias("_cuts"))


def part_of(value: Column, cuts: Column) -> Column:
    """The number of cuts at or below the value; 0 where there are no cuts."""
    block = F.greatest(F.lit(0), F.size(F.filter(cuts, lambda c: c[0] <= value)) - 1)
    inside = F.size(F.filter(F.element_at(cuts, block + 1), lambda c: c <= value))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(block * F.size(cuts[0]) + inside)


def with_parts(df: DataFrame, keys: list[str], order: str, buckets: int) -> DataFrame:
    """Add ``_b``: the part of its group's range that a row is in.  Rows of a part meet in one task."""
    placed = join_on(df, stored(quantile_cuts(df, keys, order, buckets)), keys)
    # Dealt out by group and part: a join by group alone would satisfy the windows to come, with all of a group in one task.
    return placed.withColumn("_b", part_of(F.col(order), F.col("_cuts"))).drop("_cuts").repartition(*keys, "_b")


def in_order(df: DataFrame, keys: list[str], order: str, values: list[str], buckets: int | None = None) -> DataFrame:
    """Over the rows of each group by ``order`` (distinct numbers): ``{value}_before`` and ``{value}_all``, ``_prev`` and ``_next``.

    Without ``buckets`` a group is ordered by one task, which suits many groups.  With them each group's range is cut at
    about equal numbers of rows, however its values lie; each part is ordered by itself and shifted by the totals before
    it, so no task orders a whole group.  The rows are stored first, since they are read three times.
    """
    whole = Window.partitionBy(*keys)
    if buckets is None:
        w = whole.orderBy(order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        sums = {f"{v}_before": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values} | {f"{v}_all": F.sum(v).over(whole) for v in values}
        return df.withColumns({**sums, "_prev": F.lag(order).over(w), "_next": F.lead(order).over(w)})
    cut = with_parts(stored(df), keys, order, buckets)
    sums = cut.groupBy(*keys, "_b").agg(F.min(order).alias("_first"), F.max(order).alias("_last"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    # One row a part: at most ``buckets`` a group.
    w = whole.orderBy("_b")
    shifts = sums.select(
        *keys,
        "_b",
        F.lag("_last").over(w).alias("_p"),
        F.lead("_first").over(w).alias("_n"),
        *[F.coalesce(F.sum(f"_s_{v}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"{v}_all") for v in values],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumns({**{f"_i_{v}": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values}, "_lag": F.lag(order).over(inside), "_lead": F.lead(order).over(inside)})
    out = join_on(placed, stored(shifts), [*keys, "_b"])
    out = out.withColumns({**{f"{v}_before": F.col(f"_i_{v}") + F.col(f"_o_{v}") for v in values}, "_prev": F.coalesce("_lag", "_p"), "_next": F.coalesce("_lead", "_n")})
    return out.drop("_b", "_p", "_n", "_lag", "_lead", *[f"_{x}_{v}" for v in values for x in "io"])


def prefix_by_partition(df: DataFrame, order: str, values: list[str], buckets: int = 256) -> DataFrame:
    """Add ``{value}_before``: the sum over all rows of smaller ``order`` (distinct numbers), with the table as one group."""
    return in_order(df, [], order, values, buckets).drop("_prev", "_next", *[f"{v}_all" for v in values])


def with_rank(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    """Add each row's place in the whole table's ``order``, from 1, without a task that sorts it all.

    Rows are dealt into ranges and stored; each range is numbered by itself and shifted by the rows before it.  ``order``
    must be total, or else equal rows get their places in any order.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col("_range").alias("_of"), before.alias("_before"))
    placed = ranged.withColumn("_here", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    # One row for each range: as many as there are shuffle partitions.
    joined = placed.join(F.broadcast(shifts), F.col("_range") == F.col("_of"))
    return joined.withColumn(out, (F.col("_here") + F.col("_before")).cast("long")).drop("_range", "_of", "_here", "_before")
