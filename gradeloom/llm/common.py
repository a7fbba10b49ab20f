"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, stored  # noqa: F401 - operators import them from here

#: Words are maximal runs of anything but these ASCII white-space characters (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of buckets that are broadcast at most: some 30 MB.
MOST_BUCKETS = 1 << 19


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id falls in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod, F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def annotate(df: DataFrame, inputs: list[str], make: Callable, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Append columns that are computed batch by batch, without a shuffle.

    ``make()`` runs once in each task and returns a function from the Arrow arrays of ``inputs`` to one list (or Arrow
    array) per field.  Columns of ``df`` whose names equal a new one's (ignoring case) are replaced by it.
    ``keep``: the columns of ``df`` to carry along; all by default.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])
    kept_names, field_names = [f.name for f in kept], [f.name for f in fields]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds.get(f.dataType.simpleString()) for f in fields]
    df = df.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*kept_names, *inputs])])

    def run(batches):
        work = None
        for batch in batches:
            if work is None:
                work = make()
            if not batch.num_rows:
                continue
            made = work(*[batch.column(i) for i in inputs])
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept_names], *made], names=[*kept_names, *field_names])

    return df.mapInArrow(run, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucket_sums(df: DataFrame, group: list[str], size: str, bucket: Column) -> DataFrame:
    """(group, ``_bucket``, ``_sum``): the sum of ``size`` in each bucket of each group, stored."""
    return stored(df.groupBy(*group, bucket.alias("_bucket")).agg(F.sum(size).alias("_sum")))


def broadcast_if_small(stored_table: DataFrame) -> DataFrame:
    """Hint a stored table for a broadcast join if it has at most MOST_BUCKETS rows; else Spark joins it by a shuffle."""
    return F.broadcast(stored_table) if stored_table.count() <= MOST_BUCKETS else stored_table


def with_running_total(df: DataFrame, group: list[str], size: str, order: list[Column], bucket: Column, out: str, sums: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before this one in its group.

    Works in two levels, so no task sorts a whole group: the stored sums per (group, bucket) are summed over the buckets,
    and each bucket is ordered by itself, which shuffles the rows once.  ``bucket`` must be the leading part of the order,
    and coarse enough for the table of buckets to stay small; it is broadcast up to MOST_BUCKETS rows, and joined by a
    shuffle beyond that.  ``order`` must end with
    columns that make it total.  ``sums``: what ``bucket_sums`` has given for the same rows.
    """
    totals = sums if sums is not None else bucket_sums(df, group, size, bucket)
    df = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    totals = broadcast_if_small(totals)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = df.join(totals, on, "left").withColumn(out, F.col("_before") + F.col("_inside"))
    return joined.drop("_bucket", "_before", "_inside", *[f"_t_{k}" for k in keys])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
