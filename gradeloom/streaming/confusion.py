"""Confusion counts over a stream of predictions, equal to the batch counts whatever the order of arrival.

Each item's standing row is kept in state without a time limit, keyed by shares of the items, so no row is too late.  A row that changes it gives
changes of counts, +1 for the new cell and -1 for the old one; each batch's changes are summed and stored in a folder of
their own, named by the batch.  A batch that runs again after a failure starts from the state before it and replaces its
folder, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.metrics import fold_other

#: Later than any time: rows without one stand only until one with a time comes.
NO_TIME = (1 << 63) - 1
#: With a hundred million items a share's state is some 3 MB.
SHARES = 1024


def _places(predictions: DataFrame, keys: list[str], labels: list[str] | None, time_col: str) -> DataFrame:
    """``_at`` and ``_row``: by the least of both an item's standing row is chosen."""
    cell = F.to_json(F.struct(*keys, "gold", "pred"))
    at = F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(NO_TIME))
    return fold_other(predictions, labels).withColumns({"_at": at, "_row": cell})


def _cell_type(predictions: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, predictions.schema[n].dataType) for n in [*keys, "gold", "pred"]])


def batch_confusion(predictions: DataFrame, keys: list[str], labels: list[str] | None, time_col: str = "ts", id_col: str = "item_id") -> DataFrame:
    """Counts per (keys, gold, pred) of a table, each item once: what ``stream_confusion`` gives for the same rows."""
    rows = _places(predictions, keys, labels, time_col)
    standing = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct("_at", "_row")).alias("_first")).select("_first._row")
    cells = standing.union(rows.filter(F.col(id_col).isNull()).select("_row")).select(F.from_json("_row", _cell_type(predictions, keys)).alias("c"))
    return cells.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c.*", "n")


def stream_confusion(predictions: DataFrame, keys: list[str], labels: list[str] | None, time_col: str = "ts", id_col: str = "item_id", shares: int = SHARES) -> DataFrame:
    """Changes of the counts per (keys, gold, pred) of a streaming DataFrame: the keys, gold, pred and ``change``.

    An item counts once: of its rows the one with the earliest time stands (of equal ones the first by its cell), however
    late it arrives; a row without a time is the latest.  Rows without an id count each.  Wrong answers outside
    ``labels`` share one bucket.  The state holds a time and a cell for each item; on a cluster keep it in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).

    Items are dealt by hash into ``shares``, and each share is settled at once: a Python call for each item took most of
    the time.  A batch reads and writes the whole state of the shares that it touches, so for very many items take more of
    them; a checkpoint keeps the number that it began with.
    """
    rows = _places(predictions, keys, labels, time_col)

    def settle(key, frames, state):
        import pandas as pd
        import pyarrow as pa

        def least(parts):
            return pd.concat(parts).sort_values(["_at", "_row"], kind="stable").drop_duplicates("_id")

        parts, waiting, held = [], 0, 0
        for frame in frames:
            parts.append(frame[["_id", "_at", "_row"]])
            waiting += len(frame)
            # An item that is sent very often doesn't pile up.
            if waiting > 2 * held + 100_000:
                parts, waiting = [least(parts)], 0
                held = len(parts[0])
        new = least(parts)
        if state.exists:
            old = pa.ipc.open_stream(state.get[0]).read_pandas().astype({"_row": object})
            both = new.merge(old, on="_id", suffixes=("", "_old"))
            # An item that was there changes only for an earlier row.
            both = both[(both["_at"] < both["_at_old"]) | ((both["_at"] == both["_at_old"]) & (both["_row"] < both["_row_old"]))]
            gone = both["_row_old"]
            new = new[new["_id"].isin(both["_id"]) | ~new["_id"].isin(old["_id"])]
            kept = pd.concat([old[~old["_id"].isin(new["_id"])], new]) if len(new) else None
        else:
            gone, kept = new["_row"][:0], new
        if kept is not None:
            table = pa.Table.from_pandas(kept.astype({"_row": "category"}), preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
        changes = new["_row"].value_counts().sub(gone.value_counts(), fill_value=0)
        changes = changes[changes != 0]
        if len(changes):
            yield pd.DataFrame({"_row": changes.index.astype(object), "change": changes.to_numpy().astype("int64")})

    change = T.StructType([T.StructField("_row", T.StringType()), T.StructField("change", T.LongType())])
    kept = T.StructType([T.StructField("items", T.BinaryType())])
    id_type = predictions.schema[id_col].dataType
    # An id of several parts goes by its JSON text, which pandas can compare.
    named_by = F.to_json(F.struct(id_col)) if isinstance(id_type, (T.StructType, T.ArrayType)) else F.col(id_col)
    named = rows.filter(F.col(id_col).isNotNull()).select(named_by.alias("_id"), "_at", "_row")
    dealt = named.withColumn("_share", F.pmod(F.xxhash64("_id"), F.lit(shares)))
    changes = dealt.groupBy("_share").applyInPandasWithState(settle, change, kept, "update", GroupStateTimeout.NoTimeout)
    nameless = rows.filter(F.col(id_col).isNull()).select("_row", F.lit(1).cast("long").alias("change"))
    return changes.union(nameless).select(F.from_json("_row", _cell_type(predictions, keys)).alias("c"), "change").select("c.*", "change")


def run_to_end(changes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off all that has arrived; may be called again with the same folders when more has, or after a failure."""
    cell = [c for c in changes.columns if c != "change"]

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*cell).agg(F.sum("change").alias("change")).filter("change <> 0").write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts_so_far(changes.sparkSession, path, T.StructType([*changes.select(*cell).schema.fields, T.StructField("change", T.LongType())]))


def counts_so_far(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The counts after all batches stored in ``path``; cells that have emptied are left out."""
    changes = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    return changes.groupBy(*[c for c in schema.names if c != "change"]).agg(F.sum("change").alias("n")).filter("n <> 0")
