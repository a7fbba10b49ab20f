"""Sharding by a k-d tree over document metadata, native DataFrame operations only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table, with_running_total

#: Values of each metadata dimension, and of the tie-break by md5 of the id.
CELLS, TIES = 1024, 4096
SPLIT = "node long,dim int,value int,tie int"
#: Rows of a table of tree nodes that are broadcast at most: some 10 MB.
MOST_SENT = 1 << 18
#: Fixed bytes of a row besides its text (given by the contract).
ROW_BYTES = 16


def text_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and ROW_BYTES."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long")


def metadata_dims(id_col: str, text_col: str, categories: list[str]) -> dict[str, Column]:
    """Dimensions as integers from 0 to CELLS - 1: log of the text's bytes, and a hash for each category column.

    Equal values share a cell; a null category is a value like any other.
    """
    size = F.least(F.lit(CELLS - 1), F.floor(F.log2(text_bytes(text_col).cast("double")) * (CELLS / 48))).cast("int")
    dims = {"_size": size}
    for k, c in enumerate(categories):
        dims[f"_cat{k}"] = (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\0")).cast("binary")) % CELLS).cast("int")
    return dims


def tie_break(id_col: str) -> Column:
    """One of TIES cells by md5 of the id; null ids share one."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few numbers per tree node.  Up to MOST_SENT rows it is broadcast; beyond that Spark joins it by a shuffle."""
    names = [f.split()[0] for f in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    df = spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))
    return F.broadcast(df) if len(rows) <= MOST_SENT else df.hint("shuffle_hash")


def step(df: DataFrame, splits: DataFrame, dims: list[str]) -> DataFrame:
    """Follow one level of splits (node, dim, value, tie) from the row's ``_node``; rows of other nodes stay where they are."""
    cell = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("_s.dim"))
    right = ((cell > F.col("_s.value")) | ((cell == F.col("_s.value")) & (F.col("_tie") >= F.col("_s.tie")))).cast("long")
    kept = [F.col(f"`{c}`") for c in df.columns if c != "_node"]
    df = df.join(splits.select(F.struct("node", "dim", "value", "tie").alias("_s")), F.col("_node") == F.col("_s.node"), "left")
    return df.select(*kept, F.when(F.col("_s").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + right).alias("_node"))


def at_root() -> Column:
    """Node 1; said by a column, so that the first join has a key like the others."""
    return (F.col("_tie") >= 0).cast("long")


def grow_tree(docs: DataFrame, leaves: int, id_col: str, text_col: str, categories: list[str]) -> tuple[list[tuple[int, int, int, int]], dict[int, int], int]:
    """Split nodes at weighted medians until there are ``leaves``.

    Returns the splits (node, number of the dimension from 1, value, tie: rows below (value, tie) go to node 2 n, the rest
    to 2 n + 1), the shard of each leaf, and the number of levels.  A node that is to hold k leaves is cut at floor(k/2)/k
    of its bytes, along the dimension in which its values spread widest (of the table's whole spread).  The cut is found by
    two histograms, over the dimension's cells and over the tie-break within one cell; nodes of a level are worked on
    together.  The driver sees a few numbers per node.
    """
    spark = docs.sparkSession
    dims = metadata_dims(id_col, text_col, categories)
    order = list(dims)
    slim = docs.select(*[c.alias(n) for n, c in dims.items()], tie_break(id_col).alias("_tie"), text_bytes(text_col).alias("_bytes"))
    rows = stored(slim.groupBy(*dims, "_tie").agg(F.sum("_bytes").alias("_bytes")).withColumn("_node", at_root()))
    spans = rows.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    splits: list[tuple[int, int, int, int]] = []
    level, first, shards, depth = {1: leaves}, {1: 0}, {}, 0
    while True:
        shards |= {n: first[n] for n, k in level.items() if k == 1}
        level = {n: k for n, k in level.items() if k > 1}
        if not level:
            discard(rows)
            return splits, shards, depth
        widths = {r["_node"]: r for r in rows.groupBy("_node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims], F.sum("_bytes").alias("_bytes")).collect()}
        widest = {n: max(range(len(order)), key=lambda d, n=n: (widths[n][order[d]] / (spans[order[d]] or 1), -d)) + 1 if n in widths else 1 for n in level}
        goals = {n: widths[n]["_bytes"] * (k // 2) / k if n in widths else 0.0 for n, k in level.items()}
        wanted = small_table(spark, [(n, widest[n], goals[n]) for n in level], "node long,dim int,goal double")
        inside = rows.join(wanted, F.col("_node") == F.col("node")).withColumn("_value", F.element_at(F.array(*order), F.col("dim")))
        cells = crossing(inside.groupBy("_node", "goal", "_value").agg(F.sum("_bytes").alias("_bytes")), "_value")
        ties = {}
        if cells:
            at = small_table(spark, [(n, widest[n], value, goals[n] - before) for n, (value, before) in cells.items()], "node long,dim int,value int,goal double")
            within = rows.join(at, F.col("_node") == F.col("node")).filter(F.element_at(F.array(*order), F.col("dim")) == F.col("value"))
            ties = crossing(within.groupBy("_node", "goal", "_tie").agg(F.sum("_bytes").alias("_bytes")), "_tie", nearest=True)
        following, starts, found = {}, {}, []
        for n, k in level.items():
            found.append((n, widest[n], cells.get(n, (0, 0.0))[0], ties.get(n, (0, 0.0))[0]))
            following |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
            starts |= {2 * n: first[n], 2 * n + 1: first[n] + k // 2}
        splits += found
        moved, open_nodes = step(rows, small_table(spark, found, SPLIT), order), [(n,) for n, k in following.items() if k > 1]
        moved = stored(moved.join(small_table(spark, open_nodes, "n long"), F.col("_node") == F.col("n"), "left_semi"))
        discard(rows)
        rows, level, first, depth = moved, following, starts, depth + 1


def crossing(counts: DataFrame, value: str, nearest: bool = False) -> dict[int, tuple[int, float]]:
    """For each node the ``value`` at which its ``goal`` of bytes is reached, and the bytes below it.

    That is the last one with no more bytes below it than wanted, or with ``nearest`` the one with the nearest number.
    A node has at most as many rows here as there are cells.
    """
    below = F.coalesce(F.sum("_bytes").over(Window.partitionBy("_node").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_below", below).withColumn("_off", F.col("_below") - F.col("goal"))
    ranked = ranked if nearest else ranked.filter("_off <= 0")
    last = ranked.groupBy("_node").agg(F.min_by(F.struct(value, "_below"), F.struct(F.abs("_off"), value)).alias("_x"))
    return {r["_node"]: (r["_x"][0], float(r["_x"][1])) for r in last.collect()}


def assign_shards(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", categories: list[str] | None = None) -> DataFrame:
    """Add ``shard`` (int): the leaf of the k-d tree that holds the row.  Pass ``leaves``, or ``target_bytes`` per leaf.

    A row counts its text's UTF-8 bytes and 16.  Null texts count 16; null ids share one tie-break cell; rows that
    repeat an id stand in one shard.  An empty table has no rows to place.  An input column named ``shard`` is replaced.
    """
    categories = [c for c in (categories or []) if c in docs.columns]
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "shard"])
    if leaves is None:
        total = docs.agg(F.sum(text_bytes(text_col))).first()[0] or 0
        leaves = max(1, -(-total // max(1, target_bytes)))
    splits, shards, depth = grow_tree(docs, leaves, id_col, text_col, categories)
    spark, dims = docs.sparkSession, metadata_dims(id_col, text_col, categories)
    coded = docs.withColumns({**dims, "_tie": tie_break(id_col)}).withColumn("_node", at_root())
    for k in range(depth):
        # Nodes of level k have k + 1 binary digits.
        coded = step(coded, small_table(spark, [s for s in splits if s[0].bit_length() == k + 1], SPLIT), list(dims))
    named = small_table(spark, list(shards.items()), "leaf long,shard int")
    return coded.join(named, F.col("_node") == F.col("leaf"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "shard")


def with_slots(sharded: DataFrame, id_col: str = "doc_id", tie: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """Add ``slot`` (long): the row's place in its shard, from 0 without gaps.

    The order is that of ``order``, whose first column should have few values for its number of rows, or else of md5 of the
    id.  Rows that repeat an id stand side by side, by ``tie``.
    """
    sharded = sharded.drop(*[c for c in sharded.columns if c.lower() == "slot"])
    if order is not None:
        keys = {f"_o{k}": c for k, c in enumerate(order)}
        placed = with_running_total(sharded.withColumns({**keys, "_one": F.lit(1)}), ["shard"], "_one", [F.col(k) for k in keys], F.col("_o0"), "slot")
        return placed.withColumn("slot", F.col("slot").cast("long")).drop("_one", *keys)
    hashed = sharded.withColumn("_one", F.lit(1)).withColumn("_hash", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    ordered = [F.col("_hash"), F.col(id_col), *([tie] if tie is not None else [])]
    placed = with_running_total(hashed, ["shard"], "_one", ordered, F.substring("_hash", 1, 3), "slot")
    return placed.withColumn("slot", F.col("slot").cast("long")).drop("_one", "_hash")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and its slot, by the law ``bytes``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    sharded = assign_shards(docs, leaves=40, categories=["source", "lang"])
    slim = sharded.select("doc_id", text_bytes().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "shard")
    out = with_slots(slim, tie=F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE: dict[str, str] = {}
