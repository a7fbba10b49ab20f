"""SimHash near-dedup with BK-trees over shards of fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, discard, stored, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: A fingerprint's 64 bits in five blocks: two that differ in at most two bits agree in three of them.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints in one shard tree.  Larger shards are split by the bits that are left.
TREE_LIMIT = 512
#: Blocks of the bits left in such a shard: of six, two fingerprints agree in four, so at most 10 bits stay open.
SPLIT_BLOCKS = 6
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over word shingles: a bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(w, w[1:], w[2:]))) if len(w) >= SHINGLE else [b" ".join(w)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + CHUNK]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


class BKTree:
    """Nodes hang below their parent by their Hamming distance to it; a search follows the edges within the radius only."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the values at ``radius`` or less."""
        found, todo = [], [0] if self.values else []
        while todo:
            k = todo.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            below = self.children[k]
            todo.extend(below[e] for e in range(d - radius, d + radius + 1) if e in below)
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        k, new = 0, len(self.values) - 1
        while new:
            d = (self.values[k] ^ value).bit_count()
            if d not in self.children[k]:
                self.children[k][d] = new
                return
            k = self.children[k][d]


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs within the radius that connect all that is connected in this shard; links that close a circle are left out."""
    tree, root, links = BKTree(), list(range(len(values))), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k, value in enumerate(values):
        for other in tree.within(value, radius):
            if (a := top(k)) != (b := top(other)):
                root[a] = b
                links.append((k, other))
        tree.add(value)
    return links


def _masks() -> list[int]:
    """For each choice of three of the five blocks, a mask of their bits (as a signed 64-bit number)."""
    blocks, at = [], 0
    for n in BLOCKS:
        blocks.append(((1 << n) - 1) << at)
        at += n
    masks = [sum(x) for x in combinations(blocks, len(BLOCKS) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _split_masks() -> list[list[int]]:
    """For each mask, masks of the choices of four of six blocks of the bits that it leaves open."""
    out = []
    for mask in _masks():
        free = [1 << b for b in range(64) if not (mask >> b) & 1]
        n = -(-len(free) // SPLIT_BLOCKS)
        blocks = [sum(free[k * n : (k + 1) * n]) for k in range(SPLIT_BLOCKS)]
        subs = [sum(x) for x in combinations(blocks, SPLIT_BLOCKS - RADIUS)]
        out.append([m - (1 << 64) if m >> 63 else m for m in subs])
    return out


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a > b, by ``node``) between fingerprints (``node`` long, ``fp`` long, distinct) at distance ``RADIUS`` or less.

    Not all links: as many as connect what is connected.  Each fingerprint stands in ten shards, one for each choice of
    three of its five blocks of bits; any two that are near share one.  A shard of more than ``TREE_LIMIT`` fingerprints
    is split the same way by the other bits, after which at most 10 bits are open, so it can't hold more than 1,024.  Each shard's BK-tree is built and
    searched where the shard is.
    """
    masks = _masks()
    keyed = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(masks)])).alias("s"))
    keyed = keyed.select("node", "fp", "s.part", "s.bits")
    # Stored, so that the aggregate doesn't fix the join's partitions and Spark splits a shard that very many share.
    sizes = stored(keyed.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = keyed.join(sizes, ["part", "bits"])
    subs = F.array(*[F.array(*[F.lit(m).cast("long") for m in group]) for group in _split_masks()])
    small = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("more")))
    split = F.transform(F.element_at(subs, F.col("part") + 1), lambda m, k: F.struct(k.cast("int").alias("sub"), F.col("fp").bitwiseAND(m).alias("more")))
    dealt = shared.withColumn("t", F.explode(F.when(F.col("n") <= TREE_LIMIT, small).otherwise(split))).select("part", "bits", "t.sub", "t.more", "node", "fp")
    keys = ["part", "bits", "sub", "more"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def link(batches):
        held: list[np.ndarray] | None = None

        def shards(cols: list[np.ndarray], last: bool):
            """Complete shards of the rows so far; what may go on in the next batch is held back."""
            nonlocal held
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            edges = [0, *change.tolist(), len(cols[0])]
            if not last:
                held = [c[edges[-2] :] for c in cols]
                edges.pop()
            for lo, hi in zip(edges, edges[1:]):
                if hi - lo > 1:
                    yield cols[4][lo:hi], cols[5][lo:hi]

        def out(cols, last):
            a, b = [], []
            for node, fp in shards(cols, last):
                ids = node.tolist()
                for x, y in tree_links(fp.view(np.uint64).tolist()):
                    a.append(max(ids[x], ids[y]))
                    b.append(min(ids[x], ids[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            yield out(cols, False)
        if held is not None:
            yield out(held, True)

    return dealt.mapInArrow(link, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Alternates large-star and small-star rounds until the links are stars around the roots; the number of rounds grows
    with the logarithm of the longest chain.  A hub's links meet in joins on the hub
    only.  The smallest neighbours are stored before each join, so that no aggregate fixes its partitions and Spark splits
    those of a hub.
    """
    edges, before = stored(links), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
        large = stored(both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        smallest = stored(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"))
        moved = large.join(smallest, F.col("a") == F.col("k")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = stored(moved.unionByName(smallest.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
        discard(edges, least, large, smallest)
        edges = following


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``) for each row: the smallest id reachable over links of two bits or fewer.

    Words are runs of non-blanks of the text, lower-cased (A-Z); a text of one or two words is one shingle.  Null, empty
    and blank texts have fingerprint zero and link like any other, so they form one component.  Rows that repeat an id
    with other texts connect their components only through the texts.  Rows without an id get the component of their
    fingerprint, or null where no row with an id has it (such fingerprints link to none).
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(annotate(slim, ["text"], lambda: lambda texts: [[fingerprint(t.as_py()) for t in texts]], [T.StructField("fp", T.LongType())], keep=["doc_id"]))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(near_links(nodes.filter("node is not null")))
    # Stored, so that the join below has only its own exchanges and Spark can split a fingerprint that very many rows share.
    nodes = stored(nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    return prints.join(nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; one of the rows that repeat such an id.

    Of rows without an id, one stays for each fingerprint that no row with an id has.  Repeats of an id, and nameless rows
    of one fingerprint, are cut to one in each partition before they are shuffled for the rank.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, F.col(id_col) == F.col("_kept"), "left_semi")
    first = Window.partitionBy(id_col).orderBy(text_col)
    rows = rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    nameless = annotate(docs.filter(F.col(id_col).isNull()), [text_col], lambda: lambda texts: [[fingerprint(t.as_py()) for t in texts]], [T.StructField("_fp", T.LongType())])
    taken = found.filter("doc_id is not null").select(F.conv(F.col("fingerprint"), 16, -10).cast("long").alias("_taken")).distinct()
    nameless = nameless.join(taken, F.col("_fp") == F.col("_taken"), "left_anti")
    nameless = nameless.withColumn("_rank", F.row_number().over(Window.partitionBy("_fp").orderBy(text_col))).filter("_rank = 1").drop("_rank", "_fp")
    return rows.unionByName(nameless.select(*docs.columns))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE: dict[str, str] = {}
