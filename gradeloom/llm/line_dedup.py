"""Line dedup: repeated windows of three consecutive lines, native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WINDOW = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove the lines that later occurrences of a repeated window of ``window`` consecutive lines cover.

    Windows overlap: one starts at every line that has ``window - 1`` lines after it.  Equal windows anywhere in the
    table, the same document included, form a group; the first in the order (id, hash of the text, position) stays and
    all others cover their lines.  A document keeps its uncovered lines, joined by newlines.

    Returns the columns of ``docs`` with the text replaced, and ``n_lines`` and ``n_removed`` (long).

    Lines are what stands between newlines, so an empty text has one empty line.  A null text has no lines, stays null
    and gives 0 and 0.  Texts of fewer than ``window`` lines have no window and stay as they are.  Rows that repeat both
    id and text count as one document and get the same result.  Null ids sort first.  Input columns named ``n_lines``
    or ``n_removed`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    key = docs.withColumn("_fp", F.xxhash64(text_col))
    lines = F.split(F.col(text_col), "\n", -1)
    # md5 of the window's lines: 128 bits, so unequal windows don't meet even among 10^12 windows.
    windows = (
        key.select(F.col(id_col).alias("_id"), "_fp", lines.alias("_lines"))
        .filter(F.size("_lines") >= window)
        .select("_id", "_fp", F.posexplode(F.expr(f"transform(sequence(0, size(_lines) - {window}), i -> unhex(md5(array_join(slice(_lines, i + 1, {window}), '\\n'))))")).alias("_pos", "_hash"))
    )
    place = F.struct("_id", "_fp", "_pos")
    # Partial aggregation leaves one row per window and task, so a window that a third of all rows share stays cheap.
    repeated = windows.groupBy("_hash").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_hash").alias("_h"), "_first")
    # Stored, so that no aggregate fixes the join's partitions, and Spark splits a window that very many rows share.
    repeated = stored(repeated)
    later = windows.join(repeated, F.col("_hash") == F.col("_h")).filter(place != F.col("_first"))
    covered = later.groupBy("_id", "_fp").agg(F.collect_set("_pos").alias("_starts"))
    covered = covered.select(F.col("_id").alias("_cid"), F.col("_fp").alias("_cfp"), F.expr(f"array_distinct(flatten(transform(_starts, p -> sequence(p, p + {window - 1}))))").alias("_gone"))
    joined = key.join(covered, F.col(id_col).eqNullSafe(F.col("_cid")) & (F.col("_fp") == F.col("_cfp")), "left")
    # A map from position to true makes the test for each line cheap in texts of many lines.
    joined = joined.withColumn("_lines", lines).withColumn("_map", F.expr("map_from_arrays(_gone, transform(_gone, p -> true))"))
    left = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.expr("array_join(filter(_lines, (l, i) -> element_at(_map, i) is null), '\\n')"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    n_removed = F.coalesce(F.size("_gone"), F.lit(0))
    n_removed = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(n_removed).cast("long")
    return joined.select(*[left.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat: doc_id, n_lines, n_removed, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, md5(line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w) AS h
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS rn FROM windows WHERE h IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1
), parts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(p.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed, p.text
FROM documents d LEFT JOIN parts p ON d.doc_id = p.doc_id
""",
}
