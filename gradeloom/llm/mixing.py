"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, bucket_sums, stored, table, with_running_total

BLANK = r"[\x20\x09-\x0D]"
#: Most times that a source is taken.
MAX_REPEATS = 3
#: (start, end) of the rate at which a source's words are wanted, over training time 0 to 1, by weight 1, 2, 3:
#: light sources come early, heavy ones late.  Each is scaled so that its integral is the source's target.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def n_words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): weight and target of each source; one row per source, so the windows here are small.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes by weight.  A target
    stops at ``MAX_REPEATS`` times its source's size and the excess goes to the others by weight, until none is above:
    with the sources by (limit / weight), the level is what is left for the uncapped, per unit of their weight.
    """
    weighed = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).withColumn("_limit", F.col("source_size") * MAX_REPEATS)
    rising = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        # The first source whose limit isn't reached at its level sets the level of all later ones.
        .withColumn("_free", F.when(F.col("_level") * F.col("weight") < F.col("_limit"), F.col("_level")))
        .withColumn("_at", F.first("_free", ignorenulls=True).over(Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.coalesce(F.least(F.col("_limit").cast("double"), F.col("_at") * F.col("weight")), F.col("_limit").cast("double"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def curve(total: Column, weight: Column, target: Column) -> list[Column]:
    """Over all sources: slope and bend of the mix's cumulative demand, as a share, in time: slope * t + bend * t^2.

    A source wants target * (2 start t + (end - start) t^2) / (start + end) words until time t.
    """
    parts = []
    for at in (0, 1):
        sums = F.lit(0.0)
        for k, (start, end) in enumerate(SCHEDULES):
            rate = (2 * start if at == 0 else end - start) / (start + end)
            sums = sums + F.when(weight == k + 1, target * rate).otherwise(0.0)
        parts.append(F.sum(sums).over(Window.partitionBy()) / total)
    return parts


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document, and when.

    Within a source, documents stand in the order of md5 of their id; ``offset`` is the number of words before one.  The
    source is read from its start, again and again, until its target: ``taken`` is what of the document's words (repeats
    counted) that covers, so a source's sum is its target to a word, and no document exceeds ``MAX_REPEATS`` times its
    size.  Returns the input columns and ``size, source_size, target, offset, taken, weight``, ``parts`` (array: the words
    taken in each reading) and ``positions`` (array: the training position of each reading, null where nothing is taken).

    A position is a share, 0 to 1, of the words of the whole mix: the time at which the source's schedule has wanted the
    words before this reading is found by inverting its integral, and the demand of all sources until then is summed.

    Null and blank texts have size 0 and nothing of them is taken.  Null sources form one source, the last.  Repeated
    rows stand side by side and are taken each for itself.  A source of size 0 has target 0.  Input columns with the
    names of the new ones are replaced.
    """
    made = {"size", "source_size", "target", "offset", "taken", "weight", "parts", "positions"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    sized = docs.withColumn("size", n_words(text_col)).withColumn("_hash", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    bucket = F.substring("_hash", 1, 3)
    sums = bucket_sums(sized, [source_col], "size", bucket)
    totals = sums.groupBy(F.col(source_col).alias("source")).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(totals).withColumnRenamed("source", "_source")
    slope, bend = curve(F.nullif(F.sum("target").over(Window.partitionBy()), F.lit(0.0)), F.col("weight"), F.col("target"))
    targets = broadcast_if_small(stored(targets.withColumns({"_slope": slope, "_bend": bend})))
    order = [F.col("_hash"), F.col(id_col), F.col("size")]
    placed = with_running_total(sized, [source_col], "size", order, bucket, "offset", sums)
    joined = placed.join(targets, F.col(source_col).eqNullSafe(F.col("_source")), "left")
    goal = F.round("target").cast("long")
    part = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("offset") - k * F.col("source_size"))).cast("long")
    joined = joined.withColumn("parts", F.array(*[part(k) for k in range(MAX_REPEATS)]))
    progress = lambda k: F.least(F.lit(1.0), (F.col("offset") + k * F.col("source_size")) / F.col("target"))

    def position(k: int) -> Column:
        t = training_position(F.col("weight"), progress(k))
        return F.when(F.col("parts")[k] > 0, F.col("_slope") * t + F.col("_bend") * t * t)

    joined = joined.withColumn("positions", F.array(*[position(k) for k in range(MAX_REPEATS)]))
    taken = sum((F.col("parts")[k] for k in range(1, MAX_REPEATS)), F.col("parts")[0])
    return joined.withColumn("taken", taken).drop("_source", "_hash", "_slope", "_bend")


def training_position(weight: Column, progress: Column) -> Column:
    """The time (0 to 1) at which a share ``progress`` of the source's words has been wanted.

    The schedule of the weight is a line from ``start`` to ``end``; its integral, 2 start t + (end - start) t^2 over
    (start + end), is inverted.
    """
    out = None
    for k, (start, end) in enumerate(SCHEDULES):
        slope, total = end - start, start + end
        t = progress if slope == 0 else (F.sqrt(start * start + slope * total * progress) - start) / slope
        out = F.when(weight == k + 1, t) if out is None else out.when(weight == k + 1, t)
    return out


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, blanks between words as they are."""
    return F.array_join(F.slice(F.split(text, f"(?<={WORD[:-1]})(?={BLANK})"), F.lit(1), n.cast("int")), "")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: one row per document and reading, range-sorted by training position.

    Adds ``position`` (double, 0 to 1, as in ``plan_mix``), ``copy`` (0 to 2) and ``words`` (long: the words of this row's
    text).  The document at which a source's target ends is given up to the last word taken, so the words of all rows are
    those that ``plan_mix`` takes; all other documents are whole.  Cases as in ``plan_mix``; documents without words
    aren't taken.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("position", "copy", "words")])
    plan = plan_mix(docs, id_col, text_col, source_col)
    readings = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)).alias("copy"), F.col("parts").alias("words"), F.col("positions").alias("position")), lambda x: x["words"] > 0)
    copies = plan.withColumn("_x", F.explode(readings)).select(*[F.col(f"`{c}`") for c in docs.columns], "size", "_x.copy", "_x.words", "_x.position")
    whole = F.when(F.col("words") == F.col("size"), F.col(text_col)).otherwise(first_words(F.col(text_col), F.col("words")))
    placed = copies.withColumn(text_col, whole).drop("size")
    return placed.repartitionByRange("position", id_col, "copy").sortWithinPartitions("position", id_col, "copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the positions of its readings; range-sorted by the first of them.

    The rows are those that ``mix_sources`` emits, one per document instead of one per reading, without the texts.
    """
    plan = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    placed = {("position", "position_2", "position_3")[k]: F.round(F.col("positions")[k], 9) for k in range(MAX_REPEATS)}
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", *[c.alias(n) for n, c in placed.items()])
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = {
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM s
), l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
       / CAST(sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW r AS (ORDER BY CAST(lim AS DOUBLE) / weight, source NULLS LAST)
), a AS (
  SELECT arg_min(level, CAST(lim AS DOUBLE) / weight) AS level FROM l WHERE level * weight < lim
), t AS (
  SELECT w.source, w.source_size, w.weight, coalesce(least(CAST(lim AS DOUBLE), (SELECT level FROM a) * weight), CAST(lim AS DOUBLE)) AS target FROM w
), o AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d
), g AS (
  SELECT sum(target * CASE weight WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END) / sum(target) AS slope, sum(target * CASE weight WHEN 1 THEN -0.5 WHEN 2 THEN 0.0 ELSE 0.5 END) / sum(target) AS bend FROM t
), p AS (
  SELECT o.doc_id, o.size, t.source_size, t.target, t.weight, k,
         CAST(greatest(0, least(size, round(target) - off - k * t.source_size)) AS BIGINT) AS part, least(1.0, (off + k * t.source_size) / target) AS u
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS k)
), q AS (
  SELECT *, CASE WHEN part > 0 THEN CASE weight WHEN 1 THEN 1.5 - sqrt(2.25 - 2.0 * u) WHEN 2 THEN u ELSE sqrt(0.25 + 2.0 * u) - 0.5 END END AS time FROM p
)
SELECT doc_id, size, source_size, target, CAST(sum(part) AS BIGINT) AS taken,
       max(CASE WHEN k = 0 THEN round(slope * time + bend * time * time, 9) END) AS position,
       max(CASE WHEN k = 1 THEN round(slope * time + bend * time * time, 9) END) AS position_2,
       max(CASE WHEN k = 2 THEN round(slope * time + bend * time * time, 9) END) AS position_3
FROM q, g GROUP BY doc_id, size, source_size, target
""",
}
