"""Joins that add transcripts, gold labels and difficulty to predictions, and find what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def last_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per key: the value of the largest ``order`` (ties by value).  Files have no order in Spark, so it is stated."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value))


def first_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(order, value)).alias(value))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def join_transcripts(df: DataFrame, asr: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``transcript`` of the last non-empty ASR row of the stripped file name; without one, ``error`` says so.

    An error that a row already has stays, and a prediction made without a transcript goes.
    """
    texts = asr.withColumn("_name", L.strip(F.col("file_name"))).filter(L.strip(F.col("asr_text")) != "")
    texts = last_by(texts, ["_name", *keys], "asr_text", order).withColumnRenamed("asr_text", "transcript")
    joined = df.withColumn("_name", L.strip(F.col("file_name"))).join(texts, ["_name", *keys], "left").drop("_name")
    lost = F.when(F.col("transcript").isNull(), F.lit("ASR transcript not found for file_name"))
    out = joined.withColumn("error", F.coalesce("error", lost) if "error" in df.columns else lost)
    return out.withColumn("pred", F.when(F.col("transcript").isNotNull(), F.col("pred"))) if "pred" in df.columns else out


def not_done(df: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows whose key the earlier output lacks."""
    return df.join(done.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def repair_gold(df: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """Take gold from the mapping's last row of the same stripped hypothesis; ``matched`` says whether there is one."""
    texts = mapping.select(L.strip(F.col("hypothesis")).alias("_text"), F.col("gold").alias("_gold"), order)
    texts = last_by(texts, ["_text"], "_gold", order)
    joined = df.withColumn("_text", L.strip(F.col("hypothesis"))).join(texts, "_text", "left").drop("_text")
    return joined.withColumn("matched", F.col("_gold").isNotNull()).withColumn("gold", F.coalesce("_gold", "gold")).drop("_gold")


def repair_report(repaired: DataFrame) -> DataFrame:
    return repaired.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


def unmatched_samples(repaired: DataFrame, order: str, n: int = 5, length: int = 80) -> DataFrame:
    """The first ``n`` hypotheses without a match, in a stated order, cut to ``length`` characters: a report."""
    return repaired.filter(~F.col("matched")).orderBy(order).limit(n).select(order, F.substring(L.strip(F.col("hypothesis")), 1, length).alias("sample"))


def join_difficulty(df: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """Difficulty by item id, else by file name and hypothesis, else by hypothesis alone (first row), else ``unknown``.

    A row with a difficulty keeps it.  The last two need a file name and a hypothesis.  Each side is unique, so no row multiplies.
    """
    by_id = first_by(mapping.filter("item_id is not null"), ["item_id"], "difficulty", order).withColumnRenamed("difficulty", "_d1")
    by_pair = first_by(mapping, ["file_name", "hypothesis"], "difficulty", order).withColumnRenamed("difficulty", "_d2")
    by_text = first_by(mapping, ["hypothesis"], "difficulty", order).withColumnRenamed("difficulty", "_d3")
    joined = df.join(by_id, "item_id", "left").join(by_pair, ["file_name", "hypothesis"], "left").join(by_text, "hypothesis", "left")
    full = (F.coalesce("file_name", F.lit("")) != "") & (F.coalesce("hypothesis", F.lit("")) != "")
    found = F.coalesce(F.nullif("difficulty", F.lit("")), "_d1", F.when(full, F.col("_d2")), F.when(full, F.col("_d3")), F.lit("unknown"))
    return joined.withColumn("difficulty", found).drop("_d1", "_d2", "_d3")


def match_files(df: DataFrame, files: DataFrame, name: str = "file_name", path: str = "path") -> DataFrame:
    """Add the path of the file of that base name; a name without extension takes .wav, .flac, .mp3 in this order."""
    listed = files.select(L.base_name(F.col(path)).alias("_base"), F.col(path).alias("_path"))
    exact = listed.groupBy("_base").agg(F.min("_path").alias("_p1"))
    kinds = F.array_position(F.array(F.lit("wav"), F.lit("flac"), F.lit("mp3")), F.lower(F.regexp_extract("_base", r"\.([^.]+)$", 1)))
    guessed = listed.withColumn("_rank", kinds).filter("_rank > 0").groupBy(L.stem(F.col("_base")).alias("_stem")).agg(F.min_by("_path", F.struct("_rank", "_path")).alias("_p2"))
    keyed = df.withColumn("_base", L.base_name(L.strip_prefixes(F.col(name))))
    joined = keyed.join(exact, "_base", "left").join(guessed, F.col("_base") == F.col("_stem"), "left")
    return joined.withColumn("audio_path", F.coalesce("_p1", F.when(~F.col("_base").contains("."), F.col("_p2")))).drop("_base", "_stem", "_p1", "_p2")


def file_report(df: DataFrame, files: DataFrame, name: str = "file_name") -> DataFrame:
    """``match_files`` for a listing with sizes: adds ``audio_path``, ``found`` and ``size`` (null where nothing was found)."""
    matched = match_files(df, files, name)
    sizes = files.select(F.col("path").alias("_listed"), "size")
    return matched.join(sizes, F.col("audio_path") == F.col("_listed"), "left").drop("_listed").withColumn("found", F.col("audio_path").isNotNull())


def missing_parts(expected: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(landed.select(*keys).distinct(), keys, "left_anti")


def coverage(expected: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows landed per expected part, 0 for those that have none."""
    counts = landed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return expected.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cascade_grid(asr_models: DataFrame, tasks: DataFrame, llms: DataFrame) -> DataFrame:
    """All runs of a cascade: three small tables, each of one row per model or task.  Spark checks their sizes before it broadcasts any."""
    return asr_models.crossJoin(tasks).crossJoin(llms)


def filter_required(records: DataFrame, record: str = "record") -> DataFrame:
    """From VARIANT records: gold, pred and difficulty, stripped and lower-cased, of rows that have all three keys, none blank.

    A JSON null counts as the word ``none``, so it stays and is wrong; an absent key drops the row.
    """
    def value(key: str):
        v = F.try_variant_get(F.col(record), f"$.{key}", "variant")
        return F.when(F.is_variant_null(v), F.lit("none")).otherwise(F.lower(L.strip(F.try_variant_get(F.col(record), f"$.{key}", "string"))))

    names = ["gold", "pred", "difficulty"]
    rows = records.withColumns({n: value(n) for n in names})
    test = F.lit(True)
    for n in names:
        test = test & (F.coalesce(n, F.lit("")) != "")
    return rows.filter(test)


def promote_raw(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", F.col("pred_raw")).drop("pred_raw")
