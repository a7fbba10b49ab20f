"""Readers and writers of hypothesis, prediction and metrics records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L

PREDICTION = T.StructType([T.StructField(n, T.StringType()) for n in "item_id file_name audio_path hypothesis gold pred_raw pred difficulty task model asr_source error traceback".split()] + [T.StructField("retry_count", T.IntegerType()), T.StructField("ts", T.TimestampType())])
CLIP = T.StructType([T.StructField(n, T.StringType()) for n in "file_name transcript domain accent country age_group duration".split()])
NA_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "n/a", "<NA>"]


def read_jsonl(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """One row per line with ``record`` (VARIANT) and ``path``.  Blank lines go; broken ones go, or fail the job if ``strict``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    lines = lines.filter(L.strip(F.col("value")) != "")
    if strict:
        return lines.select(F.parse_json("value").alias("record"), "path")
    return lines.select(F.try_parse_json("value").alias("record"), "path").filter("record is not null")


def count_bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.groupBy("path").agg(F.count_if(L.strip(F.col("value")) != "").alias("lines"), F.count_if((L.strip(F.col("value")) != "") & F.try_parse_json("value").isNull()).alias("bad_lines"))


def read_predictions(spark: SparkSession, path: str | list[str], schema: T.StructType = PREDICTION, strict: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true")
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def with_cascade_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """Keys from ``.../{asr}/{llm}/{task_key}.jsonl``."""
    parts = F.split(path, "/")
    key = L.stem(F.col(path))
    named = df.withColumns({"asr_model": F.element_at(parts, -3), "text_llm": F.element_at(parts, -2), "task_key": key})
    return named.withColumns({"task": L.task_of_key(F.col("task_key")), "dataset": L.dataset_of_key(F.col("task_key")), "alm": F.concat_ws("_", F.lit("cascade"), "asr_model", "text_llm")})


def with_family_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """Keys from ``root/{family}/{task}/results/*.jsonl``; error files are left out."""
    parts = F.split(path, "/")
    return df.filter(~F.col(path).endswith("_errors.jsonl")).withColumns({"model_family": F.element_at(parts, -4), "task_key": F.element_at(parts, -3)})


def with_sweep_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """Keys from ``variant/model/dataset/shot{n}/predictions.jsonl``."""
    # Split once: a pattern that may begin anywhere in a long path is tried from every character, for each row and key.
    parts = F.split(path, "/")
    at = lambda n: F.try_element_at(parts, F.lit(-n))
    fits = (F.size(parts) >= 5) & (at(1) != "") & at(2).rlike(r"^shot[0-9]+\z") & (at(3) != "") & (at(4) != "") & (at(5) != "")
    part = lambda x: F.when(F.col(path).isNotNull(), F.when(fits, x).otherwise(""))
    return df.withColumns({"variant": part(at(5)), "model": part(at(4)), "dataset": part(at(3)), "shot": F.try_to_number(part(F.substr(at(2), F.lit(5))), F.lit("999999")).cast("int")})


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, na: bool = False) -> DataFrame:
    """All columns as text; with ``na``, the usual marks of a missing value become null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return df.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns]) if na else df


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Rows of all, with null where one lacks a column."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_by_task(df: DataFrame, path: str, kind: str = "parquet", keys: tuple[str, ...] = ("task",)) -> None:
    """One folder per task; rows of a task meet in few files."""
    df.repartition(*keys).write.mode("overwrite").option("header", True).partitionBy(*keys).format(kind).save(path)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first rows in a stated order (files have none in Spark)."""
    return df.orderBy(*order).limit(n)


def manifest(df: DataFrame, keys: list[str], seed: int, **settings: list) -> DataFrame:
    """Rows per generated part, with the seed and the settings (sources, variants, shots, files: a list each)."""
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records")).withColumn("seed", F.lit(seed))
    return rows.withColumns({k: F.array(*[F.lit(v) for v in values]) for k, values in settings.items()}) if settings else rows
