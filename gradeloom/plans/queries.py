"""Queries over the test tables, and the SQL for the same rows.

The tables stand in for predictions: ``PREDS`` derives them from ``lineitem`` with expressions that Spark and other
engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vectors as V
from ..operators import calibration as C
from ..operators import enrich as E
from ..operators import hypotheses as H
from ..operators import metrics as M
from ..operators import partitions
from ..operators import prompts as P
from ..operators import transcripts as W
from ..sources.scratch import scratch_folder
from ..streaming import confusion as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GOLD = "CASE l_returnflag WHEN 'A' THEN 'ENTAILMENT' WHEN 'N' THEN 'NEUTRAL' ELSE 'CONTRADICTION' END"
NEXT = "CASE l_returnflag WHEN 'A' THEN 'NEUTRAL' WHEN 'N' THEN 'CONTRADICTION' ELSE 'ENTAILMENT' END"
KIND = "(l_orderkey + l_linenumber) % 10"
PREDS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus AS dataset,
       concat('m', CAST(l_suppkey % 4 AS STRING)) AS model, {GOLD} AS gold,
       CASE l_linenumber % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 7 ELSE 10 END AS shot,
       CASE l_partkey % 3 WHEN 0 THEN 'audio_only' WHEN 1 THEN 'audio_hypothesis' ELSE 'audio_transcript' END AS variant,
       CASE WHEN {KIND} <= 3 THEN {GOLD} WHEN {KIND} = 4 THEN concat(lower({GOLD}), '.') WHEN {KIND} = 5 THEN concat('Answer: ', {GOLD}, ' because it is said so')
            WHEN {KIND} = 6 THEN {NEXT} WHEN {KIND} = 7 THEN 'NEUTRAL, not ENTAILMENT' WHEN {KIND} = 8 THEN 'I cannot tell' END AS pred_raw
FROM {{lineitem}}
"""
BOUNDARY = "CASE WHEN upper(coalesce(pred_raw, '')) LIKE '%CONTRADICTION%' THEN 'CONTRADICTION' WHEN upper(coalesce(pred_raw, '')) LIKE '%ENTAILMENT%' THEN 'ENTAILMENT' WHEN upper(coalesce(pred_raw, '')) LIKE '%NEUTRAL%' THEN 'NEUTRAL' ELSE 'UNPARSEABLE' END"
NLI = L.LABELS["nli"]
FIGURES = ["ACC", "P_macro", "R_macro", "F1_macro"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDS, lineitem=table(spark, sf_dir, "lineitem"))


def parsed(spark: SparkSession, sf_dir: str, strategy: str = "boundary") -> DataFrame:
    return preds(spark, sf_dir).withColumn("pred", L.parse_label(F.col("pred_raw"), "nli", strategy))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def query(sql: str | None = None):
    """Register the function under its name, with the SQL for its rows; {preds} in it stands for the predictions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace("{preds}", f"({PREDS.replace('{lineitem}', 'lineitem')})")
        return f

    return add


def metrics_sql(rows: str, keys: list[str], labels: list[str] | None, classes: bool = True) -> str:
    """Macro metrics over (keys, gold, pred) rows, by fixed labels or by those that occur."""
    ks = ", ".join(keys)
    spec = f"SELECT DISTINCT {ks}, unnest([{', '.join(repr(x) for x in labels)}]) AS label FROM c" if labels else f"SELECT {ks}, gold AS label FROM c UNION SELECT {ks}, pred FROM c"
    same = " AND ".join(f"c.{k} = s.{k}" for k in keys)
    named = {"ENTAILMENT": "EACC", "NEUTRAL": "NACC", "CONTRADICTION": "CACC"}
    accs = "".join(f", round(max(CASE WHEN label = '{x}' AND sup > 0 THEN tp / sup END), 6) AS {named[x.upper()]}" for x in labels) if labels and classes else ""
    return f"""
WITH r AS ({rows}), c AS (SELECT {ks}, gold, pred, count(*) AS n FROM r GROUP BY ALL), s AS ({spec}),
k AS (SELECT s.*, sum(CASE WHEN gold = label AND pred = label THEN n ELSE 0 END) AS tp, sum(CASE WHEN gold = label THEN n ELSE 0 END) AS sup, sum(CASE WHEN pred = label THEN n ELSE 0 END) AS prd
      FROM s JOIN c ON {same} GROUP BY ALL),
t AS (SELECT {ks}, CAST(sum(n) AS BIGINT) AS "N", round(sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n), 6) AS "ACC" FROM c GROUP BY ALL),
m AS (SELECT {ks}, round(avg(CASE WHEN prd > 0 THEN tp / prd ELSE 0 END), 6) AS "P_macro", round(avg(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END), 6) AS "R_macro",
      round(avg(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END), 6) AS "F1_macro"{accs} FROM k GROUP BY ALL)
SELECT * FROM t JOIN m USING ({ks})"""


@query(metrics_sql(f"SELECT *, {BOUNDARY} AS pred FROM {{preds}}", ["dataset", "model"], NLI))
def metrics_by_group(spark, sf_dir):
    return rounded(M.metrics(parsed(spark, sf_dir), ["dataset", "model"], NLI), *FIGURES, "EACC", "NACC", "CACC")


@query(metrics_sql("SELECT *, upper(trim(coalesce(pred_raw, ''))) AS pred FROM {preds}", ["dataset", "model"], None))
def metrics_observed_labels(spark, sf_dir):
    return rounded(M.metrics(parsed(spark, sf_dir, "raw"), ["dataset", "model"]), *FIGURES)


@query(metrics_sql("SELECT *, upper(pred_raw) AS pred FROM {preds} WHERE pred_raw IS NOT NULL", ["dataset", "model", "difficulty"], NLI))
def metrics_by_difficulty(spark, sf_dir):
    df = preds(spark, sf_dir).withColumn("pred", F.upper("pred_raw"))
    return rounded(M.metrics(df, ["dataset", "model", "difficulty"], NLI), *FIGURES, "EACC", "NACC", "CACC")


@query(metrics_sql("SELECT *, coalesce(pred_raw, 'FAILED') AS pred FROM {preds}", ["model"], NLI))
def metrics_null_as_failed(spark, sf_dir):
    df = preds(spark, sf_dir).withColumn("pred", F.col("pred_raw"))
    return rounded(M.metrics(df, ["model"], NLI, policy="failed"), *FIGURES, "EACC", "NACC", "CACC")


@query(
    metrics_sql(f"SELECT model, difficulty, lower(gold) AS gold, lower({BOUNDARY}) AS pred FROM {{preds}}", ["model", "difficulty"], None).replace("SELECT * FROM t JOIN m", "SELECT t.*, m.P_macro, m.R_macro, m.F1_macro, a.e AS \"EACC\", a.c AS \"CACC\", a.n AS \"NACC\", 0.0::DOUBLE AS \"ACC_UNPARSEABLE\" FROM t JOIN m")
    + " JOIN (SELECT model, difficulty, round(max(CASE WHEN label = 'entailment' THEN tp / sup END), 6) AS e, round(max(CASE WHEN label = 'contradiction' THEN tp / sup END), 6) AS c, round(max(CASE WHEN label = 'neutral' THEN tp / sup END), 6) AS n FROM k GROUP BY ALL) a USING (model, difficulty)"
)
def metrics_comprehensive(spark, sf_dir):
    return rounded(M.comprehensive(parsed(spark, sf_dir)), *FIGURES, "EACC", "CACC", "NACC", "ACC_UNPARSEABLE")


POOLED = f"(SELECT variant, shot, dataset, lower(gold) AS gold, lower(CASE WHEN upper(coalesce(pred_raw, '')) LIKE '%ENTAILMENT%' THEN 'ENTAILMENT' ELSE {BOUNDARY} END) AS pred FROM {{preds}})"


def _pooled_level(keys: list[str]) -> str:
    nulls = "".join(f", CAST(NULL AS {t}) AS {k}" for k, t in (("dataset", "VARCHAR"), ("shot", "INTEGER")) if k not in keys)
    shares = f"""SELECT {', '.join(keys)}, round(avg(CAST(pred = 'unparseable' AS INTEGER)), 6) AS unparseable_rate, round(avg(CASE WHEN pred <> 'unparseable' THEN CAST(gold = pred AS INTEGER) END), 6) AS "parseable_ACC" FROM {POOLED} GROUP BY ALL"""
    return f"SELECT '{'/'.join(keys)}' AS level{nulls}, * FROM ({metrics_sql(f'SELECT * FROM {POOLED}', keys, [x.lower() for x in NLI])}) JOIN ({shares}) USING ({', '.join(keys)})"


@query(" UNION ALL BY NAME ".join(_pooled_level(x) for x in (["variant", "shot", "dataset"], ["variant", "shot"], ["variant"])))
def metrics_pooled(spark, sf_dir):
    df = parsed(spark, sf_dir, "ordered").withColumn("gold", F.lower("gold"))
    out = M.pooled(df, [["variant", "shot", "dataset"], ["variant", "shot"], ["variant"]], [x.lower() for x in NLI])
    return rounded(out, *FIGURES, "EACC", "NACC", "CACC", "unparseable_rate", "parseable_ACC")


TASKED = "SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'nli' ELSE 'open' END AS task, " + BOUNDARY + " AS pred FROM {preds}"


TASK_ACCS = f"SELECT task, model, string_agg(concat(gold, '=', printf('%.4f', a)), ',' ORDER BY gold) AS class_acc FROM (SELECT task, model, gold, avg(CAST(gold = pred AS INTEGER)) AS a FROM ({TASKED}) GROUP BY ALL) GROUP BY ALL"


@query(
    "SELECT * FROM (" + metrics_sql(f"SELECT * FROM ({TASKED}) WHERE task = 'nli'", ["task", "model"], NLI, classes=False) + " UNION ALL BY NAME SELECT * FROM (" + metrics_sql(f"SELECT * FROM ({TASKED}) WHERE task = 'open'", ["task", "model"], None) + f")) JOIN ({TASK_ACCS}) USING (task, model)"
)
def metrics_by_task(spark, sf_dir):
    df = parsed(spark, sf_dir).withColumn("task", F.when(F.col("l_partkey") % 2 == 0, "nli").otherwise("open"))
    accs = F.array_join(F.transform(F.array_sort(F.map_entries("class_acc")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    return rounded(M.metrics_by_task(df, ["task", "model"]).withColumn("class_acc", accs), *FIGURES)


@query(f"SELECT dataset, model, gold, pred, count(*) AS n FROM (SELECT *, {BOUNDARY} AS pred FROM {{preds}}) GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return M.confusion(parsed(spark, sf_dir), ["dataset", "model"])


STRATEGIES = ["boundary", "ordered", "substring", "prefix_fallback", "keyword_rules", "raw"]
SUBSTRING = "CASE WHEN lower(p) LIKE '%entail%' THEN 'ENTAILMENT' WHEN lower(p) LIKE '%contradict%' THEN 'CONTRADICTION' WHEN lower(p) LIKE '%neutral%' OR lower(p) LIKE '%neither%' THEN 'NEUTRAL'"


@query(
    f"""WITH r AS (SELECT *, coalesce(pred_raw, '') AS p FROM {{preds}}), s AS (
SELECT 'boundary' AS strategy, {BOUNDARY} AS label FROM r UNION ALL
SELECT 'ordered', lower(CASE WHEN upper(p) LIKE '%ENTAILMENT%' THEN 'ENTAILMENT' ELSE {BOUNDARY} END) FROM r UNION ALL
SELECT 'substring', {SUBSTRING} ELSE 'UNPARSEABLE' END FROM r UNION ALL
SELECT 'prefix_fallback', CASE WHEN p = '' THEN 'UNPARSEABLE' ELSE {SUBSTRING} WHEN length(split_part(upper(p), ' ', 1)) > 2 THEN split_part(upper(p), ' ', 1) ELSE 'UNPARSEABLE' END END FROM r UNION ALL
SELECT 'keyword_rules', CASE WHEN p = '' THEN 'UNPARSEABLE' WHEN lower(p) LIKE '%not entail%' THEN 'NEUTRAL' ELSE {SUBSTRING} ELSE 'UNPARSEABLE' END END FROM r UNION ALL
SELECT 'raw', upper(p) FROM r)
SELECT strategy, label, count(*) AS n FROM s GROUP BY ALL"""
)
def label_parsers(spark, sf_dir):
    """All parsers side by side in one pass over the predictions."""
    df = preds(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), L.parse_label(F.col("pred_raw"), "nli", s).alias("label")) for s in STRATEGIES])
    return df.select(F.explode(each).alias("x")).groupBy("x.strategy", "x.label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT model, pred, count(*) AS n, count(*) FILTER (WHERE old IS DISTINCT FROM pred) AS changed FROM (SELECT *, upper(coalesce(pred_raw, '')) AS old, {BOUNDARY} AS pred FROM {{preds}}) GROUP BY ALL")
def relabel_audit(spark, sf_dir):
    return L.relabel_audit(parsed(spark, sf_dir).withColumn("old", F.upper(F.coalesce("pred_raw", F.lit("")))), "old", "pred", ["model"])


@query(f"SELECT *, round(n / sum(n) OVER (PARTITION BY model), 6) AS share FROM (SELECT model, pred, count(*) AS n FROM (SELECT *, {BOUNDARY} AS pred FROM {{preds}}) GROUP BY ALL)")
def prediction_shares(spark, sf_dir):
    return rounded(M.prediction_shares(parsed(spark, sf_dir), ["model"]), "share")


@query(f"SELECT model, round((count(*) FILTER (WHERE gold = 'ENTAILMENT' AND pred = 'ENTAILMENT') / count(*) FILTER (WHERE gold = 'ENTAILMENT') + count(*) FILTER (WHERE gold <> 'ENTAILMENT' AND pred <> 'ENTAILMENT') / count(*) FILTER (WHERE gold <> 'ENTAILMENT')) / 2, 6) AS balanced_accuracy FROM (SELECT *, {BOUNDARY} AS pred FROM {{preds}}) GROUP BY ALL")
def balanced_accuracy(spark, sf_dir):
    return rounded(M.balanced_accuracy(parsed(spark, sf_dir), ["model"], "ENTAILMENT"), "balanced_accuracy")


BINARY = "SELECT model, l_partkey, dataset, CASE WHEN l_returnflag_pos THEN {a} ELSE {b} END AS gold, CASE WHEN said THEN {a} ELSE {b} END AS pred FROM (SELECT *, gold = 'ENTAILMENT' AS l_returnflag_pos, l_quantity > 20 AS said FROM {preds})"


def _binary(spark, sf_dir, a: str, b: str) -> DataFrame:
    side = lambda c: F.when(c, F.lit(a)).otherwise(F.lit(b))
    return preds(spark, sf_dir).withColumns({"pred": side(F.col("l_quantity") > 20), "gold": side(F.col("gold") == "ENTAILMENT")})


def _binary_sql(a: str, b: str) -> str:
    return BINARY.replace("{a}", repr(a)).replace("{b}", repr(b))


@query("SELECT model, round(count(*) FILTER (WHERE gold = 'UNSUPPORTED' AND pred = 'SUPPORTED') / count(*) FILTER (WHERE gold = 'UNSUPPORTED'), 6) AS hallucination, round(count(*) FILTER (WHERE gold = 'SUPPORTED' AND pred = 'SUPPORTED') / count(*) FILTER (WHERE gold = 'SUPPORTED'), 6) AS support, round(count(*) FILTER (WHERE gold = 'UNSUPPORTED' AND pred = 'SUPPORTED') / count(*), 6) AS \"SRA\" FROM (" + _binary_sql("SUPPORTED", "UNSUPPORTED") + ") GROUP BY ALL")
def restraint_rates(spark, sf_dir):
    return rounded(M.restraint_rates(_binary(spark, sf_dir, "SUPPORTED", "UNSUPPORTED"), ["model"]), "hallucination", "support", "SRA")


@query("SELECT model, round(count(*) FILTER (WHERE gold = 'FALSE' AND pred = 'TRUE') / count(*) FILTER (WHERE gold = 'FALSE'), 6) AS bias, round(count(*) FILTER (WHERE gold = 'TRUE' AND pred = 'TRUE') / count(*) FILTER (WHERE gold = 'TRUE'), 6) AS accept FROM (" + _binary_sql("TRUE", "FALSE") + ") GROUP BY ALL")
def accent_rates(spark, sf_dir):
    return rounded(M.accent_rates(_binary(spark, sf_dir, "TRUE", "FALSE"), ["model"]), "bias", "accept")


@query(f"SELECT model, round(count(*) FILTER (WHERE gold = 'NEUTRAL' AND pred = 'ENTAILMENT') / count(*) FILTER (WHERE gold = 'NEUTRAL'), 6) AS over_inference, round(avg(CASE WHEN difficulty = 'easy' THEN CAST(gold = pred AS INTEGER) END) - avg(CASE WHEN difficulty = 'hard' THEN CAST(gold = pred AS INTEGER) END), 6) AS easy_to_hard_drop FROM (SELECT *, {BOUNDARY} AS pred FROM {{preds}}) GROUP BY ALL")
def over_inference(spark, sf_dir):
    return rounded(M.over_inference(parsed(spark, sf_dir), ["model"]), "over_inference", "easy_to_hard_drop")


@query(f"SELECT model, round(avg(m), 6) AS mean_correct, round(avg(v), 6) AS mean_variance, round(avg(CAST(v = 0 AS INTEGER)), 6) AS agreeing FROM (SELECT model, l_partkey, gold, avg(x) AS m, var_pop(x) AS v FROM (SELECT *, CAST(gold = {BOUNDARY} AS DOUBLE) AS x FROM {{preds}}) GROUP BY ALL) GROUP BY ALL")
def variant_consistency(spark, sf_dir):
    return rounded(M.variant_consistency(parsed(spark, sf_dir), "model", "l_partkey"), "mean_correct", "mean_variance", "agreeing")


@query(f"SELECT model, round(max(e) - min(e), 6) AS error_asymmetry FROM (SELECT model, dataset, avg(CAST(gold <> {BOUNDARY} AS INTEGER)) AS e FROM {{preds}} GROUP BY ALL) GROUP BY ALL")
def error_asymmetry(spark, sf_dir):
    return rounded(M.error_asymmetry(parsed(spark, sf_dir), "model", "dataset"), "error_asymmetry")


SEVEN = [*FIGURES, "EACC", "CACC", "NACC"]


@query("SELECT *, CAST(row_number() OVER (ORDER BY \"ACC\" DESC, model) AS INTEGER) AS rank FROM (SELECT model, " + ", ".join(f'round(avg("{c}"), 3) AS "{c}"' for c in SEVEN) + f" FROM ({metrics_sql(f'SELECT *, {BOUNDARY} AS pred FROM {{preds}}', ['model', 'difficulty'], NLI)}) GROUP BY ALL)")
def model_ranking(spark, sf_dir):
    """All seven figures, averaged over the difficulties of each model."""
    return M.summary(M.metrics(parsed(spark, sf_dir), ["model", "difficulty"], NLI), "model", SEVEN)


@query(f"SELECT model, round(avg(a), 6) AS \"ACC\" FROM (SELECT concat('s', CAST(l_suppkey % 16 AS STRING)) AS model, difficulty, avg(CAST(gold = {BOUNDARY} AS INTEGER)) AS a FROM {{preds}} GROUP BY ALL) GROUP BY ALL ORDER BY \"ACC\" DESC, model LIMIT 5")
def top_models(spark, sf_dir):
    df = parsed(spark, sf_dir).withColumn("model", F.concat(F.lit("s"), F.col("l_suppkey") % 16))
    return rounded(M.top_models(M.metrics(df, ["model", "difficulty"], NLI, per_class=False), "model", "ACC"), "ACC")


@query("SELECT model, count(*) AS total, count(pred_raw) AS ok, count(*) - count(pred_raw) AS errors FROM {preds} GROUP BY ALL")
def run_accounting(spark, sf_dir):
    return M.accounting(preds(spark, sf_dir).withColumn("error", F.when(F.col("pred_raw").isNull(), "no answer")), ["model"])


@query("SELECT l_orderkey, l_linenumber, max_by(l_extendedprice, row(l_partkey, l_extendedprice)) AS l_extendedprice FROM lineitem GROUP BY ALL")
def last_row_wins(spark, sf_dir):
    return E.last_by(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice", "l_partkey")


@query("""WITH m AS (SELECT trim(text) AS t, max_by(quality, row(doc_id, quality)) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(q, toxic) = 1 THEN 'YES' WHEN coalesce(q, toxic) = 0 THEN 'NO' END AS gold, q IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN m ON trim(d.text) = m.t""")
def gold_repair(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    word = lambda c: F.when(F.col(c) == 1, "YES").when(F.col(c) == 0, "NO")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.col("text").alias("hypothesis"), word("toxic").alias("gold"))
    mapping = docs.join(labels, "doc_id").select(F.col("text").alias("hypothesis"), word("quality").alias("gold"), "doc_id")
    return E.repair_gold(rows, mapping, "doc_id").select("doc_id", "gold", "matched")


@query("""WITH d AS (SELECT doc_id, concat('i', CAST(doc_id AS STRING)) AS item_id, concat(source, '.wav') AS file_name, text AS hypothesis, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS diff FROM documents),
m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN item_id END AS item_id, file_name, hypothesis, diff FROM d WHERE doc_id % 4 <> 3),
a AS (SELECT item_id, min_by(diff, row(doc_id, diff)) AS v FROM m WHERE item_id IS NOT NULL GROUP BY 1), b AS (SELECT file_name, hypothesis, min_by(diff, row(doc_id, diff)) AS v FROM m GROUP BY 1, 2), c AS (SELECT hypothesis, min_by(diff, row(doc_id, diff)) AS v FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(a.v, CASE WHEN d.hypothesis <> '' THEN coalesce(b.v, c.v) END, 'unknown') AS difficulty FROM d LEFT JOIN a USING (item_id) LEFT JOIN b ON d.file_name = b.file_name AND d.hypothesis = b.hypothesis LEFT JOIN c ON d.hypothesis = c.hypothesis""")
def difficulty_tiers(spark, sf_dir):
    level = F.when(F.col("doc_id") % 3 == 0, "easy").when(F.col("doc_id") % 3 == 1, "medium").otherwise("hard")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("i"), "doc_id").alias("item_id"), F.concat("source", F.lit(".wav")).alias("file_name"), F.col("text").alias("hypothesis"), level.alias("difficulty"))
    mapping = docs.filter("doc_id % 4 <> 3").withColumn("item_id", F.when(F.col("doc_id") % 2 == 0, F.col("item_id")))
    return E.join_difficulty(docs.withColumn("difficulty", F.lit(None).cast("string")), mapping, "doc_id").select("doc_id", "difficulty")


@query("""WITH a AS (SELECT CAST(o_custkey AS STRING) AS name, max_by(o_orderpriority, row(o_orderkey, o_orderpriority)) AS transcript FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey, transcript, CASE WHEN transcript IS NULL THEN 'ASR transcript not found for file_name' END AS error FROM customer LEFT JOIN a ON CAST(c_custkey AS STRING) = a.name""")
def transcript_join(spark, sf_dir):
    clips = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("file_name"))
    asr = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file_name"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("asr_text"), "o_orderkey")
    return E.join_transcripts(clips, asr, "o_orderkey").select("c_custkey", "transcript", "error")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def resume_not_done(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return E.not_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("WITH x AS (SELECT DISTINCT variant, shot, dataset FROM {preds}), l AS (SELECT variant, shot, dataset, count(*) AS n FROM {preds} WHERE l_quantity > 49 AND l_tax > 0.07 AND l_discount > 0.08 GROUP BY ALL) SELECT x.*, coalesce(n, 0) AS n FROM x LEFT JOIN l USING (variant, shot, dataset)")
def sweep_coverage(spark, sf_dir):
    df = preds(spark, sf_dir)
    keys = ["variant", "shot", "dataset"]
    return E.coverage(df.select(*keys).distinct(), df.filter("l_quantity > 49 and l_tax > 0.07 and l_discount > 0.08"), keys)


@query("SELECT r_name AS asr_model, n_name AS text_llm, p_type AS task_key, concat('cascade_', r_name, '_', n_name) AS alm FROM region, nation, (SELECT DISTINCT p_type FROM part)")
def cascade_grid(spark, sf_dir):
    asr = table(spark, sf_dir, "region").select(F.col("r_name").alias("asr_model"))
    llm = table(spark, sf_dir, "nation").select(F.col("n_name").alias("text_llm"))
    tasks = table(spark, sf_dir, "part").select(F.col("p_type").alias("task_key")).distinct()
    return E.cascade_grid(asr, tasks, llm).select("asr_model", "text_llm", "task_key", F.concat_ws("_", F.lit("cascade"), "asr_model", "text_llm").alias("alm"))


def _records(spark, sf_dir) -> DataFrame:
    """Hypothesis records as JSON text: lists, single strings, objects, blanks and nulls."""
    json = "concat('{\"entailment\": [\"', event_type, ' a', '\", \" \"], \"neutral\": ', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('\"', event_type, ' b\"') END, ', \"contradiction\": [{\"hypothesis\": \"c ', CAST(user_id AS STRING), '\", \"difficulty\": \"hard\"}]}')"
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("clips/e"), "event_id", F.lit(".wav")).alias("file_name"), F.try_parse_json(F.expr(json)).alias("output"))


@query("""WITH e AS (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [{'h': concat(event_type, ' a'), 'g': 'ENTAILMENT', 'd': NULL}, {'h': concat('c ', CAST(user_id AS STRING)), 'g': 'CONTRADICTION', 'd': 'hard'}]
ELSE [{'h': concat(event_type, ' a'), 'g': 'ENTAILMENT', 'd': NULL}, {'h': concat(event_type, ' b'), 'g': 'NEUTRAL', 'd': NULL}, {'h': concat('c ', CAST(user_id AS STRING)), 'g': 'CONTRADICTION', 'd': 'hard'}] END) AS x, generate_subscripts(CASE WHEN event_id % 3 = 0 THEN [1, 2] ELSE [1, 2, 3] END, 1) - 1 AS pos FROM events)
SELECT concat('e', CAST(event_id AS STRING), '__hyp_', CAST(pos AS STRING)) AS item_id, x.h AS hypothesis, x.g AS gold, x.d AS difficulty FROM e""")
def explode_hypotheses(spark, sf_dir):
    return H.explode_hypotheses(_records(spark, sf_dir), "nli").select("item_id", "hypothesis", "gold", "difficulty")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("p"), "event_type").filter("p is not null")
    return rows.select("event_id", F.try_variant_get("p", "$.k", "long").alias("k"), "event_type").filter("k >= 50")


@query("WITH h AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, upper(role) AS gold FROM conversations) SELECT difficulty, gold, count(*) AS n, count(DISTINCT conv_id) AS clips FROM h GROUP BY GROUPING SETS ((), (difficulty), (gold))")
def subset_composition(spark, sf_dir):
    level = F.when(F.col("turn") % 3 == 0, "easy").when(F.col("turn") % 3 == 1, "medium").otherwise("hard")
    return H.composition(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_name"), level.alias("difficulty"), F.upper("role").alias("gold")))


SCORED = "SELECT o_orderpriority AS run, round(o_totalprice / 1000, 0) AS score, o_orderstatus = 'O' AS is_pos FROM orders WHERE o_orderstatus <> 'P'"


def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("run"), F.round(F.col("o_totalprice") / 1000, 0).alias("score"), (F.col("o_orderstatus") == "O").alias("is_pos"))


@query(f"WITH r AS ({SCORED}), c AS (SELECT run, score, count(*) FILTER (WHERE is_pos) AS p, count(*) FILTER (WHERE NOT is_pos) AS n FROM r GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT run, round(CAST(sum(p * (2 * b + n)) AS DOUBLE) / (2 * sum(p) * sum(n)), 6) AS auroc FROM b GROUP BY run")
def auroc(spark, sf_dir):
    return rounded(C.auroc(C.score_counts(_scored(spark, sf_dir), ["run"]), ["run"]), "auroc")


def candidates_sql(rows: str, tail: str = "") -> str:
    """Thresholds of rows (run, score, is_pos) with the counts at or above them, as k; ``tail`` names the tables apart."""
    return f"""r{tail} AS ({rows}), c{tail} AS (SELECT run, score, count(*) FILTER (WHERE is_pos) AS p, count(*) FILTER (WHERE NOT is_pos) AS n FROM r{tail} GROUP BY ALL),
t{tail} AS (SELECT run, CASE WHEN lag(score) OVER w IS NULL THEN score - 1e-6 ELSE (lag(score) OVER w + score) / 2 END AS t FROM c{tail} WINDOW w AS (PARTITION BY run ORDER BY score) UNION ALL SELECT run, max(score) + 1e-6 FROM c{tail} GROUP BY run),
k{tail} AS (SELECT t{tail}.run, t{tail}.t, sum(CASE WHEN score >= t THEN p ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN n ELSE 0 END) AS fp, sum(p) AS "P", sum(n) AS "N" FROM t{tail} JOIN c{tail} USING (run) GROUP BY ALL)"""


CANDIDATES = "WITH " + candidates_sql(SCORED)
BEST = """f AS (SELECT run, t, (CASE WHEN 2 * tp + fp + "P" - tp > 0 THEN 2 * tp / (2 * tp + fp + "P" - tp) ELSE 0 END + CASE WHEN 2 * ("N" - fp) + fp + "P" - tp > 0 THEN 2 * ("N" - fp) / (2 * ("N" - fp) + fp + "P" - tp) ELSE 0 END) / 2 AS f1, (tp + "N" - fp) / ("P" + "N") AS acc, (tp / "P" + ("N" - fp) / "N") / 2 AS bal FROM k)"""


@query(CANDIDATES + ", " + BEST + """
SELECT run, round(arg_max(f1, row(f1, -t)), 6) AS macro_f1, round(arg_max(acc, row(f1, -t)), 6) AS accuracy, round(arg_max(bal, row(f1, -t)), 6) AS balanced_accuracy, round(arg_max(t, row(f1, -t)), 6) AS threshold FROM f GROUP BY run""")
def best_threshold(spark, sf_dir):
    return rounded(C.best_threshold(C.score_counts(_scored(spark, sf_dir), ["run"]), ["run"]), "macro_f1", "accuracy", "balanced_accuracy", "threshold")


@query(CANDIDATES + """, f AS (SELECT run, t, (tp + fp) / ("P" + "N") AS cov, tp / (tp + fp) AS acc FROM k WHERE tp + fp > 0 AND (tp + fp) / ("P" + "N") >= 0.8)
SELECT run, round(arg_max(cov, row(acc, -t)), 6) AS coverage, round(arg_max(acc, row(acc, -t)), 6) AS kept_accuracy, round(arg_max(t, row(acc, -t)), 6) AS threshold FROM f GROUP BY run""")
def selective_prediction(spark, sf_dir):
    df = _scored(spark, sf_dir).withColumnsRenamed({"score": "margin", "is_pos": "correct"})
    return rounded(C.selective(df, ["run"]), "coverage", "kept_accuracy", "threshold")


@query(f"WITH r AS ({SCORED}) SELECT run, round((avg(score) FILTER (WHERE is_pos) - avg(score) FILTER (WHERE NOT is_pos)) / sqrt((var_pop(score) FILTER (WHERE is_pos) + var_pop(score) FILTER (WHERE NOT is_pos)) / 2), 6) AS d_prime, round(avg(score) FILTER (WHERE is_pos), 6) AS mean_pos, round(avg(score) FILTER (WHERE NOT is_pos), 6) AS mean_neg FROM r GROUP BY run")
def separability(spark, sf_dir):
    return rounded(C.d_prime(_scored(spark, sf_dir), ["run"]), "d_prime", "mean_pos", "mean_neg")


@query(f"WITH r AS ({SCORED}), c AS (SELECT score, count(*) AS n FROM r GROUP BY ALL) SELECT score, n, CAST(coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM c")
def running_totals(spark, sf_dir):
    counts = _scored(spark, sf_dir).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return partitions.prefix_by_partition(counts, "score", ["n"], buckets=16)


def _maps(spark, sf_dir) -> DataFrame:
    df = preds(spark, sf_dir).filter("gold <> 'NEUTRAL'")
    scores = F.create_map(F.lit("ENTAILMENT"), F.round(F.col("l_quantity") / 50, 2), F.lit("CONTRADICTION"), F.round(F.col("l_discount") * 10, 2))
    return df.select("model", "gold", F.when(F.col("l_linenumber") == 7, F.create_map().cast("map<string,double>")).otherwise(scores).alias("scores"))


MAPPED = "SELECT model AS run, gold, round(l_quantity / 50, 2) AS e, round(l_discount * 10, 2) AS c, gold = 'ENTAILMENT' AS is_pos, CASE WHEN round(l_quantity / 50, 2) > round(l_discount * 10, 2) THEN 'ENTAILMENT' WHEN round(l_quantity / 50, 2) < round(l_discount * 10, 2) THEN 'CONTRADICTION' ELSE 'CONTRADICTION' END AS pred FROM {preds} WHERE gold <> 'NEUTRAL' AND l_linenumber <> 7"
AUDIT = (
    "WITH m AS (" + MAPPED + "), " + candidates_sql("SELECT run, e AS score, is_pos FROM m") + ", " + BEST + ", "
    + candidates_sql("SELECT run, abs(e - c) AS score, gold = pred AS is_pos FROM m", "2")
    + """, g AS (SELECT run, t, (tp + fp) / ("P" + "N") AS cov, tp / (tp + fp) AS acc FROM k2 WHERE tp + fp > 0 AND (tp + fp) / ("P" + "N") >= 0.8),
au AS (SELECT run, round(CAST(sum(p * (2 * b + n)) AS DOUBLE) / (2 * sum(p) * sum(n)), 6) AS auroc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) GROUP BY run),
z AS (SELECT run, count(*) AS n, avg(CAST(gold = pred AS INTEGER)) AS a, count(*) FILTER (WHERE is_pos AND gold = pred) AS tp, count(*) FILTER (WHERE is_pos) AS p, count(*) FILTER (WHERE NOT is_pos AND gold = pred) AS tn, count(*) FILTER (WHERE NOT is_pos) AS q,
  avg(abs(e - c)) AS mm, avg(CASE WHEN gold = pred THEN abs(e - c) END) AS mc, avg(CASE WHEN gold <> pred THEN abs(e - c) END) AS mw, avg(CASE WHEN is_pos THEN e END) AS ep, avg(CASE WHEN NOT is_pos THEN e END) AS en, var_pop(CASE WHEN is_pos THEN e END) AS vp, var_pop(CASE WHEN NOT is_pos THEN e END) AS vn FROM m GROUP BY run),
w AS (SELECT model AS run, count(*) AS whole FROM {preds} WHERE gold <> 'NEUTRAL' GROUP BY 1),
b AS (SELECT run, round(arg_max(f1, row(f1, -t)), 6) AS threshold_best_macro_f1, round(arg_max(acc, row(f1, -t)), 6) AS threshold_best_accuracy, round(arg_max(bal, row(f1, -t)), 6) AS threshold_best_balanced_accuracy, round(arg_max(t, row(f1, -t)), 6) AS threshold_best_threshold FROM f GROUP BY run),
s AS (SELECT run, round(arg_max(cov, row(acc, -t)), 6) AS margin_selective_coverage, round(arg_max(acc, row(acc, -t)), 6) AS margin_selective_kept_accuracy, round(arg_max(t, row(acc, -t)), 6) AS margin_selective_threshold FROM g GROUP BY run),
audited AS (SELECT run AS model, n, whole - n AS n_skipped, round(a, 6) AS baseline_accuracy, round((2 * tp / (2 * tp + (p - tp) + (q - tn)) + 2 * tn / (2 * tn + (p - tp) + (q - tn))) / 2, 6) AS baseline_macro_f1, round((tp / p + tn / q) / 2, 6) AS baseline_balanced_accuracy, 'binary' AS type,
  round(mm, 6) AS mean_margin, round(mc, 6) AS mean_margin_correct, round(mw, 6) AS mean_margin_wrong, auroc, round((ep - en) / sqrt((vp + vn) / 2), 6) AS d_prime, round(ep, 6) AS mean_pos, round(en, 6) AS mean_neg,
  threshold_best_macro_f1, threshold_best_accuracy, threshold_best_balanced_accuracy, threshold_best_threshold, margin_selective_coverage, margin_selective_kept_accuracy, margin_selective_threshold
  FROM z JOIN w USING (run) JOIN au USING (run) JOIN b USING (run) JOIN s USING (run))"""
)


@query(AUDIT + " SELECT * FROM audited")
def calibration_audit(spark, sf_dir):
    """Every figure of the audit."""
    out = C.audit(_maps(spark, sf_dir), ["model"])
    return rounded(out, *[c for c in out.columns if c not in ("model", "n", "n_skipped", "type")])


@query(AUDIT + " SELECT type, round(avg(threshold_best_accuracy - baseline_accuracy), 4) + 0.0 AS accuracy_gain, round(avg(threshold_best_macro_f1 - baseline_macro_f1), 4) + 0.0 AS macro_f1_gain FROM audited GROUP BY type")
def calibration_gain(spark, sf_dir):
    return C.calibration_gain(C.audit(_maps(spark, sf_dir), ["model"]), ["type"]).withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("accuracy_gain", "macro_f1_gain")})


@query("""WITH t AS (SELECT concat('L', CAST(label AS STRING)) AS label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1),
s AS (SELECT e.vec_id, t.label, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(t.v AS DOUBLE[])) / ((sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) + 1e-12) * (sqrt(list_dot_product(CAST(t.v AS DOUBLE[]), CAST(t.v AS DOUBLE[]))) + 1e-12)) AS c FROM embeddings e, t),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS r FROM s)
SELECT vec_id, max(CASE WHEN r = 1 THEN label END) AS pred, round(max(CASE WHEN r = 1 THEN c END), 6) AS top1, round(max(CASE WHEN r = 1 THEN c END) - max(CASE WHEN r = 2 THEN c END), 6) AS margin FROM k GROUP BY vec_id""")
def cosine_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    texts = e.groupBy(F.concat(F.lit("L"), "label").alias("label")).agg(F.min_by("embedding", "vec_id").alias("v"))
    return rounded(V.score_labels(e.select("vec_id", "embedding"), texts, "vec_id", "embedding", "label", "v").drop("scores"), "top1", "margin")


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, concat(string_agg(concat(upper(role), ': ', text), chr(10) || chr(10) ORDER BY turn), chr(10) || chr(10) || 'ASSISTANT:') AS prompt FROM conversations GROUP BY conv_id")
def chat_prompts(spark, sf_dir):
    return P.conversations_to_text(table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, replace(replace(" + repr(P.CLASSIFY["nli"]).replace("\\n", "' || chr(10) || '") + ", '{transcript}', text), '{hypothesis}', concat('from ', source)) AS prompt FROM documents")
def classification_prompts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", P.classification_prompt("nli", F.col("text"), F.concat(F.lit("from "), "source")).alias("prompt"))


@query("SELECT item_id, label, concat('Given the audio, the following statement is ', lower(label), ': ', text) AS label_text FROM benchmark, (SELECT unnest(['ENTAILMENT', 'NEUTRAL', 'CONTRADICTION']) AS label)")
def label_texts(spark, sf_dir):
    return P.label_texts(table(spark, sf_dir, "benchmark"), "nli", "text").select("item_id", "label", "label_text")


STRIPPED = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def _icl_sql() -> str:
    """Exemplars by hash order in turn of each label, the prefixes of each variant and number of shots, and the targets."""
    line = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    heads = "".join(f" WHEN '{v}' THEN {line(P.icl_prefix([], 0, *flags)[: -len(P.ICL_TRAILER)])}" for v, flags in P.VARIANTS.items())
    return f"""WITH d AS (SELECT concat(source, '/', CAST(doc_id AS VARCHAR), '.wav') AS file_name, text, CASE WHEN toxic = 1 THEN 'CONTRADICTION' WHEN quality = 1 THEN 'ENTAILMENT' ELSE 'NEUTRAL' END AS answer FROM documents JOIN labels USING (doc_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY md5(concat_ws('|', '7', file_name, text)), file_name, text) AS r FROM (SELECT DISTINCT file_name, text, answer FROM d WHERE text IS NOT NULL)),
x AS (SELECT k, e.* FROM (SELECT unnest(generate_series(0, 9)) AS k) s JOIN e ON e.answer = CASE k % 3 WHEN 0 THEN 'ENTAILMENT' WHEN 1 THEN 'NEUTRAL' ELSE 'CONTRADICTION' END AND e.r = k // 3 + 1),
v AS (SELECT variant, shot FROM (SELECT unnest({list(P.VARIANTS)}) AS variant), (SELECT unnest([1, 3, 5, 7, 10]) AS shot)),
p AS (SELECT variant, shot, concat(CASE variant{heads} END, string_agg(concat('Example ', CAST(k + 1 AS VARCHAR), ':', chr(10), 'AudioFile: ', regexp_extract(file_name, '[^/]*$'), chr(10),
  CASE WHEN variant = 'audio_transcript' THEN concat('Transcript: ', {STRIPPED.format('text')}, chr(10)) ELSE '' END, CASE WHEN variant <> 'audio_only' THEN concat('Hypothesis: ', text, chr(10)) ELSE '' END, 'Answer: ', answer, chr(10)), chr(10) ORDER BY k), chr(10), {line(P.ICL_TRAILER)}) AS prefix
  FROM v JOIN x ON k < shot GROUP BY variant, shot),
o AS (SELECT file_name, variant, shot, concat(prefix, chr(10), 'Target AudioFile: ', regexp_extract(file_name, '[^/]*$'), CASE WHEN variant = 'audio_transcript' THEN concat(chr(10), 'Target Transcript: ', coalesce(text, '')) ELSE '' END) AS before, text FROM d, p WHERE text IS NOT NULL)
SELECT file_name, variant, shot, md5(concat(before, chr(10), 'Target Hypothesis: ', text, chr(10), 'Answer:')) AS prompt_md5, {STRIPPED.format('text')} AS target FROM o"""


@query(_icl_sql())
def icl_fan_out(spark, sf_dir):
    """Every labelled document as a target, times variants and shots; and the target found again in its prompt."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("text is not null")
    answer = F.when(F.col("toxic") == 1, "CONTRADICTION").when(F.col("quality") == 1, "ENTAILMENT").otherwise("NEUTRAL")
    rows = docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".wav")).alias("file_name"), F.col("text").alias("hypothesis"), answer.alias("answer"), F.col("text").alias("transcript"))
    chosen = P.pick_exemplars(rows, 10, 7)
    out = P.icl_fan_out(rows, chosen, [1, 3, 5, 7, 10])
    return out.select("file_name", "variant", "shot", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), L.strip_icl_prefix(F.col("prompt")).alias("target"))


def _audio_sql(task: str) -> str:
    text = P.AUDIO[task].replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"SELECT item_id, '{task}' AS task, md5(replace(replace('{text}', '{{hypothesis}}', text), '{{options}}', concat('- ', text))) AS prompt_md5 FROM benchmark"


@query(" UNION ALL ".join(_audio_sql(t) for t in P.AUDIO))
def audio_prompts(spark, sf_dir):
    """Each statement as the question of every audio task."""
    items = table(spark, sf_dir, "benchmark")
    each = F.array(*[F.struct(F.lit(t).alias("task"), F.md5(P.audio_prompt(t, F.col("text"), F.concat(F.lit("- "), "text")).cast("binary")).alias("prompt_md5")) for t in P.AUDIO])
    return items.select("item_id", F.explode(each).alias("x")).select("item_id", "x.task", "x.prompt_md5")


@query("SELECT conv_id, concat('System: ', coalesce(string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn), ''), chr(10), chr(10), 'User: ', coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) || chr(10) ORDER BY turn), ''), chr(10), chr(10), 'Assistant:') AS prompt FROM conversations GROUP BY conv_id")
def chats_by_role(spark, sf_dir):
    """Chats as text for models without a chat template."""
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return grouped.select("conv_id", P.flatten_by_role(F.col("messages")).alias("prompt"))


@query("""WITH m AS (SELECT DISTINCT trim(text) AS t FROM documents JOIN labels USING (doc_id))
SELECT doc_id, substring(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), 1, 80) AS sample FROM documents WHERE text IS NULL OR trim(text) NOT IN (SELECT t FROM m WHERE t IS NOT NULL) ORDER BY doc_id LIMIT 5""")
def unmatched_samples(spark, sf_dir):
    """The first five documents whose text no labelled one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("hypothesis"), F.lit(None).cast("string").alias("gold"))
    mapping = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").withColumn("gold", F.lit("YES"))
    return E.unmatched_samples(E.repair_gold(docs, mapping, "doc_id"), "doc_id")


@query("SELECT doc_id, CASE WHEN length(t) > 40 THEN concat(rtrim(substring(t, 1, 39)), '…') ELSE t END AS clipped FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t FROM documents)")
def clipped_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.clip_text(F.col("text"), 40).alias("clipped"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, CASE WHEN contains(lower(url), 'general') THEN 'General' WHEN contains(lower(url), 'medical') THEN 'Medical' ELSE 'Unknown' END AS dataset FROM pages")
def path_fields(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", L.base_name(F.col("url")).alias("base"), L.dataset_of_path(F.col("url")).alias("dataset"))


@query("SELECT event_id, CAST(k AS INTEGER) AS chunk, CAST(k * 25 AS DOUBLE) AS start FROM (SELECT event_id, unnest(generate_series(0, CAST(least(8, CASE WHEN value <= 30 THEN 1 ELSE 1 + ceil((value - 30) / 25) END) AS BIGINT) - 1)) AS k FROM events)")
def chunk_manifest(spark, sf_dir):
    return P.chunk_manifest(table(spark, sf_dir, "events").select("event_id", "value"), "value", 30.0, 5.0, 8).select("event_id", "chunk", F.col("start").cast("double").alias("start"))


@query("""WITH f AS (SELECT DISTINCT concat('/data/', replace(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.flac' ELSE '.mp3' END) AS path FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT min(path) AS path, regexp_extract(path, '([^/]+)\\.[^.]*$', 1) AS stem, CASE regexp_extract(path, '[^.]*$') WHEN 'wav' THEN 1 WHEN 'flac' THEN 2 ELSE 3 END AS r FROM f GROUP BY 2, 3), x AS (SELECT stem, min_by(path, r) AS path FROM b GROUP BY stem)
SELECT p_partkey, x.path AS audio_path FROM part LEFT JOIN x ON replace(p_name, ' ', '_') = x.stem""")
def file_inventory(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("file_name", F.regexp_replace("p_name", " ", "_"))
    kind = F.when(F.col("p_partkey") % 3 == 0, ".wav").when(F.col("p_partkey") % 3 == 1, ".flac").otherwise(".mp3")
    files = part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("/data/"), "file_name", kind).alias("path")).distinct()
    return E.match_files(part.select("p_partkey", "file_name"), files).select("p_partkey", "audio_path")


@query("SELECT o_orderkey, lower(o_orderpriority) AS gold, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE lower(o_orderstatus) END AS pred, 'easy' AS difficulty FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0")
def required_fields(spark, sf_dir):
    json = "concat('{\"gold\": \" ', o_orderpriority, '\"', CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN ', \"pred\": null' ELSE concat(', \"pred\": \"', o_orderstatus, ' \"') END, CASE WHEN o_orderkey % 11 = 0 THEN ', \"difficulty\": \" \"' ELSE ', \"difficulty\": \"EASY\"' END, '}')"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(F.expr(json)).alias("record"))
    return E.filter_required(rows).select("o_orderkey", "gold", "pred", "difficulty")


@query()
def word_error_rate(spark, sf_dir):
    """Each turn against its conversation's next turn, as a stand-in for transcripts."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("heard")), ["conv_id", "turn"])
    return rounded(W.word_error_rate(pairs, ["role"], "text", "heard"), "wer")


@query("""SELECT CAST(user_id % 4 AS BIGINT) AS model, event_type AS gold,
CASE WHEN event_id % 7 = 0 THEN 'early' WHEN value > 50 THEN event_type ELSE 'other' END AS pred, count(*) AS n FROM events GROUP BY ALL""")
def streamed_confusion(spark, sf_dir):
    """The events as a stream of several batches, with items sent again: some later, which changes nothing, and some with
    an earlier time, which takes the place of what has been counted."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).cast("long").alias("model"), F.col("event_type").alias("gold"), F.when(F.col("value") > 50, F.col("event_type")).otherwise("other").alias("pred"))
    path = scratch_folder(spark)
    again = events.filter("event_id % 5 = 0").withColumns({"ts": F.expr("ts + INTERVAL 1 HOUR"), "pred": F.lit("late")})
    earlier = events.filter("event_id % 7 = 0").withColumns({"ts": F.expr("ts - INTERVAL 1 HOUR"), "pred": F.lit("early")})
    for part in (again, events, earlier):
        part.write.mode("append").parquet(path)
    third = -(-len(spark.read.parquet(path).inputFiles()) // 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", third).parquet(path)
    kinds = [r[0] for r in events.select("gold").distinct().collect()]
    return S.run_to_end(S.stream_confusion(stream, ["model"], [*kinds, "other", "early", "late"], id_col="event_id"), scratch_folder(spark), scratch_folder(spark))
