"""Queries over records: files written and read back, keys from paths, nested hypotheses, overlays and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vectors as V
from ..operators import calibration as C
from ..operators import enrich as E
from ..operators import hypotheses as H
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import transcripts as W
from ..sources import records as R
from ..sources.scratch import scratch_folder
from .queries import BOUNDARY, FIGURES, GOLD, NLI, _maps, metrics_sql, parsed, preds, query, rounded, table


def _order_lines(spark, sf_dir) -> str:
    """The orders as JSON lines, some of them broken or blank; returns their folder."""
    line = "CASE WHEN o_orderkey % 9 = 0 THEN concat('{\"id\": ', o_orderkey) WHEN o_orderkey % 13 = 0 THEN ' ' ELSE concat('{\"id\": ', o_orderkey, ', \"status\": \"', o_orderstatus, '\"}') END AS value"
    path = scratch_folder(spark)
    table(spark, sf_dir, "orders").selectExpr(line).write.text(path)
    return path


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 13 <> 0")
def jsonl_tolerant(spark, sf_dir):
    rows = R.read_jsonl(spark, _order_lines(spark, sf_dir))
    return rows.select(F.variant_get("record", "$.id", "long").alias("id"), F.variant_get("record", "$.status", "string").alias("status"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 9 = 0 OR o_orderkey % 13 <> 0) AS lines, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS bad_lines FROM orders")
def jsonl_bad_lines(spark, sf_dir):
    counts = R.count_bad_lines(spark, _order_lines(spark, sf_dir))
    return counts.agg(F.sum("lines").alias("lines"), F.sum("bad_lines").alias("bad_lines"))


@query("SELECT concat('i', CAST(event_id AS VARCHAR)) AS item_id, event_type AS gold, CASE WHEN value > 50 THEN event_type END AS pred_raw FROM events")
def jsonl_predictions(spark, sf_dir):
    """Prediction records written as JSON lines and read by their schema, strictly."""
    path = scratch_folder(spark)
    events = table(spark, sf_dir, "events")
    events.select(F.concat(F.lit("i"), "event_id").alias("item_id"), F.col("event_type").alias("gold"), F.when(F.col("value") > 50, F.col("event_type")).alias("pred_raw")).write.json(path)
    return R.read_predictions(spark, path, strict=True).select("item_id", "gold", "pred_raw")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, concat('said \"', c_name, '\",', chr(10), 'twice') AS remark, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS segment FROM customer")
def csv_missing_values(spark, sf_dir):
    """Quotes, commas and line ends inside fields, and two marks of a missing value, through a CSV file."""
    path = scratch_folder(spark)
    segment = F.when(F.col("c_custkey") % 3 == 0, "N/A").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("nan")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('said "'), "c_name", F.lit('",\ntwice')).alias("remark"), segment.alias("segment"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return R.read_csv(spark, path, na=True)


@query("SELECT dataset AS task, model, gold, count(*) AS n FROM {preds} GROUP BY ALL")
def task_sink(spark, sf_dir):
    """Confusion totals written into one folder per task and read back with the task from the path."""
    path = scratch_folder(spark)
    counts = preds(spark, sf_dir).groupBy(F.col("dataset").alias("task"), "model", "gold").agg(F.count(F.lit(1)).alias("n"))
    R.write_by_task(counts, path)
    return spark.read.parquet(path).select("task", "model", "gold", "n")


@query("SELECT o_orderkey AS item, o_orderstatus AS gold, NULL AS judge FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'O'")
def united_results(spark, sf_dir):
    """Result tables of which one lacks a column."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("gold"), F.col("o_orderpriority").alias("judge"))
    return R.union_files([orders.filter("gold = 'O'").drop("judge"), orders.filter("gold <> 'O'")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def first_rows(spark, sf_dir):
    """The 100 largest orders: the row cap of a reader, with its order stated."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("k"))
    return R.first_rows(orders, ["k", "o_orderkey"], 100).drop("k")


@query("SELECT variant, shot, count(*) AS n_records, CAST(7 AS INTEGER) AS seed FROM {preds} GROUP BY ALL")
def overlay_manifest(spark, sf_dir):
    return R.manifest(preds(spark, sf_dir), ["variant", "shot"], 7)


PATH_ROWS = "SELECT l_orderkey, l_linenumber, concat('runs/', CASE l_linenumber % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'v2_explicit' ELSE 'new' END, '/whisper', CAST(l_suppkey % 3 AS STRING), '/llama/', CASE l_partkey % 3 WHEN 0 THEN 'afri200_nli' WHEN 1 THEN 'medical_consistency' ELSE 'general_accent_drift' END, '.jsonl') AS path FROM {lineitem}"


@query(f"""SELECT asr_model, text_llm, task, dataset, alm, named, variant, count(*) AS n FROM (SELECT split_part(path, '/', 3) AS asr_model, 'llama' AS text_llm,
CASE WHEN path LIKE '%nli.jsonl' THEN 'nli' WHEN path LIKE '%consistency.jsonl' THEN 'consistency' ELSE 'accent_drift' END AS task,
CASE WHEN path LIKE '%/afri200%' THEN 'afri200' WHEN path LIKE '%/medical%' THEN 'medical' ELSE 'general' END AS dataset, concat('cascade_', split_part(path, '/', 3), '_llama') AS alm,
CASE WHEN path LIKE '%general%' THEN 'General' WHEN path LIKE '%medical%' THEN 'Medical' ELSE 'Unknown' END AS named,
CASE split_part(path, '/', 2) WHEN 'new' THEN 'default' ELSE split_part(path, '/', 2) END AS variant FROM ({PATH_ROWS.replace('{lineitem}', 'lineitem')})) GROUP BY ALL""")
def cascade_provenance(spark, sf_dir):
    """Keys of a cascade's runs, their task and data set, from the paths of their files."""
    rows = spark.sql(PATH_ROWS, lineitem=table(spark, sf_dir, "lineitem"))
    keyed = R.with_cascade_keys(rows).withColumns({"named": L.dataset_of_path(F.col("path")), "variant": L.variant_of_path(F.col("path"))})
    return keyed.groupBy("asr_model", "text_llm", "task", "dataset", "alm", "named", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT variant, model, dataset, shot, count(*) AS n FROM {preds} GROUP BY ALL")
def sweep_layout(spark, sf_dir):
    path = F.concat_ws("/", F.lit("/data/icl"), "variant", "model", "dataset", F.concat(F.lit("shot"), "shot"), F.lit("predictions.jsonl"))
    rows = R.with_sweep_keys(preds(spark, sf_dir).select(path.alias("path")))
    return rows.groupBy("variant", "model", "dataset", "shot").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('clap', CAST(s_suppkey % 3 AS VARCHAR)) AS model_family, concat('task', CAST(s_nationkey AS VARCHAR)) AS task_key, count(*) AS n FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY ALL")
def family_layout(spark, sf_dir):
    """Runs by family and task; files of errors are left out."""
    name = F.concat(F.lit("run"), "s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "_errors.jsonl").otherwise(".jsonl"))
    path = F.concat_ws("/", F.lit("root"), F.concat(F.lit("clap"), F.col("s_suppkey") % 3), F.concat(F.lit("task"), "s_nationkey"), F.lit("results"), name)
    return R.with_family_keys(table(spark, sf_dir, "supplier").select(path.alias("path"))).groupBy("model_family", "task_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT model, dataset, pred, count(*) AS n FROM (SELECT model, dataset, CASE {BOUNDARY} WHEN 'UNPARSEABLE' THEN CASE WHEN l_quantity > 25 THEN lower(gold) ELSE '' END ELSE lower({BOUNDARY}) END AS pred FROM {{preds}}) GROUP BY ALL")
def resolved_predictions(spark, sf_dir):
    """The raw answer's label, else the stored prediction, stripped and lower-cased, else ''."""
    stored = F.when(F.col("l_quantity") > 25, F.concat(F.lit(" "), "gold", F.lit("\t")))
    rows = preds(spark, sf_dir).select("model", "dataset", L.resolve_prediction(F.col("pred_raw"), stored, "nli").alias("pred"))
    return rows.groupBy("model", "dataset", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT model, pred, count(*) AS n FROM (SELECT model, pred_raw AS pred FROM {preds}) GROUP BY ALL")
def promoted_answers(spark, sf_dir):
    rows = E.promote_raw(preds(spark, sf_dir).withColumn("pred", F.lit("old")))
    return rows.groupBy("model", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, file_name FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN concat('row_', CAST(row_number() OVER (ORDER BY event_id) AS VARCHAR), '.wav') ELSE concat('clip', CAST(event_id AS VARCHAR)) END AS file_name FROM events) WHERE value > 20")
def named_clips(spark, sf_dir):
    """Clips without a name are called by their place; those without a transcript count for it and then go."""
    clips = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("clip"), "event_id")).otherwise(" ").alias("file_name"), F.when(F.col("value") > 20, F.col("event_type")).otherwise("\t ").alias("transcript"))
    return H.named_clips(clips, "event_id").select("event_id", "file_name")


@query("SELECT model, difficulty, \"N\", " + ", ".join(f"printf('%.4f', \"{c}\") AS \"{n}\"" for c, n in zip(FIGURES, ("ACC", "P", "R", "F1"))) + f" FROM ({metrics_sql(f'SELECT *, {BOUNDARY} AS pred FROM {{preds}}', ['model', 'difficulty'], NLI, classes=False)})")
def metrics_report(spark, sf_dir):
    """Figures as text with four decimals, models in order and their difficulties from easy to hard."""
    by = M.metrics(parsed(spark, sf_dir), ["model", "difficulty"], NLI, per_class=False)
    return M.report(M.business_order(by, "model"), ["model", "difficulty"])


@query("""SELECT concat(CAST(conv_id AS VARCHAR), '.wav') AS file_name, concat(CAST(conv_id AS VARCHAR), '__hyp_', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR)) AS item_id, upper(role) AS gold,
CASE turn % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS hypothesis_md5 FROM conversations""")
def interview_hypotheses(spark, sf_dir):
    """Records with a list of (label, difficulty, text), one per conversation, to one row per entry."""
    level = F.when(F.col("turn") % 3 == 0, "EASY").when(F.col("turn") % 3 == 1, "Medium").otherwise("hard")
    records = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("audio_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("label"), level.alias("difficulty"), "text"))).alias("hypotheses"))
    return H.explode_interview(records).select("file_name", "item_id", "gold", "difficulty", F.md5(F.col("hypothesis").cast("binary")).alias("hypothesis_md5"))


def _nested(gold: Column) -> Column:
    """A list of two hypotheses for even parts, none for odd ones."""
    entry = lambda c, g: F.struct(c.alias("hypothesis"), g.alias("gold"), F.lit(None).cast("string").alias("difficulty"))
    both = F.array(entry(F.col("p_name"), gold), entry(F.col("p_type"), F.lit("NO")))
    return F.when(F.col("p_partkey") % 2 == 0, both).otherwise(F.filter(both, lambda _: F.lit(False)))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('- ', p_name, chr(10), '- ', p_type) WHEN p_partkey % 5 = 0 THEN '' ELSE concat('- ', p_brand) END AS options,
CASE WHEN p_partkey % 2 = 0 THEN 'YES' WHEN p_partkey % 5 <> 0 THEN 'FLAT' END AS first_gold, concat('Is it so? ', p_name) AS question FROM part""")
def option_lists(spark, sf_dir):
    """A record's hypotheses, or its own flat one where it has no list, as the options of a prompt."""
    flat = F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))
    listed = H.flat_or_nested(_nested(F.lit("YES")), flat, F.lit(None).cast("string"), F.lit("flat"))
    rows = table(spark, sf_dir, "part").withColumn("h", listed)
    return rows.select("p_partkey", H.option_list(F.col("h")).alias("options"), F.try_element_at("h", F.lit(1))["gold"].alias("first_gold"), H.question_prefix(F.lit("Is it so?"), F.col("p_name")).alias("question"))


@query("""SELECT event_id, lower(event_type) AS tail, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def assistant_answers(spark, sf_dir):
    """What follows the last mark of the assistant's turn, and the JSON object inside an answer (an empty one if broken)."""
    said = F.concat(F.lit("system assistant: no\nASSISTANT\n "), F.upper("event_type"), F.lit(" \n"))
    answer = F.concat(F.lit("Here it is: "), F.when(F.col("event_id") % 4 == 0, F.lit("{broken}")).otherwise(F.col("props")), F.lit(" thanks"))
    return table(spark, sf_dir, "events").select("event_id", L.assistant_tail(said).alias("tail"), F.try_variant_get(L.first_json(answer), "$.k", "long").alias("k"))


@query("""SELECT model, count(*) AS n, round(avg(abs(e - c)), 6) AS mean_margin, round(avg(CASE WHEN (e > c) = (gold = 'ENTAILMENT') THEN abs(e - c) END), 6) AS mean_margin_correct,
round(avg(CASE WHEN (e > c) <> (gold = 'ENTAILMENT') THEN abs(e - c) END), 6) AS mean_margin_wrong, round(avg(e), 6) AS mean_positive
FROM (SELECT model, gold, round(l_quantity / 50, 2) AS e, round(l_discount * 10, 2) AS c FROM {preds} WHERE gold <> 'NEUTRAL' AND l_linenumber <> 7) GROUP BY ALL""")
def score_margins(spark, sf_dir):
    """Argmax and margin of each score map; means over right and wrong rows."""
    rows = C.scored_rows(_maps(spark, sf_dir), ["model"]).withColumn("correct", F.col("pred") == F.col("gold"))
    out = C.mean_margins(rows, ["model"]).join(rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_positive")), "model")
    return rounded(out, "mean_margin", "mean_margin_correct", "mean_margin_wrong", "mean_positive")


@query("""SELECT item_id, variant, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 2 END AS n_entailment, CASE WHEN item_id % 3 = 0 THEN NULL ELSE md5(concat('[', variant, '] ', text)) END AS first_md5, concat('[', variant, '] only') AS neutral, 0 AS n_contradiction
FROM benchmark, (SELECT unnest(['audio_only', 'audio_hypothesis']) AS variant)""")
def overlay_records(spark, sf_dir):
    """Hypothesis maps with a prefix before each hypothesis; an absent key becomes an empty list."""
    both = F.array(F.col("text"), F.lit("second"))
    lists = F.to_variant_object(F.struct(F.when(F.col("item_id") % 3 != 0, both).alias("entailment"), F.lit("only").alias("neutral")))
    # The maps are made after the explode: before it, Spark 4.1.2 names the struct's fields col1 and col2.
    rows = table(spark, sf_dir, "benchmark").withColumn("variant", F.explode(F.array(F.lit("audio_only"), F.lit("audio_hypothesis")))).withColumn("output", lists)
    out = rows.withColumn("o", P.overlay_output(F.col("output"), F.concat(F.lit("["), "variant", F.lit("] "))))
    return out.select("item_id", "variant", F.size("o.entailment").alias("n_entailment"), F.md5(F.try_element_at("o.entailment", F.lit(1)).cast("binary")).alias("first_md5"), F.try_element_at("o.neutral", F.lit(1)).alias("neutral"), F.size("o.contradiction").alias("n_contradiction"))


@query("SELECT doc_id, md5(concat('Read the transcript and write hypotheses about it as JSON.', chr(10), 'Transcript: ', text, chr(10))) AS prompt_md5 FROM documents")
def generation_prompts(spark, sf_dir):
    """A template whose {{TRANSCRIPT}} takes the text as it is, braces included."""
    prompt = P.fill("Read the transcript and write hypotheses about it as JSON.\nTranscript: {{TRANSCRIPT}}\n", transcript=F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt.cast("binary")).alias("prompt_md5"))


def _echo():
    """A stand-in for a model: fails on some prompts, answers others at the second time of asking."""
    asked: set[str] = set()

    def model(prompt: str) -> str:
        first = prompt not in asked
        asked.add(prompt)
        if prompt.startswith("error"):
            raise ValueError("refused")
        return "" if first and prompt.startswith("search") else prompt.upper()

    return model


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN upper(concat(event_type, ' ', CAST(event_id AS VARCHAR))) END AS pred_raw, CASE WHEN event_type = 'error' THEN 'ValueError: refused' END AS error,
CAST(event_type = 'search' AS INTEGER) AS retry_count FROM events""")
def model_answers(spark, sf_dir):
    """The hook for a user's model, with one retry of empty answers and errors kept in their rows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", "event_id").alias("prompt"))
    return W.run_model(rows, _echo).drop("prompt")


@query("""WITH t AS (SELECT e.vec_id AS item, x.label AS label, f.embedding AS v FROM embeddings e, (SELECT unnest([1, 2, 3]) AS label) x JOIN embeddings f ON f.vec_id = (e.vec_id * 7 + x.label * 11) % 50),
s AS (SELECT e.vec_id, t.label, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(t.v AS DOUBLE[])) / ((sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) + 1e-12) * (sqrt(list_dot_product(CAST(t.v AS DOUBLE[]), CAST(t.v AS DOUBLE[]))) + 1e-12)) AS c FROM embeddings e JOIN t ON e.vec_id = t.item),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS r FROM s)
SELECT vec_id, max(CASE WHEN r = 1 THEN label END) AS pred, round(max(CASE WHEN r = 1 THEN c END), 6) AS top1, round(max(CASE WHEN r = 1 THEN c END) - max(CASE WHEN r = 2 THEN c END), 6) AS margin FROM k GROUP BY vec_id""")
def pair_scores(spark, sf_dir):
    """Each vector against three label texts of its own."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.select("vec_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("label")).withColumn("text", (F.col("vec_id") * 7 + F.col("label") * 11) % 50)
    texts = asked.join(e.select(F.col("vec_id").alias("text"), F.col("embedding").alias("v")), "text")
    return rounded(V.score_pairs(e, texts, "vec_id", "embedding", "label", "v").drop("scores"), "top1", "margin")


@query("SELECT DISTINCT variant, shot, dataset FROM {preds} WHERE shot <> 10 EXCEPT SELECT variant, shot, dataset FROM {preds} WHERE l_quantity > 49 AND l_tax > 0.07 AND l_discount > 0.08")
def missing_parts(spark, sf_dir):
    """Expected parts of a sweep for which nothing landed."""
    df, keys = preds(spark, sf_dir), ["variant", "shot", "dataset"]
    return E.missing_parts(df.filter("shot <> 10").select(*keys).distinct(), df.filter("l_quantity > 49 and l_tax > 0.07 and l_discount > 0.08"), keys)


@query("SELECT event_id, CAST(k AS INTEGER) AS chunk, CAST(k * 30 AS DOUBLE) AS start FROM (SELECT event_id, unnest(generate_series(0, CAST(greatest(1, ceil(value / 30)) AS BIGINT) - 1)) AS k FROM events)")
def clip_chunks(spark, sf_dir):
    """Back-to-back chunks of 30 seconds."""
    return P.chunk_manifest(table(spark, sf_dir, "events").select("event_id", "value"), "value", 30.0).select("event_id", "chunk", F.col("start").cast("double").alias("start"))


@query(f"SELECT difficulty, {GOLD.replace('l_returnflag', 'f')} AS gold, count(*) AS n, count(DISTINCT l_orderkey) AS clips FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS f, CASE l_linenumber % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY GROUPING SETS ((), (difficulty), (gold))")
def pilot_subset(spark, sf_dir):
    """Composition of the rows whose clip stands in a list of ids."""
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = preds(spark, sf_dir).join(ids, "l_orderkey", "left_semi")
    return H.composition(rows.select(F.col("l_orderkey").alias("file_name"), "difficulty", "gold"))


@query("""SELECT item_id, item_id % 4 <> 0 AS made, CASE WHEN item_id % 4 <> 0 THEN md5(concat('EXAMPLES', chr(10), 'Target AudioFile: ', CAST(item_id AS VARCHAR), '.wav', chr(10), 'Target Transcript: said', chr(10), 'Target Hypothesis: ', text, chr(10), 'Answer:')) END AS first_md5,
CASE WHEN item_id % 4 <> 0 THEN 0 END AS n_neutral, CASE WHEN item_id % 4 <> 0 THEN 5 END AS num_shots FROM benchmark""")
def overlay_settings(spark, sf_dir):
    """Whole records with their overlay and how it was made; records whose output isn't an object pass unchanged."""
    maps = F.to_variant_object(F.struct(F.concat(F.lit("clips/"), "item_id", F.lit(".wav")).alias("file_name"), F.lit(" said ").alias("transcript"), F.struct(F.array("text").alias("entailment")).alias("output")))
    bare = F.to_variant_object(F.struct(F.lit("x.wav").alias("file_name"), F.lit("no map").alias("output")))
    rows = table(spark, sf_dir, "benchmark").withColumn("record", F.when(F.col("item_id") % 4 != 0, maps).otherwise(bare))
    out = rows.withColumn("o", P.overlay_record(F.col("record"), F.lit("EXAMPLES\n"), "audio_transcript", 5, 10))
    return out.select("item_id", F.col("o.icl_overlay").isNotNull().alias("made"), F.md5(F.try_element_at("o.output.entailment", F.lit(1)).cast("binary")).alias("first_md5"), F.when(F.col("o.output").isNotNull(), F.size("o.output.neutral")).alias("n_neutral"), F.col("o.icl_overlay.num_shots").alias("num_shots"))
