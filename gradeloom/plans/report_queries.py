"""Queries over written trees, ASR errors, ranks, observed labels and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import templates as G
from ..operators import enrich as E
from ..operators import metrics as M
from ..operators import partitions
from ..operators import transcripts as W
from ..sources import records as R
from ..sources import sinks
from ..sources.scratch import discard, drop_folder, scratch_folder, stored
from .queries import BOUNDARY, parsed, preds, query, rounded, table

HASH = "CAST(sum(CAST(concat('0x', substr(md5({0}), 1, 8)) AS BIGINT)) AS BIGINT)"


def _hash_sum(column: str):
    """A sum of 32 bits of each value's md5: equal only for equal texts, and the same in any order."""
    return F.sum(F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 8), 16, 10).cast("long"))


@query(f"""SELECT kind, coalesce(source, '_null') AS task, 1 AS n_files, count(*) AS n, {HASH.format('text')} AS texts FROM documents, (SELECT unnest(['csv', 'json', 'parquet']) AS kind) GROUP BY ALL""")
def task_files(spark, sf_dir):
    """Whole texts through one file per source, as JSON lines, CSV and Parquet: read back byte for byte."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("task"))
    out = None
    for kind in ("csv", "json", "parquet"):
        path = scratch_folder(spark)
        files = sinks.write_files(docs, path, kind, order=["doc_id"])
        schema = "doc_id long, text string, task string"
        rows = sinks.read_csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).format(kind).load(path).select("text", "_metadata.file_path")
        # Texts are hashed where they are read; only a file's figures are joined with its task.
        read = rows.groupBy(F.element_at(F.split("file_path", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"), _hash_sum("text").alias("texts"))
        found = read.join(files.select("file", F.col("name").alias("task")), "file")
        one = found.groupBy("task").agg(F.count("file").cast("int").alias("n_files"), F.sum("n").alias("n"), F.sum("texts").alias("texts")).withColumn("kind", F.lit(kind))
        # Only the figures are kept, so that one kind's files are there at a time.
        one = stored(one)
        drop_folder(spark, path)
        discard(*[rows] if kind == "csv" else [])
        out = one if out is None else out.unionByName(one)
    return out


CASCADE = "concat('whisper', CAST(l_suppkey % 3 AS STRING), '/llama', CAST(l_suppkey % 2 AS STRING), '/', CASE l_partkey % 3 WHEN 0 THEN 'afri200_nli' WHEN 1 THEN 'medical_consistency' ELSE 'general_accent_drift' END)"


@query(f"""SELECT concat('whisper', CAST(l_suppkey % 3 AS VARCHAR)) AS asr_model, concat('llama', CAST(l_suppkey % 2 AS VARCHAR)) AS text_llm, CASE l_partkey % 3 WHEN 0 THEN 'nli' WHEN 1 THEN 'consistency' ELSE 'accent_drift' END AS task,
CASE l_partkey % 3 WHEN 0 THEN 'afri200' WHEN 1 THEN 'medical' ELSE 'general' END AS dataset, gold, {BOUNDARY} AS pred, count(*) AS n FROM {{preds}} GROUP BY ALL""")
def cascade_scan(spark, sf_dir):
    """Predictions written into a tree asr/llm/task.jsonl, found again by scanning it, with their keys from the paths."""
    rows = preds(spark, sf_dir).withColumn("_tree", F.expr(CASCADE))
    path = scratch_folder(spark)
    sinks.write_files(rows.select("gold", "pred_raw", "_tree"), path, "json", "_tree")
    read = R.with_cascade_keys(R.read_predictions(spark, path).select("gold", "pred_raw", "path"))
    return read.withColumn("pred", L.parse_label(F.col("pred_raw"), "nli")).groupBy("asr_model", "text_llm", "task", "dataset", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT variant, model, dataset, shot, count(*) AS n FROM {preds} GROUP BY ALL""")
def sweep_scan(spark, sf_dir):
    """Predictions in the layout of a sweep, variant/model/dataset/shot{n}/predictions.jsonl, scanned with four keys from the path."""
    rows = preds(spark, sf_dir).withColumn("_tree", F.concat_ws("/", "variant", "model", "dataset", F.concat(F.lit("shot"), "shot"), F.lit("predictions")))
    path = scratch_folder(spark)
    sinks.write_files(rows.select("gold", "pred_raw", "_tree"), path, "json", "_tree")
    # Rows are counted by file; the keys of a path are taken once a file.
    files = R.read_predictions(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return R.with_sweep_keys(files).groupBy("variant", "model", "dataset", "shot").agg(F.sum("n").alias("n"))


@query("""WITH s AS (SELECT source, CAST(substr(source, 4) AS BIGINT) AS k, sum(strlen(text) + 1) AS size FROM documents WHERE source IS NOT NULL GROUP BY ALL),
kinds AS (SELECT s.*, unnest(CASE k % 4 WHEN 0 THEN ['wav'] WHEN 1 THEN ['flac', 'mp3'] WHEN 2 THEN ['mp3'] ELSE ['ogg'] END) AS ending FROM s),
asked AS (SELECT source AS file_name, source, CASE k % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'flac' WHEN 2 THEN 'mp3' END AS ending, size FROM s
  UNION ALL SELECT concat('data/clips/', source, '.mp3'), source, CASE WHEN k % 4 IN (1, 2) THEN 'mp3' END, size FROM s UNION ALL SELECT concat('none', source), source, NULL, size FROM s)
SELECT file_name, ending IS NOT NULL AS found, CASE WHEN ending IS NOT NULL THEN concat(source, '.', ending) END AS file, CAST(CASE WHEN ending IS NOT NULL THEN size END AS BIGINT) AS size FROM asked""")
def file_inventory(spark, sf_dir):
    """Files of a tree that this query writes, found by exact name or by the first known ending, with their sizes; and what is missing."""
    docs = table(spark, sf_dir, "documents").filter("source is not null").select("source", "text", F.substring("source", 4, 9).cast("int").alias("k"))
    endings = F.when(F.col("k") % 4 == 0, F.array(F.lit("wav"))).when(F.col("k") % 4 == 1, F.array(F.lit("flac"), F.lit("mp3"))).when(F.col("k") % 4 == 2, F.array(F.lit("mp3"))).otherwise(F.array(F.lit("ogg")))
    path = scratch_folder(spark)
    # One line for each text; a line end within it is as long as the one after it.
    named = docs.select("text", F.explode(endings).alias("ending"), "source", "k").select("text", F.concat(F.lit("d"), F.col("k") % 3, F.lit("/"), "source", F.lit("."), "ending").alias("name"))
    sinks.write_files(named, path, "text", "name", ending="")
    sources = docs.select("source").distinct()
    asked = sources.select(F.explode(F.array("source", F.concat(F.lit("data/clips/"), "source", F.lit(".mp3")), F.concat(F.lit("none"), "source"))).alias("file_name"))
    report = E.file_report(asked, sinks.list_files(spark, path))
    return report.select("file_name", "found", L.base_name(F.col("audio_path")).alias("file"), "size")


@query("""SELECT variant, shot, count(*) AS n_records, CAST(count(DISTINCT model) AS BIGINT) AS n_files, array_to_string(list_sort(list(DISTINCT concat(model, '.jsonl'))), ',') AS files, 'lineitem' AS sources, 'm0,m1,m2,m3' AS models, CAST(7 AS INTEGER) AS seed FROM {preds} GROUP BY ALL""")
def overlay_files(spark, sf_dir):
    """The manifest of a data set that was written, with the files of each part, their rows and the settings."""
    rows = preds(spark, sf_dir).withColumn("_tree", F.concat_ws("/", F.concat(F.lit("variant="), "variant"), F.concat(F.lit("shot="), "shot"), F.col("model")))
    path = scratch_folder(spark)
    sinks.write_files(rows.select("gold", "pred_raw", "_tree"), path, "json", "_tree")
    # The folders' names give the keys.
    read = spark.read.schema("gold string, pred_raw string, variant string, shot int").json(path)
    rows = sinks.manifest_of(read, ["variant", "shot"], sources=["lineitem"], models=["m0", "m1", "m2", "m3"], seed=7)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("files", "sources", "models")})


SAID = "concat_ws(' ', substr(gold, 1, 1), dataset, CAST(l_linenumber AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(round(l_tax * 100) AS INT) AS STRING))"
WORDS = "[lower(substr(gold, 1, 1)), lower(dataset), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR)]"
HEARD = """CASE l_orderkey % 8 WHEN 0 THEN w WHEN 1 THEN list_concat(w[1:1], w[3:5]) WHEN 2 THEN list_concat(w, w[2:3]) WHEN 3 THEN list_concat(['x'], w[2:5]) WHEN 4 THEN [w[2], w[1], w[3], w[4], w[5]]
WHEN 5 THEN [] WHEN 6 THEN list_concat(['uh'], w[1:3], ['uh', 'uh']) ELSE [w[3], w[4], w[5], w[1]] END"""


def _heard(spark, sf_dir):
    """Transcripts that are right, lack a word, repeat, replace or turn round some, or are missing."""
    w = "split(said, ' ')"
    heard = f"""CASE l_orderkey % 8 WHEN 0 THEN said WHEN 1 THEN array_join(array_remove(transform({w}, (x, i) -> IF(i = 1, '', x)), ''), '  ') WHEN 2 THEN concat_ws(' ', said, {w}[1], {w}[2]) WHEN 3 THEN concat_ws(' ', 'X', {w}[1], {w}[2], {w}[3], {w}[4])
    WHEN 4 THEN concat_ws(' ', {w}[1], {w}[0], {w}[2], {w}[3], {w}[4]) WHEN 5 THEN NULL WHEN 6 THEN concat_ws(' ', 'uh', {w}[0], {w}[1], {w}[2], 'UH uh') ELSE concat_ws(' ', {w}[2], {w}[3], {w}[4], {w}[0]) END"""
    return parsed(spark, sf_dir).withColumn("said", F.expr(SAID)).withColumn("heard", F.expr(heard))


# Costs of aligning the first i words with all prefixes of what was heard, row by row: an edit weighs 2^32, a hit minus one.
ALIGNED = f"""WITH RECURSIVE t AS (SELECT *, {HEARD} AS h FROM (SELECT model, l_orderkey, {WORDS} AS w FROM {{preds}})),
pairs AS (SELECT model, w, h, count(*) AS times FROM t GROUP BY ALL),
d AS (SELECT DISTINCT w, h FROM pairs),
r AS (SELECT w, h, 0 AS i, list_transform(generate_series(0, len(h)), lambda j: j * 4294967296) AS c FROM d
  UNION ALL SELECT w, h, i + 1, list_reduce(list_transform(generate_series(1, len(h)), lambda j: [j]), lambda a, j: list_append(a, least(a[len(a)] + 4294967296, c[j[1] + 1] + 4294967296, c[j[1]] + CASE WHEN h[j[1]] = w[i + 1] THEN -1 ELSE 4294967296 END)), [(i + 1) * 4294967296]) FROM r WHERE i < len(w)),
e AS (SELECT w, h, c[len(h) + 1] AS cost, CAST(-floor(-c[len(h) + 1] / 4294967296) AS BIGINT) AS edits FROM r WHERE i = len(w)),
k AS (SELECT *, edits * 4294967296 - cost AS hits FROM e),
f AS (SELECT w, h, hits, edits - (len(w) - hits) AS ins, edits - (len(w) - hits) - (len(h) - len(w)) AS del FROM k)
SELECT model, CAST(sum(times * hits) AS BIGINT) AS hits, CAST(sum(times * (len(w) - hits - del)) AS BIGINT) AS substitutions, CAST(sum(times * del) AS BIGINT) AS deletions, CAST(sum(times * ins) AS BIGINT) AS insertions,
  CAST(sum(times * len(w)) AS BIGINT) AS words, round(sum(times * (len(w) - hits + ins)) / sum(times * len(w)), 6) AS wer FROM pairs JOIN f USING (w, h) GROUP BY model"""


@query(ALIGNED)
def asr_error_kinds(spark, sf_dir):
    """Words heard right, replaced, left out and added, by model."""
    return rounded(W.error_kinds(_heard(spark, sf_dir), ["model"], "said", "heard"), "wer")


@query(f"""WITH t AS (SELECT model, {HEARD} = w AS a, coalesce(gold = {BOUNDARY}, false) AS b FROM (SELECT *, {WORDS} AS w FROM {{preds}})),
g AS (SELECT DISTINCT model, x AS asr_ok, y AS nli_ok FROM t, (SELECT unnest([true, false]) AS x), (SELECT unnest([true, false]) AS y)),
n AS (SELECT g.model, asr_ok, nli_ok, count(t.a) AS n FROM g LEFT JOIN t ON t.model = g.model AND a = asr_ok AND b = nli_ok GROUP BY ALL)
SELECT model, asr_ok, nli_ok, n, round(n / nullif(sum(n) OVER (PARTITION BY model, asr_ok), 0), 6) AS share FROM n""")
def asr_by_nli(spark, sf_dir):
    """Rows whose transcript is right or wrong by rows whose label is."""
    return rounded(W.asr_by_nli(_heard(spark, sf_dir), ["model"], "said", "heard"), "share")


OBSERVED = """SELECT CAST(user_id % 4 AS BIGINT) AS model, concat(event_type, ' seen') AS gold, CASE WHEN value > 50 THEN concat(event_type, ' seen') WHEN value > 20 THEN 'other' END AS pred FROM events"""


@query(f"""WITH r AS (SELECT * FROM ({OBSERVED}) WHERE pred IS NOT NULL), c AS (SELECT model, gold, pred, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT model, gold AS label FROM c UNION SELECT model, pred FROM c),
k AS (SELECT s.*, sum(CASE WHEN gold = label AND pred = label THEN n ELSE 0 END) AS tp, sum(CASE WHEN gold = label THEN n ELSE 0 END) AS sup, sum(CASE WHEN pred = label THEN n ELSE 0 END) AS prd FROM s JOIN c USING (model) GROUP BY ALL),
m AS (SELECT model, round(avg(CASE WHEN prd > 0 THEN tp / prd ELSE 0 END), 6) AS "P_macro", round(avg(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END), 6) AS "R_macro", round(avg(2 * tp / (sup + prd)), 6) AS "F1_macro",
  {', '.join(f"round(max(CASE WHEN label = '{x} seen' AND sup > 0 THEN tp / sup END), 6) AS " + '"ACC_' + x.upper() + '_SEEN"' for x in ('click', 'error', 'purchase', 'signup', 'view'))}, CAST(NULL AS DOUBLE) AS "ACC_OTHER" FROM k GROUP BY model),
t AS (SELECT model, CAST(sum(n) AS BIGINT) AS "N", round(sum(CASE WHEN gold = pred THEN n ELSE 0 END) / sum(n), 6) AS "ACC" FROM c GROUP BY model)
SELECT * FROM t JOIN m USING (model)""")
def metrics_observed_columns(spark, sf_dir):
    """Metrics with a column for each label that the data show, by a safe name."""
    out = M.metrics_observed(spark.sql(OBSERVED.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")), ["model"])
    return rounded(out, *[c for c in out.columns if c not in ("model", "N")])


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank FROM orders")
def ranked_rows(spark, sf_dir):
    """Every order's place in the whole table's order, without a task that sorts it all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return partitions.with_rank(orders, F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("SELECT dataset, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n, true AS near FROM {preds} GROUP BY dataset")
def distinct_clips(spark, sf_dir):
    """Distinct clips per data set, exactly, and whether sketches stored by model and united come within their error."""
    rows = preds(spark, sf_dir)
    exact = rows.groupBy("dataset").agg(F.count_distinct("l_orderkey").alias("n"))
    path = scratch_folder(spark)
    M.distinct_sketches(rows, ["dataset", "model"], "l_orderkey").write.parquet(path)
    united = M.united_distinct(spark.read.parquet(path), ["dataset"])
    return exact.join(united, "dataset").select("dataset", "n", (F.abs(F.col("estimate") - F.col("n")) <= F.lit(3 * 1.04 / 64) * F.col("n") + 1).alias("near"))


PAIRS = list(G.TEMPLATES)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"({k}, {_quoted(p[0])}, {_quoted(p[1])}, {_quoted(p[2])}, {_quoted(s)}, {_quoted(b.partition('{{TRANSCRIPT}}')[0])}, {_quoted(b.partition('{{TRANSCRIPT}}')[2])})" for k, (p, (s, b)) in enumerate(G.TEMPLATES.items()))}) x(k, dataset, task, form, system, head, tail))
SELECT doc_id, dataset, task, form, md5(system) AS system_md5, md5(concat(head, text, tail)) AS prompt_md5 FROM documents JOIN t ON doc_id % {len(PAIRS)} = k""")
def generation_prompt_table(spark, sf_dir):
    """Every document as a transcript in the template of a data set and task, all of them in turn."""
    names = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("dataset", "task", "form"), key, strict=True)]) for key in PAIRS])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("transcript"), names[(F.col("doc_id") % len(PAIRS)).cast("int")].alias("p")).select("doc_id", "transcript", "p.*")
    templates, out = G.template_table(spark), None
    for form in ("multi", "single"):
        one = G.generation_prompts(docs.filter(F.col("form") == form), templates, form)
        out = one if out is None else out.unionByName(one)
    return out.select("doc_id", "dataset", "task", "form", F.md5(F.col("system").cast("binary")).alias("system_md5"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


# Two labels of each task; an intent is any text.
TASK_LABELS = {"consistency": ("CONSISTENT", "INCONSISTENT"), "plausibility": ("PLAUSIBLE", "IMPLAUSIBLE"), "restraint": ("SUPPORTED", "UNSUPPORTED"), "accent_drift": ("TRUE", "FALSE"), "commonsense": ("YES", "NO"), "intent": ("Book a room", "Ask for help")}
ANSWER = "CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN a WHEN 1 THEN concat(' ', lower(b), '.') WHEN 2 THEN concat('Answer: ', a, ' because it is said so') WHEN 3 THEN concat('LABEL: ', lower(b)) WHEN 4 THEN concat('It is not ', lower(a)) WHEN 5 THEN concat(a, ', not ', b) WHEN 6 THEN 'yes, it aligns' WHEN 7 THEN 'No way' WHEN 8 THEN ' ' WHEN 9 THEN 't' END"
ANSWERS = f"SELECT task, {ANSWER} AS p FROM (SELECT *, CASE l_partkey % 6 {' '.join(f'WHEN {k} THEN {_quoted(t)}' for k, t in enumerate(TASK_LABELS))} END AS task, CASE l_partkey % 6 {' '.join(f'WHEN {k} THEN {_quoted(x[0])}' for k, x in enumerate(TASK_LABELS.values()))} END AS a, CASE l_partkey % 6 {' '.join(f'WHEN {k} THEN {_quoted(x[1])}' for k, x in enumerate(TASK_LABELS.values()))} END AS b FROM {{lineitem}})"


def _parsers_sql() -> str:
    """The five parsers in SQL, over answers p of each task; q is the stripped text, u that in upper case without its marks."""
    word = lambda x: f"regexp_matches(upper(p), '\\b{x}\\b')"
    has = lambda x: f"contains(lower(q), '{x}')"
    parts = {
        "consistency": (f"WHEN {has('consistent')} THEN 'CONSISTENT'", "WHEN contains(u, 'CONSISTENT') THEN 'CONSISTENT'"),
        "plausibility": (f"WHEN {has('plausible')} THEN 'PLAUSIBLE'", "WHEN contains(u, 'PLAUSIBLE') THEN 'PLAUSIBLE'"),
        "restraint": (f"WHEN {has('support')} AND NOT {has('not')} THEN 'SUPPORTED' WHEN {has('not support')} OR {has('unsupport')} THEN 'UNSUPPORTED'", "WHEN contains(u, 'SUPPORTED') THEN 'SUPPORTED'"),
        "accent_drift": ("WHEN lower(q) LIKE 'true%' OR lower(q) = 't' THEN 'TRUE' WHEN lower(q) LIKE 'false%' OR lower(q) = 'f' THEN 'FALSE'", "WHEN contains(u, 'TRUE') OR contains(u, 'YES') THEN 'TRUE' WHEN contains(u, 'FALSE') OR contains(u, 'NO') THEN 'FALSE'"),
        "commonsense": ("WHEN lower(q) LIKE 'yes%' OR lower(q) = 'y' THEN 'YES' WHEN lower(q) LIKE 'no%' OR lower(q) = 'n' THEN 'NO'", "WHEN contains(u, 'ALIGN') THEN 'ALIGNED'"),
    }
    out = []
    for task, (a, b) in TASK_LABELS.items():
        rows = f"FROM r WHERE task = '{task}'"
        if task == "intent":
            out += [f"SELECT task, '{s}' AS strategy, CASE WHEN {x} = '' THEN 'UNPARSEABLE' ELSE {x} END AS label {rows}" for s, x in (("boundary", "upper(q)"), ("ordered", "q"), ("substring", "q"), ("prefix_fallback", "q"))]
        else:
            long, short = sorted((a, b), key=lambda x: (-len(x), x))
            sub, pre = parts[task]
            out.append(f"SELECT task, 'boundary' AS strategy, CASE WHEN {word(long)} THEN '{long}' WHEN {word(short)} THEN '{short}' ELSE 'UNPARSEABLE' END AS label {rows}")
            out.append(f"SELECT task, 'ordered', CASE WHEN {word(a)} THEN '{a.lower()}' WHEN {word(b)} THEN '{b.lower()}' ELSE 'unparseable' END {rows}")
            out.append(f"SELECT task, 'substring', CASE {sub} ELSE 'UNPARSEABLE' END {rows}")
            out.append(f"SELECT task, 'prefix_fallback', CASE WHEN p = '' THEN 'UNPARSEABLE' {pre} WHEN length(split_part(u, ' ', 1)) > 2 THEN split_part(u, ' ', 1) ELSE 'UNPARSEABLE' END {rows}")
        out.append(f"SELECT task, 'raw', upper(q) {rows}")
    answers = f"SELECT task, coalesce(p, '') AS p, trim(coalesce(p, '')) AS q, trim(replace(replace(trim(upper(coalesce(p, ''))), 'LABEL:', ''), 'ANSWER:', '')) AS u FROM ({ANSWERS.replace('{lineitem}', 'lineitem')})"
    return f"WITH r AS ({answers}) SELECT task, strategy, label, count(*) AS n FROM ({' UNION ALL '.join(out)}) GROUP BY ALL"


@query(_parsers_sql())
def label_parsers_by_task(spark, sf_dir):
    """The parsers that read any task's answers, side by side over the tasks other than NLI."""
    rows = spark.sql(ANSWERS, lineitem=table(spark, sf_dir, "lineitem"))
    strategies = ("boundary", "ordered", "substring", "prefix_fallback", "raw")
    read = lambda s: F.coalesce(*[F.when(F.col("task") == t, L.parse_label(F.col("p"), t, s)) for t in TASK_LABELS])
    each = rows.select("task", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), read(s).alias("label")) for s in strategies])).alias("x"))
    return each.groupBy("task", "x.strategy", "x.label").agg(F.count(F.lit(1)).alias("n"))
