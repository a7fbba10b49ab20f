"""Operators of the evaluation library on small frames, published figures, and the queries against SQL."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeloom.functions import labels as L
from gradeloom.functions import vectors as V
from gradeloom.operators import calibration as C
from gradeloom.operators import enrich as E
from gradeloom.operators import hypotheses as H
from gradeloom.operators import metrics as M
from gradeloom.operators import partitions
from gradeloom.operators import prompts as P
from gradeloom.operators import transcripts as W
from gradeloom.plans import queries as Q
from gradeloom.sources import records as R

SF = "/root/testdata/sf0.001"

PARSED = [
    ("boundary", "nli", "entailment.", "ENTAILMENT"),
    ("boundary", "nli", "NEUTRAL, not ENTAILMENT", "ENTAILMENT"),
    ("boundary", "nli", "ENTAILMENTS", "UNPARSEABLE"),
    ("boundary", "nli", None, "UNPARSEABLE"),
    ("boundary", "consistency", "INCONSISTENT", "INCONSISTENT"),
    ("boundary", "restraint", "UNSUPPORTED", "UNSUPPORTED"),
    ("boundary", "plausibility", "IMPLAUSIBLE\nreason", "IMPLAUSIBLE"),
    ("ordered", "nli", "CONTRADICTION or ENTAILMENT", "entailment"),
    ("ordered", "nli", "I cannot tell", "unparseable"),
    ("substring", "consistency", "inconsistent", "CONSISTENT"),
    ("substring", "restraint", "unsupported", "SUPPORTED"),
    ("substring", "restraint", "not supported", "UNSUPPORTED"),
    ("substring", "nli", "neither", "NEUTRAL"),
    ("substring", "commonsense", "n", "NO"),
    ("substring", "accent_drift", "True!", "TRUE"),
    ("prefix_fallback", "accent_drift", "LABEL: TRUE", "TRUE"),
    ("prefix_fallback", "nli", "maybe so", "MAYBE"),
    ("prefix_fallback", "nli", "ok", "UNPARSEABLE"),
    ("prefix_fallback", "nli", "", "UNPARSEABLE"),
    ("keyword_rules", "nli", "they disagree", "ENTAILMENT"),
    ("keyword_rules", "nli", "The audio does not entail it", "NEUTRAL"),
    ("keyword_rules", "nli", "it does not contradict", "NEUTRAL"),
    ("keyword_rules", "nli", "they oppose it", "CONTRADICTION"),
    ("keyword_rules", "nli", "no clear indication", "NEUTRAL"),
    ("raw", "nli", " \tneutral\n", "NEUTRAL"),
    ("raw", "nli", None, ""),
    ("raw", "intent", "book a room", "BOOK A ROOM"),
    ("boundary", "intent", " book a room\n", "BOOK A ROOM"),
    ("boundary", "intent", " ", "UNPARSEABLE"),
    ("substring", "intent", " Book a room\n", "Book a room"),
]


def test_parsers(spark):
    for key in {(s, t) for s, t, _, _ in PARSED}:
        rows = [(x, want) for s, t, x, want in PARSED if (s, t) == key]
        df = spark.createDataFrame(rows, "x string, want string").withColumn("got", L.parse_label(F.col("x"), key[1], key[0]))
        assert [(r.x, r.got) for r in df.collect()] == rows, key


def test_string_functions(spark):
    df = spark.createDataFrame([("a Target Hypothesis: H one\nAnswer: x Target Hypothesis: no", "say assistant\n NEUTRAL", "x {\"a\": {\"b\": 1}} y", "/p/q/clip.one.wav")], "a string, b string, c string, d string")
    r = df.select(L.strip_icl_prefix(F.col("a")), L.assistant_tail(F.col("b")), F.to_json(L.first_json(F.col("c"))), L.stem(F.col("d")), L.clip_text(F.lit("  abcdef "), 4), L.strip_icl_prefix(F.lit("plain ")), L.resolve_prediction(F.lit(None).cast("string"), F.lit(" Yes "), "nli")).first()
    assert list(r) == ["H one", "neutral", '{"a":{"b":1}}', "clip.one", "abc…", "plain", "yes"]


def test_sources(spark, tmp_path):
    folder = tmp_path / "v1" / "kimi" / "medical" / "shot3"
    folder.mkdir(parents=True)
    (folder / "predictions.jsonl").write_text('{"item_id": "a", "gold": "X"}\n\nnot json\n{"item_id": "b"}\n')
    df = R.with_sweep_keys(R.read_jsonl(spark, str(tmp_path)))
    assert [tuple(r) for r in df.select("variant", "model", "dataset", "shot").distinct().collect()] == [("v1", "kimi", "medical", 3)]
    assert df.count() == 2 and R.count_bad_lines(spark, str(tmp_path)).first().bad_lines == 1
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path), strict=True).collect()
    csv = tmp_path / "x.csv"
    csv.write_text('gold,pred\nA,"two\nlines"\nNA,\n')
    assert [tuple(r) for r in R.read_csv(spark, str(csv), na=True).collect()] == [("A", "two\nlines"), (None, None)]


def test_hypotheses(spark):
    rows = [("d/a.wav", '{"entailment": ["x", " "], "contradiction": [{"hypothesis": "z", "difficulty": "hard"}], "neutral": "y"}'), (None, '{"neutral": null}'), ("b.wav", "[1]")]
    df = spark.createDataFrame(rows, "file_name string, o string").select("file_name", F.parse_json("o").alias("output"))
    got = [tuple(r) for r in H.explode_hypotheses(df, "nli", order=["entailment", "contradiction", "neutral"]).select("item_id", "hypothesis", "gold", "difficulty").collect()]
    assert got == [("a__hyp_0", "x", "ENTAILMENT", None), ("a__hyp_1", "z", "CONTRADICTION", "hard"), ("a__hyp_2", "y", "NEUTRAL", None)]


def test_published_figures(spark):
    """116 answers of which 4 + 2 lie outside the labels reproduce the published plausibility row."""
    rows = [("PLAUSIBLE", "PLAUSIBLE")] * 54 + [("PLAUSIBLE", "IMPLAUSIBLE")] * 2 + [("PLAUSIBLE", "YES, IT IS")] * 2 + [("IMPLAUSIBLE", "IMPLAUSIBLE")] * 52 + [("IMPLAUSIBLE", "PLAUSIBLE")] * 3 + [("IMPLAUSIBLE", "IMPLAUSIBLE\nWHY")] * 3
    df = spark.createDataFrame(rows, "gold string, pred string").withColumn("k", F.lit(1))
    r = M.metrics(df, ["k"], L.LABELS["plausibility"]).first()
    assert (r.N, round(r.ACC, 6), round(r.P_macro, 6), round(r.R_macro, 6), round(r.F1_macro, 6)) == (116, 0.913793, 0.955166, 0.913793, 0.933851)
    assert (round(r.ACC_PLAUSIBLE, 6), round(r.ACC_IMPLAUSIBLE, 6)) == (0.931034, 0.896552)
    low = M.metrics(df, ["k"], ["plausible", "implausible"]).first()
    assert round(low.ACC, 6) == 0.913793 and low.P_macro == low.F1_macro == 0 and low.ACC_PLAUSIBLE is None


PUBLISHED = [
    ("plausibility", [("PLAUSIBLE", "PLAUSIBLE", 38), ("PLAUSIBLE", "IMPLAUSIBLE", 2), ("IMPLAUSIBLE", "IMPLAUSIBLE", 38), ("IMPLAUSIBLE", "IMPLAUSIBLE\nWHY", 2)], (80, 0.95, 0.975, 0.95, 0.962179)),
    ("consistency", [("CONSISTENT", "INCONSISTENT", 58), ("INCONSISTENT", "INCONSISTENT", 58)], (116, 0.5, 0.25, 0.5, 0.333333)),
    ("consistency", [("CONSISTENT", "INCONSISTENT", 40), ("INCONSISTENT", "INCONSISTENT", 40)], (80, 0.5, 0.25, 0.5, 0.333333)),
]


@pytest.mark.parametrize("task, cells, want", PUBLISHED)
def test_published_rows(spark, task, cells, want):
    df = spark.createDataFrame([(g, p, 1) for g, p, n in cells for _ in range(n)], "gold string, pred string, k int")
    r = M.metrics(df, ["k"], L.LABELS[task]).first()
    assert (r.N, *[round(r[c], 6) for c in ("ACC", "P_macro", "R_macro", "F1_macro")]) == want


def test_published_observed_labels(spark):
    """206 answers with two labels that only answers show: the macro is over four, and each has a column."""
    cells = [("CONSISTENT", "INCONSISTENT", 101), ("CONSISTENT", "CONFORMS", 1), ("CONSISTENT", "CON SENSENT", 1), ("INCONSISTENT", "INCONSISTENT", 103)]
    r = M.metrics_observed(spark.createDataFrame([(g, p, "m") for g, p, n in cells for _ in range(n)], "gold string, pred string, alm string"), ["alm"]).first()
    assert (r.N, r.ACC, round(r.P_macro, 6), r.R_macro, round(r.F1_macro, 6)) == (206, 0.5, 0.126225, 0.25, 0.167752)
    assert (r.ACC_CONSISTENT, r.ACC_INCONSISTENT, r.ACC_CONFORMS, r.ACC_CON_SENSENT) == (0.0, 1.0, None, None)


def test_published_icl_identity(spark):
    """A row of the sweep: 103 right of 300, 11 unparseable."""
    cells = [("ENTAILMENT", "ENTAILMENT", 3), ("ENTAILMENT", "NEUTRAL", 93), ("ENTAILMENT", "unparseable", 4), ("NEUTRAL", "NEUTRAL", 99), ("NEUTRAL", "unparseable", 1), ("CONTRADICTION", "CONTRADICTION", 1), ("CONTRADICTION", "NEUTRAL", 93), ("CONTRADICTION", "unparseable", 6)]
    df = spark.createDataFrame([(g, p, "audio_only") for g, p, n in cells for _ in range(n)], "gold string, pred string, variant string")
    r = M.pooled(df, [["variant"]], L.LABELS["nli"]).first()
    assert (r.N, r.EACC, r.NACC, r.CACC) == (300, 0.03, 0.99, 0.01)
    assert r.ACC == pytest.approx(0.3433333333333333) and r.R_macro == pytest.approx(r.ACC) and r.unparseable_rate == pytest.approx(0.03666666666666667)
    assert r.parseable_ACC == pytest.approx(0.356401384083045) == r.ACC / (1 - r.unparseable_rate)


def test_null_policies(spark):
    df = spark.createDataFrame([("A", "A"), ("A", None), (None, "A")], "gold string, pred string").withColumn("k", F.lit(1))
    assert M.metrics(df, ["k"]).first().N == 1
    assert M.metrics(df.filter("gold is not null"), ["k"], policy="failed").first().ACC == 0.5


def brute_auroc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None


@pytest.mark.parametrize("seed", range(4))
def test_sweeps(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.random() * 6) / 2, rng.random() < 0.4) for _ in range(40)]
    counts = C.score_counts(spark.createDataFrame([(1, s, y) for s, y in rows], "run int, score double, is_pos boolean"), ["run"])
    assert C.auroc(counts, ["run"]).first().auroc == pytest.approx(brute_auroc(rows))
    vals = sorted({s for s, _ in rows})
    cands = [vals[0] - 1e-6, *[(a + b) / 2 for a, b in zip(vals, vals[1:])], vals[-1] + 1e-6]

    def f1(t):
        tp, fp = sum(y and s >= t for s, y in rows), sum(not y and s >= t for s, y in rows)
        fn, tn = sum(y for _, y in rows) - tp, sum(not y for _, y in rows) - fp
        return (2 * tp / max(1, 2 * tp + fp + fn) + 2 * tn / max(1, 2 * tn + fp + fn)) / 2

    best = max(cands, key=lambda t: (round(f1(t), 12), -t))
    got = C.best_threshold(counts, ["run"]).first()
    assert got.threshold == pytest.approx(best) and got.macro_f1 == pytest.approx(f1(best))
    df = spark.createDataFrame([(1, s, y) for s, y in rows], "run int, margin double, correct boolean")
    kept = {t: [y for s, y in rows if s >= t] for t in cands}
    best = max((t for t in cands if len(kept[t]) >= 0.8 * len(rows)), key=lambda t: (round(sum(kept[t]) / len(kept[t]), 12), -t))
    assert C.selective(df, ["run"]).first().threshold == pytest.approx(best)


def test_one_class_has_no_auroc(spark):
    counts = C.score_counts(spark.createDataFrame([(1, 0.5, True)], "run int, score double, is_pos boolean"), ["run"])
    assert C.auroc(counts, ["run"]).first().auroc is None


def test_large_running_totals(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("n"))
    got = {r.x: r.n_before for r in partitions.prefix_by_partition(df, "x", ["n"], buckets=9).collect()}
    assert all(got[float(k)] == sum(j % 7 for j in range(k)) for k in range(0, 1000, 37))


def test_audit_skips_empty_maps(spark):
    rows = [("m", "TRUE", {}), ("m", "TRUE", {"TRUE": 0.5, "FALSE": 0.5}), ("m", "FALSE", {"TRUE": 0.9, "FALSE": 0.1}), ("m", "FALSE", {"TRUE": 0.1})]
    r = C.audit(spark.createDataFrame(rows, "run string, gold string, scores map<string,double>"), ["run"]).first()
    assert (r.n, r.type, r.baseline_accuracy) == (2, "binary", 0.0)


def test_joins(spark):
    df = spark.createDataFrame([("i1", "f1", "h1", None), ("i9", "f2", "h2", None), ("i8", "f9", "h3", None), ("i7", "", "h3", None), ("i6", "f", "h", "easy")], "item_id string, file_name string, hypothesis string, difficulty string")
    mapping = spark.createDataFrame([("i1", "x", "x", "easy", 1), ("q", "f2", "h2", "hard", 2), ("q", "z", "h3", "medium", 3), ("q", "y", "h3", "hard", 4)], "item_id string, file_name string, hypothesis string, difficulty string, o int")
    got = {r.item_id: r.difficulty for r in E.join_difficulty(df, mapping, "o").collect()}
    assert got == {"i1": "easy", "i9": "hard", "i8": "medium", "i7": "unknown", "i6": "easy"}
    fixed = E.repair_gold(df.withColumn("gold", F.lit("G")), mapping.withColumn("gold", F.col("difficulty")), "o")
    assert {r.item_id: r.gold for r in fixed.collect()}["i8"] == "hard"
    with pytest.raises(ValueError, match="a, b"):
        E.require_columns(df, ["b", "a", "item_id"])


def test_exemplars_and_prefix(spark):
    rows = [(f"f{k}", f"h{k}", ["ENTAILMENT", "NEUTRAL"][k % 2] if k < 8 else "CONTRADICTION", "t") for k in range(9)]
    df = spark.createDataFrame(rows, "file_name string, hypothesis string, answer string, transcript string")
    chosen = P.pick_exemplars(df.union(df), 7, 1)
    assert [c["answer"] for c in chosen[:4]] == ["ENTAILMENT", "NEUTRAL", "CONTRADICTION", "ENTAILMENT"]
    assert len({c["hypothesis"] for c in chosen}) == 7
    with pytest.raises(ValueError):
        P.pick_exemplars(df, 10, 1)
    text = P.icl_prefix(chosen, 2, False, True)
    assert text.count("Example") - text.count("Example ") == 0 and "AudioFile, Hypothesis, and gold Answer label" in text and "Transcript:" not in text
    out = P.icl_fan_out(df, chosen, [1, 3])
    assert out.count() == 9 * 2 * 3
    assert out.filter(L.strip_icl_prefix(F.col("prompt")) != F.col("hypothesis")).count() == 0


def test_fill_keeps_braces(spark):
    df = spark.createDataFrame([("{hypothesis}", "h")], "t string, h string")
    assert "Transcript:\n{hypothesis}\n" in df.select(P.classification_prompt("nli", F.col("t"), F.col("h"))).first()[0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / math.sqrt(2), 0.0])


def test_wer_and_model_hook(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", None)], "r string, h string").withColumn("k", F.lit(1))
    r = W.word_error_rate(df, ["k"], "r", "h").first()
    assert (r.edits, r.words) == (2, 3)

    def init():
        asked = []

        def model(p):
            asked.append(p)
            if p == "bad":
                raise ValueError("no")
            return "" if asked.count(p) < 2 else p.upper()

        return model

    got = {x.prompt: (x.pred_raw, x.error, x.retry_count) for x in W.run_model(spark.createDataFrame([("a",), ("bad",)], "prompt string").coalesce(1), init).collect()}
    assert got == {"a": ("A", None, 1), "bad": (None, "ValueError: no", 0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    a, b = Q.QUERIES[name](spark, SF).toPandas(), con.sql(Q.ORACLE[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def plain(df):
        return sorted((tuple("~" if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "item") else v for v in r) for r in df[cols].itertuples(index=False)), key=str)

    assert plain(a) == plain(b)


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_named_clips(spark):
    rows = [(5, None, "t"), (1, "a", ""), (3, " ", None), (9, "", "u"), (7, "b", " v ")]
    got = {r.k: r.file_name for r in H.named_clips(spark.createDataFrame(rows, "k int, file_name string, transcript string"), "k").collect()}
    assert got == {5: "row_3.wav", 9: "row_5.wav", 7: "b"}
    assert H.named_clips(spark.createDataFrame([], "k int, file_name string, transcript string"), "k").count() == 0


def test_scores_of_own_and_shared_labels(spark, monkeypatch):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "i int, e array<float>")
    t = spark.createDataFrame([(1, "a", [1.0, 1.0]), (1, "b", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (2, "c", [0.0, 1.0])], "i int, l string, v array<float>")
    got = {r.i: (r.pred, round(r.top1, 6)) for r in V.score_pairs(e, t, "i", "e", "l", "v").collect()}
    assert got == {1: ("b", 1.0), 2: ("a", 1.0)}
    shared = t.filter("i = 1").drop("i")
    assert {r.i: r.pred for r in V.score_labels(e.filter("e is not null"), shared, "i", "e", "l", "v").collect()} == {1: "b", 2: "a"}
    monkeypatch.setattr(V, "MAX_LABELS", 1)
    with pytest.raises(Exception, match="more than 1 labels"):
        V.score_labels(e, shared, "i", "e", "l", "v").collect()


def test_overlay_output(spark):
    df = spark.createDataFrame([('{"entailment": ["x", {"hypothesis": "y"}], "neutral": "z"}',), ('{"neutral": null}',)], "o string")
    got = [r[0].asDict() for r in df.select(P.overlay_output(F.parse_json("o"), F.lit("p "))).collect()]
    assert got == [{"entailment": ["p x", "p y"], "neutral": ["p z"], "contradiction": []}, {"entailment": [], "neutral": [], "contradiction": []}]


def test_icl_fan_out_query_brute(spark, tmp_path):
    """Whole texts, also those that share a long beginning, in every prompt and target."""
    import hashlib

    from gradeloom.plans.queries import QUERIES

    same = "The same beginning of all, " * 12
    texts = [f"{same}{k} end {'x ' * k}." for k in range(14)]
    spark.createDataFrame([(k, t, "web") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 == 1), int(k % 3 == 2)) for k in range(13)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [{"file_name": f"web/{k}.wav", "hypothesis": texts[k], "answer": ["NEUTRAL", "ENTAILMENT", "CONTRADICTION"][k % 3], "transcript": texts[k]} for k in range(13)]
    chosen = P.pick_exemplars(spark.createDataFrame(rows, "file_name string, hypothesis string, answer string, transcript string"), 10, 7)
    want = set()
    for r in rows:
        for variant, (transcript, hypothesis) in P.VARIANTS.items():
            for shot in (1, 3, 5, 7, 10):
                lines = ["", f"Target AudioFile: {r['file_name'][4:]}", *([f"Target Transcript: {r['transcript']}"] if transcript else []), f"Target Hypothesis: {r['hypothesis']}", "Answer:"]
                prompt = P.icl_prefix(chosen, shot, transcript, hypothesis) + "\n".join(lines)
                want.add((r["file_name"], variant, shot, hashlib.md5(prompt.encode()).hexdigest(), r["hypothesis"]))
    got = [tuple(r) for r in QUERIES["icl_fan_out"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_targets_of_long_prompts(spark):
    """The target behind a prompt of examples, found in one pass: no place is counted in characters from its start."""
    cases = {"Target Hypothesis: a\nAnswer:": "a", "é" * 9 + "Target Hypothesis: b\nTarget Hypothesis: c\nAnswer: x\nAnswer:": "b\nTarget Hypothesis: c", "Target Hypothesis:": "Target Hypothesis:", "\nAnswer: Target Hypothesis: d": "\nAnswer: Target Hypothesis: d".strip(), "Target Hypothesis:\nAnswer:": "", "": "", None: ""}
    out = spark.createDataFrame([(p,) for p in cases], "p string").select("p", L.strip_icl_prefix(F.col("p")).alias("t"))
    assert {r.p: r.t for r in out.collect()} == cases
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "instr(" not in plan and plan.count("Target Hypothesis:") == 1
