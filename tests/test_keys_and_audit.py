"""Null keys, very large counts, huge runs, audits, overlays and edit distances."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import labels as L
from gradeloom.operators import calibration, enrich, hypotheses, metrics, prompts, transcripts
from gradeloom.operators.keys import join_on


def test_strip_icl_prefix(spark):
    cases = {
        "no marker ": "no marker",
        "x Target Hypothesis: H \nAnswer:": "H",
        " x Target Hypothesis: H, and no end ": "x Target Hypothesis: H, and no end",
        "Target Hypothesis: A\nAnswer: B Target Hypothesis: C\nAnswer:": "A",
        "Answer first\nAnswer: Target Hypothesis: H": "Answer first\nAnswer: Target Hypothesis: H",
        "": "",
        None: "",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert {r.t: r.got for r in df.select("t", L.strip_icl_prefix(F.col("t")).alias("got")).collect()} == cases


def test_null_keys_are_groups(spark):
    rows = [("a", "x", "x"), ("a", "x", "y"), (None, "x", "x"), (None, "y", "unparseable")]
    df = spark.createDataFrame(rows, "k string, gold string, pred string")
    got = {r.k: (r.N, r.ACC, r.unparseable_rate) for r in metrics.pooled(df, [["k"]], ["x", "y"]).collect()}
    assert got == {"a": (2, 0.5, 0.0), None: (2, 0.5, 0.5)}
    left, right = df.select("k").distinct(), df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert {r.k: r.n for r in join_on(left, right, ["k"]).collect()} == {"a": 2, None: 2}
    scored = spark.createDataFrame([(None, "TRUE", {"TRUE": 0.9, "FALSE": 0.1}), (None, "FALSE", {"TRUE": 0.4, "FALSE": 0.6}), ("b", "TRUE", {"TRUE": 0.2, "FALSE": 0.1})], "run string, gold string, scores map<string,double>")
    audited = {r.run: r for r in calibration.audit(scored, ["run"]).collect()}
    assert audited[None].auroc == 1.0 and audited[None].n == 2 and audited["b"].auroc is None


def test_counts_beyond_whole_numbers(spark):
    counts = spark.createDataFrame([("r", 0.1, 0, 4_000_000_000), ("r", 0.9, 4_000_000_000, 0)], "run string, score double, n_pos long, n_neg long")
    assert calibration.auroc(counts, ["run"]).first().auroc == 1.0


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_a_huge_run_in_parts(spark, buckets):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), round(rng.random() ** 4, 3), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(400)]
    counts = spark.createDataFrame(rows, "run string, score double, n_pos long, n_neg long").groupBy("run", "score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    for f in (calibration.thresholds, calibration.auroc):
        whole, parts = f(counts, ["run"]), f(counts, ["run"], buckets=buckets)
        assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_audit_counts_what_it_leaves_out(spark):
    rows = [("TRUE", {"TRUE": 0.9, "FALSE": 0.1}), ("false", {"TRUE": 0.8, "FALSE": 0.2}), ("TRUE", {}), ("TRUE", {"TRUE": 0.5, "FALSE": None}), ("MAYBE", {"TRUE": 0.5, "FALSE": 0.1}), ("FALSE", {"TRUE": 0.3, "FALSE": 0.4})]
    r = calibration.audit(spark.createDataFrame([("r", g, s) for g, s in rows], "run string, gold string, scores map<string,double>"), ["run"]).first()
    assert (r.n, r.n_skipped) == (3, 3)
    assert r.baseline_accuracy == pytest.approx(2 / 3) and r.baseline_balanced_accuracy == pytest.approx(0.75)
    assert r.baseline_macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 2)
    assert r.threshold_best_accuracy == 1.0
    gain = calibration.calibration_gain(calibration.audit(spark.createDataFrame([("r", g, s) for g, s in rows], "run string, gold string, scores map<string,double>"), ["run"]), []).first()
    assert gain.accuracy_gain == pytest.approx(1 / 3) and gain.macro_f1_gain == pytest.approx(1 / 3)


def test_clips_without_a_name_need_an_id(spark):
    df = spark.createDataFrame([(1, "", '{"entailment": "x"}'), (2, None, '{"entailment": "y"}')], "id long, file_name string, j string").withColumn("output", F.parse_json("j"))
    ids = [r.item_id for r in hypotheses.explode_hypotheses(df, "nli", row_id="id").select("item_id").collect()]
    assert ids == ["row1__hyp_0", "row2__hyp_0"]
    with pytest.raises(Exception, match="row_id"):
        hypotheses.explode_hypotheses(df, "nli").select("item_id").collect()


def test_transcripts_keep_errors(spark):
    rows = spark.createDataFrame([("a.wav", "timeout", "X"), ("b.wav", None, "Y"), ("c.wav", None, "Z")], "file_name string, error string, pred string")
    asr = spark.createDataFrame([("a.wav", "said", 1), ("c.wav", "heard", 2)], "file_name string, asr_text string, o int")
    got = {r.file_name: (r.transcript, r.error, r.pred) for r in enrich.join_transcripts(rows, asr, "o").collect()}
    assert got == {"a.wav": ("said", "timeout", "X"), "b.wav": (None, "ASR transcript not found for file_name", None), "c.wav": ("heard", None, "Z")}


def test_unmatched_samples(spark):
    rows = spark.createDataFrame([(k, f"h{k} " + "x" * 200, "NO") for k in range(9)], "id long, hypothesis string, gold string")
    fixed = enrich.repair_gold(rows, rows.filter("id = 0"), "id")
    got = enrich.unmatched_samples(fixed, "id").collect()
    assert [r.id for r in got] == [1, 2, 3, 4, 5] and all(len(r.sample) == 80 for r in got)


def test_overlay_of_odd_records(spark):
    rows = spark.createDataFrame([(1, '{"file_name": "d/a.wav", "transcript": " t ", "output": {"entailment": ["h", {"hypothesis": "i"}], "neutral": null}}'), (2, '{"output": "text"}'), (3, "{}"), (4, '{"output": [1]}')], "id long, j string").withColumn("r", F.parse_json("j"))
    got = {x.id: x.o for x in rows.select("id", prompts.overlay_record(F.col("r"), F.lit("P\n"), "audio_hypothesis", 3, 10).alias("o")).collect()}
    assert got[1].output.entailment == [f"P\nTarget AudioFile: a.wav\nTarget Hypothesis: {h}\nAnswer:" for h in "hi"]
    assert got[1].output.neutral == [] and got[1].icl_overlay.num_shots == 3 and not got[1].icl_overlay.include_target_transcript
    assert all(got[k].output is None and got[k].icl_overlay is None for k in (2, 3, 4))


def test_word_edits(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for _ in range(80)] + [(None, "a b"), ("", ""), ("a", None)]

    def brute(x, y):
        x, y = (x or "").split(), (y or "").split()
        table = [[max(i, j) if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
        return table[-1][-1]

    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.e == brute(r.a, r.b) for r in df.select("a", "b", transcripts.word_edits(F.col("a"), F.col("b")).alias("e")).collect())
