"""Alignments, sinks, listings, manifests, templates, column names, ranks and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import labels as L
from gradeloom.functions import templates as G
from gradeloom.operators import enrich, partitions
from gradeloom.operators import metrics as M
from gradeloom.operators import transcripts as W
from gradeloom.sources import records as R
from gradeloom.sources import sinks


def brute_kinds(x, y):
    """Fewest edits, then most hits, from the full table."""
    best = [[None] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            options = [(0, 0, 0, 0, 0)] if i == j == 0 else []
            if i:
                e, h, s, d, n = best[i - 1][j]
                options.append((e + 1, h, s, d + 1, n))
            if j:
                e, h, s, d, n = best[i][j - 1]
                options.append((e + 1, h, s, d, n + 1))
            if i and j:
                e, h, s, d, n = best[i - 1][j - 1]
                options.append((e, h - 1, s, d, n) if x[i - 1] == y[j - 1] else (e + 1, h, s + 1, d, n))
            best[i][j] = min(options)
    _, h, s, d, n = best[-1][-1]
    return -h, s, d, n


def transcripts():
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["a", "B", "c", "é"]) for _ in range(rng.randint(0, 14)))
    return [(text(), text()) for _ in range(120)] + [(None, "a b"), ("", ""), ("a", None), (None, None), ("A b", "a B"), (" a\tb ", "b a")]


def test_kinds_of_edits_and_alignments(spark):
    df = spark.createDataFrame(transcripts(), "r string, h string")
    rows = df.select("r", "h", W.word_edit_kinds(F.col("r"), F.col("h")).alias("k"), W.word_edits(F.col("r"), F.col("h")).alias("e"), W.word_alignment(F.col("r"), F.col("h")).alias("a")).collect()
    for r in rows:
        x, y = (r.r or "").lower().split(), (r.h or "").lower().split()
        assert tuple(r.k) == brute_kinds(x, y) and r.k.substitutions + r.k.deletions + r.k.insertions == r.e
        assert [s.reference for s in r.a if s.reference is not None] == x and [s.heard for s in r.a if s.heard is not None] == y
        names = {"hits": "hit", "substitutions": "substitution", "deletions": "deletion", "insertions": "insertion"}
        assert {n: sum(s.kind == k for s in r.a) for n, k in names.items()} == r.k.asDict()
        assert all((s.reference == s.heard) == (s.kind == "hit") for s in r.a)


def test_long_alignments_take_rows_of_memory():
    import tracemalloc

    rng = random.Random(2)
    x = [rng.choice("abcdefgh") for _ in range(3_000)]
    y = [w for w in x if rng.random() > 0.1]
    tracemalloc.start()
    steps = W.align(" ".join(x), " ".join(y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and sum(k == "hit" for k, _, _ in steps) == W.count_kinds(" ".join(x), " ".join(y))[0] == len(y)


def test_error_kinds_and_the_table_of_four(spark):
    rows = [("m", "a b c", "a b c", "X", "X"), ("m", "a b c", "a x", "X", "Y"), ("m", "a b", None, "X", "X"), ("n", "", "", "X", None), ("n", None, "z", None, None), (None, "a", "A", "X", "X")]
    df = spark.createDataFrame(rows, "model string, said string, heard string, gold string, pred string")
    got = {r.model: r.asDict() for r in W.error_kinds(df, ["model"], "said", "heard").collect()}
    assert got["m"] == {"model": "m", "hits": 4, "substitutions": 1, "deletions": 3, "insertions": 0, "words": 8, "wer": 0.5}
    assert got["n"]["wer"] is None and got["n"]["insertions"] == 1 and got[None]["wer"] == 0.0
    cells = {(r.model, r.asr_ok, r.nli_ok): (r.n, r.share) for r in W.asr_by_nli(df, ["model"], "said", "heard").collect()}
    assert len(cells) == 12 and cells["m", True, True] == (1, 1.0) and cells["m", False, False] == (1, 0.5) == cells["m", False, True]
    assert cells["n", True, False] == (1, 1.0) and cells["n", False, False] == (1, 1.0) and cells[None, False, True] == (0, None)
    loose = {(r.model, r.asr_ok): r.n for r in W.asr_by_nli(df, ["model"], "said", "heard", most_wer=0.7).filter("nli_ok").collect()}
    assert loose["m", True] == 1 and loose["m", False] == 1
    assert W.error_kinds(df.limit(0), ["model"], "said", "heard").collect() == [] == W.asr_by_nli(df.limit(0), ["model"], "said", "heard").collect()


ODD = ["Ünïcödé, \"quoted\"", "two\nlines\n\nand \\ more", " blanks \t", "", None, "𝄞😀", "a,b;c|d", "null", "NaN", '"', '""', "\\", "x\\\"y", "back\\nslash"]


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_one_file_per_task_byte_for_byte(spark, tmp_path, kind):
    rows = [(k, t, task) for task in ("nli", "a b", "a_b", "A_B", "é/über", "", None, "_.x") for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "k int, text string, task string").repartition(5)
    path = f"{tmp_path}/out"
    for _ in range(2):  # the second call takes the place of the first
        files = {r.name: (r.file, r.n_rows) for r in sinks.write_files(df, path, kind, order=["k"]).collect()}
    assert set(files) == {"nli", "a b", "a_b", "A_B", "é/über", "_null", "_.x"} and {n for _, n in files.values()} == {len(ODD), 2 * len(ODD)}
    ending = sinks.ENDINGS[kind]
    assert len({f.lower() for f, _ in files.values()}) == 7 and files["é/über"][0] == f"é/über.{ending}"
    there = sorted(str(p.relative_to(f"{tmp_path}/out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert there == sorted([*[f for f, _ in files.values()], "_SUCCESS"]) and [p.name for p in tmp_path.iterdir()] == ["out"]
    schema = "k int, text string, task string"
    for name, (file, n) in files.items():
        read = spark.read.schema(schema).options(**(sinks.CSV_READ if kind == "csv" else {})).format(kind).load(f"{path}/{file}")
        got = [(r.k, r.text) for r in read.collect()]
        want = [(k, t) for k, t in enumerate(ODD) for _ in range(2 if name == "_null" else 1)]
        assert len(got) == n and got == want, name


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "task string, x int")
    sinks.write_files(df, f"{tmp_path}/out", "json")
    broken = df.withColumn("x", F.when(F.col("task") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(broken, f"{tmp_path}/out", "json")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["_SUCCESS", "a.jsonl", "b.jsonl"]
    sinks.write_files(df.limit(0), f"{tmp_path}/none", "json")
    assert [p.name for p in (tmp_path / "none").iterdir() if not p.name.startswith(".")] == ["_SUCCESS"]


def test_listing_and_inventory(spark, tmp_path):
    texts = [("x/a.wav", "one"), ("x/b.flac", "two"), ("y/b.mp3", "three"), ("y/c.ogg", "four"), ("c.wav.bak", "five")]
    sinks.write_files(spark.createDataFrame(texts, "name string, line string"), f"{tmp_path}/clips", "text", "name", ending="")
    files = sinks.list_files(spark, f"{tmp_path}/clips")
    listed = {r.path.rsplit("/", 1)[1]: r.size for r in files.collect()}
    assert listed == {"a.wav": 4, "b.flac": 4, "b.mp3": 6, "c.ogg": 5, "c.wav.bak": 5}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    assert [r.path.rsplit("/", 1)[1] for r in sinks.list_files(spark, f"{tmp_path}/clips", "*.mp3").collect()] == ["b.mp3"]
    asked = spark.createDataFrame([(n,) for n in ("a", "a.wav", "b", "b.mp3", "data/x/b", "Audio/c.ogg", "c", "d", None, "")], "file_name string")
    got = {r.file_name: (r.audio_path.rsplit("/", 1)[1] if r.audio_path else None, r.found, r.size) for r in enrich.file_report(asked, files).collect()}
    assert got == {"a": ("a.wav", True, 4), "a.wav": ("a.wav", True, 4), "b": ("b.flac", True, 4), "b.mp3": ("b.mp3", True, 6), "data/x/b": ("b.flac", True, 4), "Audio/c.ogg": ("c.ogg", True, 5), "c": (None, False, None), "d": (None, False, None), None: (None, False, None), "": (None, False, None)}


def test_prefixes_of_paths(spark):
    cases = {"data/a.wav": "a.wav", "/data/x/a.wav": "x/a.wav", "Audio/a": "a", "data/Audio/a": "a", "Audio/data/a": "data/a", "mydata/a": "mydata/a", None: None, "": ""}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert {r.p: r.got for r in df.select("p", L.strip_prefixes(F.col("p")).alias("got")).collect()} == cases


def test_manifest(spark, tmp_path):
    rows = [("v1", 1, "m1", k) for k in range(3)] + [("v1", 1, "m2", 0), ("v2", 5, "m1", 0)]
    df = spark.createDataFrame(rows, "variant string, shot int, model string, k int").withColumn("tree", F.concat_ws("/", F.concat(F.lit("variant="), "variant"), F.concat(F.lit("shot="), "shot"), "model"))
    sinks.write_files(df.select("k", "tree"), f"{tmp_path}/out", "parquet", "tree")
    got = {(r.variant, r.shot): r.asDict() for r in sinks.manifest_of(spark.read.parquet(f"{tmp_path}/out"), ["variant", "shot"], sources=["a", "b"], seed=7).collect()}
    assert got["v1", 1] == {"variant": "v1", "shot": 1, "n_records": 4, "n_files": 2, "files": ["m1.parquet", "m2.parquet"], "sources": ["a", "b"], "seed": 7}
    assert got["v2", 5]["files"] == ["m1.parquet"]


def test_column_names():
    assert M.column_names(["a b", "a_b", "A-B", None, "null", "é"]) == {"A-B": "ACC_A_B", "a b": "ACC_A_B_2", "a_b": "ACC_A_B_3", "null": "ACC_NULL", "é": "ACC_É", None: "ACC_NULL_2"}
    assert M.column_names(["a b"], prefix="", upper=False) == {"a b": "a_b"}


def test_observed_labels_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("k", "a.b", "a.b"), ("k", "a b", "x"), ("j", "a b", "a b"), ("j", None, "a b")], "k string, gold string, pred string")
    got = {r.k: r.asDict() for r in M.metrics_observed(df, ["k"]).collect()}
    assert got["k"]["ACC_A_B"] == 0.0 and got["k"]["ACC_A_B_2"] == 1.0 and got["j"]["ACC_A_B_2"] is None and got["j"]["N"] == 1
    assert M.metrics_observed(df, ["k"], absent=0.0).filter("k = 'j'").first().ACC_A_B_2 == 0.0
    assert M.metrics_observed(df.limit(0), ["k"]).collect() == []
    monkeypatch.setattr(M, "MOST_LABELS", 1)
    with pytest.raises(ValueError, match="labels"):
        M.metrics_observed(df, ["k"])


def test_rank(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "easy", "medium", "hard"]), round(rng.random(), 1)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, difficulty string, score double").repartition(7)
    place = F.array_position(F.array(*[F.lit(d) for d in L.DIFFICULTIES]), F.col("difficulty"))
    ranked = partitions.with_rank(df, F.nullif(place, F.lit(0)).asc_nulls_last(), F.col("score").desc(), F.col("id"))
    want = sorted(rows, key=lambda r: (["easy", "medium", "hard", None].index(r[1]), -r[2], r[0]))
    assert [r.id for r in ranked.orderBy("rank").collect()] == [r[0] for r in want] and [r["rank"] for r in ranked.orderBy("rank").collect()] == [*range(1, 501)]
    assert "SinglePartition" not in "".join(line for line in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "difficulty" in line)
    assert partitions.with_rank(df.limit(0), F.col("id")).collect() == []


def test_sketches_stored_and_united(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 20_011).alias("x"))
    M.distinct_sketches(df, ["part"], "x").write.parquet(f"{tmp_path}/s")
    M.distinct_sketches(df.limit(100), ["part"], "x").write.mode("append").parquet(f"{tmp_path}/s")
    estimate = M.united_distinct(spark.read.parquet(f"{tmp_path}/s"), []).first().estimate
    assert abs(estimate - 20_011) <= 3 * 1.04 / 64 * 20_011


def test_templates(spark):
    assert len({(d, t) for d, t, _ in G.TEMPLATES}) == 14
    for _, text in G.TEMPLATES.values():
        parts = G.parse_slots(text)
        assert [s for _, s in parts if s] == ["TRANSCRIPT"] and "".join(t or "{{" + s + "}}" for t, s in parts) == text
    with pytest.raises(ValueError, match="HYPOTHESIS"):
        G.template_table(spark, {("d", "t", "multi"): ("s", "x {{HYPOTHESIS}}")})
    table = G.template_table(spark)
    rows = [("medical", "nli", "say {{TRANSCRIPT}} {x}"), ("afrispeech200", "nli", None), ("general", "plausibility", "")]
    df = spark.createDataFrame(rows, "dataset string, task string, transcript string").withColumn("prompt", F.lit("old"))
    got = {r.dataset: (r.system, r.prompt) for r in G.generation_prompts(df, table, "single").collect()}
    assert got["medical"] == (G.TEMPLATES["medical", "nli", "multi"][0], G.TEMPLATES["medical", "nli", "multi"][1].replace("{{TRANSCRIPT}}", "say {{TRANSCRIPT}} {x}"))
    assert got["afrispeech200"][1] == G.TEMPLATES["afrispeech200", "nli", "single"][1].replace("{{TRANSCRIPT}}", "")
    with pytest.raises(Exception, match="no template for data set medical and task intent"):
        G.generation_prompts(spark.createDataFrame([("medical", "intent", "x")], "dataset string, task string, transcript string"), table).collect()
    assert G.generation_prompts(df.limit(0), table).collect() == []


def test_two_compositions_in_one_session(spark):
    """Two subsets described before either is collected keep their own rows."""
    from gradeloom.operators import hypotheses

    a = spark.createDataFrame([("f", "easy", "A")], "file_name string, difficulty string, gold string")
    one, two = hypotheses.composition(a), hypotheses.composition(a.union(a))
    assert one.agg(F.max("n")).first()[0] == 1 and two.agg(F.max("n")).first()[0] == 2


def test_scanned_tree_keys(spark, tmp_path):
    df = spark.createDataFrame([("X", "whisper/llama/afri200_nli"), ("Y", "granite/llama/medical_consistency")], "gold string, tree string")
    sinks.write_files(df, f"{tmp_path}/t", "json", "tree")
    got = {(r.asr_model, r.text_llm, r.task, r.dataset, r.gold) for r in R.with_cascade_keys(R.read_predictions(spark, f"{tmp_path}/t")).collect()}
    assert got == {("whisper", "llama", "nli", "afri200", "X"), ("granite", "llama", "consistency", "medical", "Y")}


def test_each_file_has_a_task_of_its_own(spark, tmp_path):
    """No two files meet in one task: dealt by hash, several of twenty did, and were sorted to part them."""
    import pathlib

    df = spark.createDataFrame([(f"t{k}", n) for k in range(20) for n in range(k + 1)], "task string, n int")
    made, seen = sinks._name_parts, []
    sinks._name_parts = lambda s, folder, names: (seen.extend(p.name for p in pathlib.Path(folder, "parts").rglob("part-*")), made(s, folder, names))[1]
    try:
        files = sinks.write_files(df.repartition(4), f"{tmp_path}/out", "json")
    finally:
        sinks._name_parts = made
    assert sorted(int(p.split("-")[1]) for p in seen) == list(range(20))
    read = spark.read.json(f"{tmp_path}/out").groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("f"), "task").count()
    assert {(r.f, r.task, r["count"]) for r in read.collect()} == {(f"t{k}.jsonl", f"t{k}", k + 1) for k in range(20)} == {(r.file, r.name, r.n_rows) for r in files.collect()}


def test_sweep_keys_are_split_not_searched(spark):
    cases = {"r/v/m/d/shot3/p.jsonl": ("v", "m", "d", 3), "v/m/d/shot10/x": ("v", "m", "d", 10), "m/d/shot3/x": ("", "", "", None), "v//d/shot3/x": ("", "", "", None), "v/m/d/shotx/x": ("", "", "", None), "v/m/d/shot3/": ("", "", "", None), "v/m/d/shot3\n/x": ("", "", "", None), "": ("", "", "", None), None: (None, None, None, None)}
    out = R.with_sweep_keys(spark.createDataFrame([(p,) for p in cases], "path string"))
    assert {r.path: tuple(r)[1:] for r in out.collect()} == cases
    assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_equal_pairs_are_aligned_once(spark):
    """A thousand rows of three pairs: three alignments, and the figures of all rows."""
    texts = [("a b c", "a x c"), ("a b c", "a b c"), (None, "a")]
    df = spark.createDataFrame([("m", *texts[k % 3], "A", "AB"[k % 2] if k % 5 else None) for k in range(1000)], "model string, said string, heard string, gold string, pred string")
    pairs = W._pair_kinds(df, ["model"], "said", "heard").collect()
    assert sorted(r["_n"] for r in pairs) == [333, 333, 334]
    assert [tuple(r) for r in W.error_kinds(df, ["model"], "said", "heard").collect()] == [("m", 334 * 2 + 333 * 3, 334, 0, 333, 2001, 667 / 2001)]
    right = lambda k: k % 5 and k % 2 == 0
    want = {(a, b): sum((k % 3 == 1) == a and bool(right(k)) == b for k in range(1000)) for a in (True, False) for b in (True, False)}
    assert {(r.asr_ok, r.nli_ok): r.n for r in W.asr_by_nli(df, ["model"], "said", "heard").collect()} == want


@pytest.mark.parametrize("kind", ["text", "csv", "json", "parquet"])
def test_a_large_file_is_written_by_several_tasks(spark, tmp_path, monkeypatch, kind):
    """F5, F8: no task writes all of a large file of lines, and the file is as one task writes it; a Parquet file's rows come packed."""
    import pathlib

    rows = [(k, f'{t or ""} {k}', "big" if k % 7 else f"s/{k % 3}") for k, t in enumerate(ODD * 40)] + [(1000, 'a\n"copy"', "big")] * 300
    df = spark.createDataFrame(rows, "k int, text string, task string").repartition(5)
    df, order = (df.select("text", "task"), None) if kind == "text" else (df.withColumnRenamed("k", 'k,"x'), ['k,"x'])
    sinks.write_files(df, f"{tmp_path}/whole", kind, order=order)
    monkeypatch.setattr(sinks, "SHARE", 1000)
    made, seen, left = sinks._join_parts, [], []
    monkeypatch.setattr(sinks, "_join_parts", lambda s, folder, *rest: (seen.extend((p.parent.name, p.stat().st_size) for p in pathlib.Path(folder, "parts").rglob("part-*")), made(s, folder, *rest), left.extend(pathlib.Path(folder, "parts").rglob("part-*"))))
    files = sinks.write_files(df, f"{tmp_path}/shares", kind, order=order)
    assert not left  # no second copy
    there = {p.relative_to(f"{tmp_path}/whole") for p in (tmp_path / "whole").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert there == {p.relative_to(f"{tmp_path}/shares") for p in (tmp_path / "shares").rglob("*") if p.is_file() and not p.name.startswith(".")} and len(there) == 5
    assert {r.name: r.n_rows for r in files.collect()} == {r[0]: r[1] for r in df.groupBy("task").count().collect()}
    for p in there - {pathlib.Path("_SUCCESS")}:
        if kind == "parquet":
            one, other = (spark.read.parquet(f"{tmp_path}/{d}/{p}").collect() for d in ("whole", "shares"))
        else:
            one, other = ((tmp_path / d / p).read_bytes() for d in ("whole", "shares"))
            # Lines without an order may stand in any.
            one, other = (sorted(x.split(b"\n")) if kind == "text" else x for x in (one, other))
        assert one == other, p
    if kind != "parquet":
        big = [n for f, n in seen if f == "_file=0"]
        assert len(big) > 5 and max(big) < sum(big) / 4


def test_csv_is_read_in_splits(spark, tmp_path):
    """files whose texts hold line ends are read by several tasks, wherever the splits fall."""
    texts = [*ODD, "\n", "\r\n", 'a"\n"b', '\n"\n"\n', "x\n" * 60, '""\n""', "\n\n\n"]
    df = spark.createDataFrame([(k, t, task) for task in ("a", "b c") for k, t in enumerate(texts)], "k int, text string, task string")
    sinks.write_files(df.withColumnRenamed("k", "k,x"), f"{tmp_path}/out", "csv", order=["k,x"])
    want = sorted((r.k, str(r.text), r.task) for r in df.collect())
    sizes = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, batch in (("128m", 10_000), ("400", 10_000), ("90", 3)):
            for c, v in zip(sizes, (size, "1", str(batch)), strict=True):
                spark.conf.set(c, v)
            assert size == "128m" or spark.read.text(f"{tmp_path}/out").rdd.getNumPartitions() > 3
            got = sinks.read_csv(spark, f"{tmp_path}/out", "k int, text string, task string").collect()
            assert sorted((r.k, str(r.text), r.task) for r in got) == want, size
            assert {(r.task, r.file_path.rsplit("/", 1)[1]) for r in got} == {("a", "a.csv"), ("b c", "b%20c.csv")}
    finally:
        for c, v in sizes.items():
            spark.conf.set(c, v)


def test_task_files_moves_figures_not_texts(spark, monkeypatch):
    """what is joined with the files' names is one row a file; the texts were shuffled by file, all of one in one task."""
    from gradeloom.plans import report_queries

    def joined(plan):
        inputs = [plan.children().apply(k) for k in range(plan.children().size())]
        own = [x.output().mkString(",") for x in inputs] if plan.nodeName() == "Join" else []
        return own + [y for x in inputs for y in joined(x)]

    kept, found = report_queries.stored, []
    monkeypatch.setattr(report_queries, "stored", lambda df: (found.extend(joined(df._jdf.queryExecution().optimizedPlan())), kept(df))[1])
    assert report_queries.task_files(spark, "/root/testdata/sf0.001").filter("n_files <> 1").isEmpty()
    assert len(found) == 6 and not any("text#" in x for x in found)
