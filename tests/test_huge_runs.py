"""Sweeps over one run that holds nearly all rows: parts of even size, figures as without parts, and one scan of the input."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import calibration as C
from gradeloom.operators import partitions


def skewed(spark, n=20_000):
    """Nine tenths of the scores lie within a thousandth of the range."""
    rng = random.Random(4)
    rows = [("big", 0.5 + rng.random() / 1000 if rng.random() < 0.9 else rng.random(), rng.random() < 0.4) for _ in range(n)]
    rows += [(rng.choice(["small", None]), round(rng.random(), 2), rng.random() < 0.5) for _ in range(200)] + [("one", 0.5, True)]
    return spark.createDataFrame(rows, "run string, score double, is_pos boolean")


@pytest.mark.parametrize("buckets", [2, 30, 64])
def test_parts_are_even(spark, buckets):
    counts = C.score_counts(skewed(spark), ["run"])
    placed = partitions.with_parts(counts, ["run"], "score", buckets)
    sizes = [r["count"] for r in placed.filter("run = 'big'").groupBy("_b").count().collect()]
    assert len(sizes) == buckets and max(sizes) <= 2 * sum(sizes) / len(sizes)
    # The window finds rows dealt out by run and part, not by run alone.
    plan = partitions.in_order(counts, ["run"], "score", ["n_pos"], buckets)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Exchange hashpartitioning(run" in line and "REPARTITION" in line]
    assert windows and all("_b#" in line for line in windows)


@pytest.mark.parametrize("buckets", [1, 16, 300])
def test_figures_as_without_parts(spark, buckets):
    df = skewed(spark, 3_000)
    counts = C.score_counts(df, ["run"])
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(C.best_threshold(counts, ["run"]), C.best_threshold(counts, ["run"], buckets=buckets))
    margins = df.withColumnsRenamed({"score": "margin", "is_pos": "correct"})
    assert same(C.selective(margins, ["run"]), C.selective(margins, ["run"], buckets=buckets))
    assert same(C.selective(margins, []), C.selective(margins, [], buckets=buckets))


def maps(spark):
    rng = random.Random(5)
    rows = []
    for k in range(600):
        x = round(rng.random(), 2)
        scores = {"TRUE": x, "FALSE": round(1 - x, 2)} if k % 3 else {"A": x, "B": round(rng.random(), 2), "C": 0.5}
        rows.append(("two" if k % 3 else "three", rng.choice(["TRUE", "FALSE"]) if k % 3 else rng.choice("ABCD"), scores if k % 50 else None))
    return spark.createDataFrame([*rows, (None, "TRUE", {})], "run string, gold string, scores map<string,double>")


def test_audit_in_parts(spark):
    whole, parts = (C.audit(maps(spark), ["run"], buckets=b).orderBy("run").collect() for b in (None, 8))
    assert [r.run for r in whole] == ["three", "two"]
    for a, b in zip(whole, parts, strict=True):
        a, b = a.asDict(), b.asDict()
        assert a.keys() == b.keys()
        for k, v in a.items():
            assert b[k] == (pytest.approx(v) if isinstance(v, float) else v), k


def test_audit_reads_the_input_once(spark, tmp_path):
    """The input's files are opened for one stored copy; no figure goes back to them."""
    maps(spark).write.parquet(f"{tmp_path}/in")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        reads.add(1)
        return True

    df = spark.read.parquet(f"{tmp_path}/in").filter(seen.asNondeterministic()("gold"))
    out = C.audit(df, ["run"])
    assert len(out.collect()) == 2 and str(tmp_path) not in out._jdf.queryExecution().executedPlan().toString()
    assert reads.value == 601


def test_audit_of_nothing(spark):
    assert C.audit(maps(spark).limit(0), ["run"]).collect() == []
