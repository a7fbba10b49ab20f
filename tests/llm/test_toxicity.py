"""Toxicity: descriptions and risk against brute force, held-out figures on the test tables, and odd rows."""

import math
import os
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import toxicity

SCHEMA = "doc_id long, text string, train boolean"


def make(n=900, seed=5):
    rng = random.Random(seed)
    rows, marks = [], []
    for k in range(n):
        bad = k % 6 == 0
        text = " ".join(f"w{chr(97 + min(int(rng.expovariate(0.1)), 25))}{rng.choice('xyz')}" for _ in range(40)) + (" Vile." if bad else "") + (" foulness" if bad and k % 4 else "")
        rows.append((k, text, k < 2 * n // 3))
        if k % 2 == 0:
            marks.append((k, int(bad)))
    return rows, marks


def test_held_out_rows(spark):
    rows, marks = make()
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_toxicity(df.withColumn("score", F.lit("x")), "train", labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == int(r.doc_id % 6 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got if not r.train)
    again = toxicity.score_toxicity(df.repartition(7), "train", labels).select("doc_id", "score").collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}
    # Labels of rows outside training change nothing.
    less = toxicity.score_toxicity(df, "train", labels.filter("doc_id < 600")).select("doc_id", "score").collect()
    assert {r.doc_id: r.score for r in less} == {r.doc_id: r.score for r in got}


def test_descriptions_against_brute_force(spark):
    rows, marks = make(240)
    rows += [(1000, rows[6][1], True), (6, rows[6][1], True), (None, "vile words", True), (1001, None, True), (1002, "", False)]
    marks += [(1000, 1), (1000, 0), (6, None), (7777, 1), (None, 1)]
    out, prior = toxicity.describe(spark.createDataFrame(rows, SCHEMA), "train", spark.createDataFrame(marks, "doc_id long, toxic int"))
    truth = {}
    for i, y in marks:
        if i is not None and y is not None:
            truth[i] = max(y, truth.get(i, 0))
    ids = {i for i, _, t in rows if t and i is not None}
    labelled = [truth[i] for i in ids if i in truth]
    assert prior == pytest.approx(sum(labelled) / len(labelled))
    toxic = {i for i in ids if truth.get(i) == 1}
    split = lambda t: {w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()}
    want = []
    for k, (i, text, mine) in enumerate(rows):
        others = [(j, split(t)) for m, (j, t, u) in enumerate(rows) if u and m != k]
        # The number of confirmed documents is that of ids; the document itself is left out of it.
        n_p, n_u = len(toxic) - (mine and i in toxic), len(others)
        levels = [0] * len(toxicity.STRENGTHS)
        for w in split(text):
            u = sum(w in s for _, s in others)
            p = sum(w in s for j, s in others if j in toxic)
            z = (p - u * n_p / n_u) / math.sqrt(u * n_p / n_u + toxicity.SMOOTH)
            above = sum(z >= s for s in toxicity.STRENGTHS)
            if above:
                levels[above - 1] += 1
        length = min(toxicity.LENGTHS - 1, int(math.log2(len(split(text)) + 1) // 2 + (math.log2(len(split(text)) + 1) % 2 >= 1)))
        cell = sum(min(toxicity.MOST, x) * (toxicity.MOST + 1) ** j for j, x in enumerate(levels)) * toxicity.LENGTHS + length
        want.append((-1 if i is None else i, text or "", cell, int(bool(mine and i in toxic)), int(mine)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.text or "", r._cell, r._p, r._u) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_risk_and_training():
    rng = np.random.default_rng(2)
    cells = np.arange(0, 600, 7)
    n_p, n_u, prior = rng.integers(0, 5, len(cells)).astype(float), rng.integers(1, 9, len(cells)).astype(float), 0.2
    x, w, b = toxicity.design(cells), rng.normal(size=toxicity.design(cells).shape[1]), -0.4
    plus = minus_p = minus_u = 0.0
    for k in range(len(cells)):
        s = b + sum(x[k, j] * w[j] for j in range(len(w)))
        plus += n_p[k] / n_p.sum() * math.log(1 + math.exp(-s))
        minus_p += n_p[k] / n_p.sum() * math.log(1 + math.exp(s))
        minus_u += n_u[k] / n_u.sum() * math.log(1 + math.exp(s))
    assert toxicity.risk(w, b, x, n_p, n_u, prior) == pytest.approx((prior * plus, minus_u - prior * minus_p))
    total = lambda w, b: (lambda r: r[0] + max(0.0, r[1]))(toxicity.risk(w, b, x, n_p, n_u, prior))
    fitted = toxicity.fit_nnpu(cells, n_p, n_u, prior)
    assert total(*fitted) < total(np.zeros(len(w)), math.log(prior / (1 - prior)))


def test_ties_repeats_and_empty_tables(spark):
    rows, marks = make(120)
    df, labels = spark.createDataFrame(rows + rows[:30], SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, "train", labels).collect()
    assert len(got) == 150
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by_id.values())
    assert {r.predicted for r in toxicity.score_toxicity(df, "train", labels.limit(0)).collect()} == {0}
    assert toxicity.score_toxicity(df.limit(0), "train", labels).count() == 0
    long = spark.createDataFrame([(1, "vile " * 200_000, True), (2, "é" * 100_000, True)], SCHEMA)
    assert toxicity.score_toxicity(long, "train", labels).count() == 2


@pytest.mark.parametrize("sf, recall, precision", [("sf0.01", 0.7, 0.9)])
def test_held_out_figures(spark, sf, recall, precision):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    out = toxicity.op9_toxicity(spark, path)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert len({r.score for r in held}) > 5
    assert hits >= recall * sum(r.toxic for r in held) and hits >= precision * sum(r.predicted for r in held)
