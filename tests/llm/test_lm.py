"""LM scoring: brute-force scores and gradients, the same figures on any layout, and workers without the package."""

import math
import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import lm_scoring
from gradeloom.llm.common import fold

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def texts(n=80, seed=2):
    rng = random.Random(seed)
    lexicon = [["".join(rng.choice(x) for _ in range(rng.randint(1, 5))) for _ in range(60)] for x in ("aeiou", "bcdfg", "xyzß")]
    return [(k, " ".join(rng.choice(lexicon[k % 3]) for _ in range(rng.randint(1, 60)))) for k in range(n)] + [(n, None), (n + 1, "")]


def brute_rows(group, h, rows):
    """The four feature rows of each position of one document, in whole numbers."""
    width, mask = lm_scoring.CLASSES * lm_scoring.GROUPS + 1, (1 << 64) - 1
    mix = lambda x, salt: ((((y := (x + salt) * 0x9E3779B97F4A7C15 & mask) ^ (y >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> 33
    back = lambda x, i, k: x[i - k] + 1 if i >= k else 0
    free = rows - 2 * width
    return [
        [2 * width + mix(back(h, i, 1), 1) % free, 2 * width + mix(back(group, i, 1) * width + back(group, i, 2), 1 << 41) % free, back(group, i, 2), width + back(group, i, 3)]
        for i in range(len(group))
    ]


def brute_model(rows_of_docs, share, rows):
    """seen[k][row][cell] and weight(k, row, cell) from the definition, one position at a time."""
    C, G, step = lm_scoring.CLASSES, lm_scoring.GROUPS, 40503
    cells = share.reshape(C, G)
    outer, inner = cells.sum(axis=1), cells / cells.sum(axis=1, keepdims=True)
    seen, wanted = ({}, {}), ({}, {})
    for feats, groups in rows_of_docs:
        for f, g in zip(feats, groups):
            c, i = divmod(g, G)
            for r in f:
                for k, row, cell, expected in ((0, r, c, outer), (1, (r + c * step) % rows, i, inner[c])):
                    seen[k].setdefault(row, np.zeros(C))[cell] += 1
                    wanted[k][row] = wanted[k].get(row, 0) + expected
    prior = (lm_scoring.SMOOTH * outer, lm_scoring.SMOOTH * inner.mean(axis=0))

    def weight(k, row, left_out=None):
        s, e = seen[k].get(row, np.zeros(C)).copy(), wanted[k].get(row, np.zeros(C))
        if left_out is not None:
            s[left_out] = max(0, s[left_out] - 1)
        return np.log((s + prior[k]) / (e + prior[k]))

    size = lambda k, row: min(lm_scoring.SIZES - 1, int(math.log2(seen[k][row].sum() + 1) / 2)) if row in seen[k] else 0
    return weight, size, (np.log(outer), np.log(inner))


def brute_log_prob(weight, size, bias, factors, f, g, rows, leave=False):
    C, G = lm_scoring.CLASSES, lm_scoring.GROUPS
    c, i = divmod(g, G)
    out = 0.0
    for k, z, cell in ((0, bias[0].copy(), c), (1, bias[1][c].copy(), i)):
        for t, r in enumerate(f):
            row = r if k == 0 else (r + c * 40503) % rows
            z += factors[k, t, size(k, row)] * weight(k, row, cell if leave else None)
        out += z[cell] - math.log(np.exp(z).sum())
    return out


@pytest.fixture(scope="module")
def small():
    rows, docs = 1 << 12, texts()
    toks = [lm_scoring.tokens(t) for _, t in docs]
    counts = {}
    for doc in toks:
        for t in doc:
            counts[t] = counts.get(t, 0) + 1
    head = sorted(counts, key=lambda t: (-counts[t], t))[:40]
    vocab = lm_scoring.Vocabulary([t.decode() for t in head], np.array([counts[t] for t in head]))
    from zlib import crc32

    group = lambda t: head.index(t) if t in head else lm_scoring._tail_group(t, lm_scoring.EndGroups())
    read = [([group(t) for t in doc], [crc32(t) >> lm_scoring.HASH_SHIFT for t in doc]) for doc in toks]
    share = np.bincount([g for gs, _ in read for g in gs], minlength=lm_scoring.CLASSES * lm_scoring.GROUPS) + 0.1
    share = share / share.sum()
    placed = [(brute_rows(g, h, rows), g) for g, h in read]
    return rows, docs, vocab, share, placed


def test_scores_and_gradients_against_brute_force(small):
    import pyarrow as pa

    rows, docs, vocab, share, placed = small
    codes = lm_scoring.Codes(vocab.head)
    column = pa.array([codes.read(lm_scoring.tokens(t)).tolist() for _, t in docs], pa.list_(pa.int32()))
    blocks = list(lm_scoring._blocks(column.slice(0, 7), vocab.groups, vocab.hashes, rows, 50)) + list(lm_scoring._blocks(column.slice(7), vocab.groups, vocab.hashes, rows))
    feats, groups = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
    assert feats.tolist() == [f for fs, _ in placed for f in fs] and groups.tolist() == [g for _, gs in placed for g in gs]
    seen = np.zeros((2, rows, lm_scoring.CLASSES))
    cls = groups // lm_scoring.GROUPS
    for f in range(lm_scoring.FEATURES):
        np.add.at(seen[0], (feats[:, f], cls), 1)
        np.add.at(seen[1], (lm_scoring.inner_rows(feats, cls, rows)[:, f], groups % lm_scoring.GROUPS), 1)
    factors = np.random.default_rng(1).uniform(0.1, 0.6, (2, lm_scoring.FEATURES, lm_scoring.SIZES))
    model = lm_scoring.Model(lm_scoring.weights_of((seen[0], seen[1]), share), factors)
    weight, size, bias = brute_model(placed, share, rows)
    want = [brute_log_prob(weight, size, bias, factors, f, g, rows) for f, g in zip(feats.tolist(), groups.tolist())]
    assert model.log_probs(feats, groups).tolist() == pytest.approx(want, abs=1e-3)
    grad, outer = model.gradients(feats[:200], groups[:200])
    whole = lambda x: sum(brute_log_prob(weight, size, bias, x, f, g, rows, leave=True) for f, g in zip(feats[:200].tolist(), groups[:200].tolist()))
    for k, t, s in [(0, 0, 1), (0, 2, 2), (1, 1, 1), (1, 3, 2)]:
        up, down = factors.copy(), factors.copy()
        up[k, t, s] += 1e-4
        down[k, t, s] -= 1e-4
        assert grad[k, t * lm_scoring.SIZES + s] == pytest.approx((whole(up) - whole(down)) / 2e-4, abs=2e-2)
    assert np.allclose(outer, np.swapaxes(outer, 1, 2)) and all(np.linalg.eigvalsh(o).min() > -1e-6 for o in outer)


def test_probabilities_sum_to_one(small):
    rows, _, _, share, placed = small
    seen = np.random.default_rng(3).poisson(0.5, (2, rows, lm_scoring.CLASSES)).astype(float)
    model = lm_scoring.Model(lm_scoring.weights_of((seen[0], seen[1]), share), np.full((2, lm_scoring.FEATURES, lm_scoring.SIZES), 0.3))
    feats = np.array(placed[0][0][:3])
    total = sum(np.exp(model.log_probs(feats, np.full(3, g))) for g in range(lm_scoring.CLASSES * lm_scoring.GROUPS))
    assert np.allclose(total, 1, atol=1e-4)


def test_same_scores_on_any_layout(spark):
    """Held-out scores at 1, 8 and 64 partitions are the same, and well above the base."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    figures = []
    for n in (1, 8, 64):
        part = docs.repartition(n)
        out = lm_scoring.score_texts(part, part.filter(fold("doc_id", 10) != 0)).filter(fold("doc_id", 10) == 0)
        figures.append(out.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first())
    score, base, n = figures[0]
    assert score / n > base / n + 0.2
    assert [x[0] for x in figures[1:]] == pytest.approx([score] * 2, rel=1e-6)


def test_a_condition_picks_the_same_rows(spark):
    """Training on rows picked by a condition gives what a table of them gives; columns with names used inside are left out."""
    docs = spark.createDataFrame([*texts(), (None, "abc abc"), (3, "aei aei")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_codes", F.lit("clash"))
    held = fold("doc_id", 10) == 0
    table = lm_scoring.score_texts(docs, docs.filter(~held))
    picked = lm_scoring.score_texts(docs, ~held)
    assert picked.columns == table.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    for a, b in zip(sorted(table.collect(), key=key), sorted(picked.collect(), key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_long_tokens_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, f"a b {'x' * 3000} c") for k in range(20)] + [(21, "y" * 100_000)], "doc_id long, text string")
    counts = lm_scoring.token_counts(docs.select("text"))
    head, _ = lm_scoring.head_of(counts)
    assert {t for t, _ in head} >= {"a", "b", "c", ""} and all(len(t) <= lm_scoring.LONGEST for t, _ in head)
    assert {r.doc_id: r.n_known for r in lm_scoring.score_texts(docs, docs).collect()} == {**dict.fromkeys(range(20), 5), 21: 2}


def test_workers_without_the_package(tmp_path):
    """The driver finds the package by its own path only; workers have no PYTHONPATH to it."""
    code = f"""
        import sys
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
        sys.path.insert(0, {ROOT!r})
        import gradeloom.llm.queries as q
        for name in ("op4_lm_scoring", "op5_language_id", "op9_toxicity", "op3_decontamination", "op10_simhash_dedup"):
            assert q.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200, name
        print("all counted")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all counted" in done.stdout, done.stderr[-2000:]
