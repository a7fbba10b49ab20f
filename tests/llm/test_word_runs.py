"""op12 against quadratic search, appended at once and word by word."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from gradeloom.llm import word_runs


def brute(words, least_length=24, least_exponent=3):
    found = {}
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_length, least_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def made(rng):
    n, letters = rng.randint(0, 200), rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 30 else 0):
        s, p, size = rng.randrange(n), rng.randint(1, 40), rng.randint(1, n)
        for i in range(s + p, min(n, s + size)):
            words[i] = words[i - p]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.randint(1, 8))]
        length, exponent = rng.choice([24, 24, 6, 1]), rng.choice([3, 3, 4])
        assert word_runs.runs_of(texts, length, exponent) == [brute(t, length, exponent) for t in texts]


def test_online_reports_at_any_time():
    rng = random.Random(2)
    for _ in range(60):
        words, finder, at = made(rng), word_runs.RunFinder(), 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 7, 40])
            finder.append(np.array(words[at : at + step]))
            at += step
            assert finder.runs() == brute(words[:at])


def test_equal_hashes_only_propose(monkeypatch):
    """With all hashes of more than one word equal, the runs are still those of the words."""
    extend = word_runs.Catchers.extend
    monkeypatch.setattr(word_runs.Catchers, "extend", lambda self, h: extend(self, h if self.block == 1 else h * np.uint64(0)))
    rng = random.Random(3)
    for _ in range(20):
        words = made(rng)
        assert set(brute(words)) >= set(word_runs.runs_of([words])[0])


def test_long_texts(monkeypatch):
    monkeypatch.setattr(word_runs, "CHUNK", 1 << 12)
    assert word_runs.runs_of([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    block = [*range(1000)]
    assert word_runs.runs_of([[-1, *(block * 30), -2]]) == [[(1, 30_000, 1000)]]
    nested = ([b"a"] * 30 + [b"b"]) * 2_000
    found = word_runs.runs_of([nested])[0]
    assert len(found) == 2_001 and found[0] == (0, 30, 1) and (0, len(nested), 31) in found


def test_exponent_two_is_refused():
    with pytest.raises(ValueError):
        word_runs.RunFinder(24, 2)


def test_edges(spark):
    texts = [None, "", " \t\n", "a", "a " * 24, "a " * 23, "x " + "a b " * 12 + "y", "é\x0bü\x0c" * 12, "  " * 30]
    rows = [(k, t, "r", "c") for k, t in enumerate(texts)] + [(None, texts[4], "r", "c"), (4, texts[4], "r", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS string, collapsed string")
    out = word_runs.collapse_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()}
    assert got[0] == got[1] == got[2] == ([], "") and got[3] == ([], "a")
    assert got[4] == got[None] == ([(0, 24, 1)], "a") and got[5] == ([], "a " * 22 + "a")
    assert got[6] == ([(1, 24, 2)], "x a b y") and got[7] == ([(0, 24, 2)], "é ü") and got[8] == ([(0, 30, 1)], " ")
    assert out.count() == len(rows) and word_runs.collapse_runs(df.limit(0)).collect() == []


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(d, t) for d, t in docs if len(t.split()) < 400][:60]
    rows += [(10_000 + k, " ".join(map(str, made(rng)))) for k in range(80)] + [(None, "a " * 30), (5, None), (5, "b " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = word_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *expected(d, t))) for d, t in rows)
    assert any(r["n_runs"] for r in got if r["doc_id"] is not None and r["doc_id"] < 10_000)
