"""The stored index: the same hits as brute force whatever the blocks and shards, also where texts are kept, and proximity counts."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate


def brute_near(w, windows, slack):
    places, items = set(), set()
    for item, win in windows:
        for s in range(-slack, len(w) + slack + 1):
            if all(any(0 <= s + k + d < len(w) and w[s + k + d] == x for d in range(-slack, slack + 1)) for k, x in enumerate(win)):
                places.add(s)
                items |= {str(item)} if item is not None else set()
    return places, items


@pytest.mark.parametrize("block, tokens", [(1 << 20, 1_000_000), (1, 1_000_000), (1, 30), (50, 7)])
@pytest.mark.parametrize("keep", [["doc_id"], None])
def test_against_brute_force(spark, monkeypatch, block, tokens, keep):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontaminate, "SHARD_TOKENS", tokens)
    rng = random.Random(2)
    bench = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 20)))) for k in range(12)] + [(99, None), (98, " .. "), (None, "a b c"), (3, "g f e")]
    docs = [(k, None if k % 7 == 0 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) + (f" {bench[k % 12][1]}" if k % 3 else "")) for k in range(50)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("x")).repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    windows = [(i, w[k : k + 13]) for i, t in bench if t for w in [decontaminate.words(t)] if w for k in range(max(1, len(w) - 12))]
    text = dict(docs)
    got = decontaminate.find_contamination(df, items, keep=keep).collect()
    assert len(got) == 50
    for r in got:
        w, hit, found = decontaminate.words(text[r.doc_id]), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(item)} if item is not None else set()
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
    for r in decontaminate.find_near(df, items, slack=1, keep=keep).collect():
        places, found = brute_near(decontaminate.words(text[r.doc_id]), windows, 1)
        assert r.near_items == sorted(found) and r.n_places == len({p for p in places if -1 <= p < len(decontaminate.words(text[r.doc_id]))})


def test_one_index_for_two_benchmarks(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three four"), (3, None)], "doc_id long, text string")
    index = decontaminate.build_index(docs, keep=["doc_id"])
    finish = lambda lengths, hits, items: (lengths, hits)
    for item, want in (("two three", {1: 2, 2: 2, 3: 0}), ("four", {1: 0, 2: 1, 3: 0})):
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        out = decontaminate.search_index(index, bench, decontaminate.RESULT[:2], finish)
        assert {r.doc_id: r.n_hit for r in out.collect()} == want
    with pytest.raises(ValueError, match="slack"):
        decontaminate.find_near(docs, docs.select(F.col("doc_id").alias("item_id"), "text"), slack=40)


def test_very_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab " * 400_000), (2, "x" * 1_000_000), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "ab ab"), (8, "x" * 1_000_000)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.find_contamination(docs, bench, keep=["doc_id"]).collect()}
    assert got == {1: (400_000, 400_000, True), 2: (1, 1, True), 3: (0, 0, False)}
    assert decontaminate.find_contamination(docs.limit(0), bench, keep=["doc_id"]).count() == 0
    assert {r.n_hit for r in decontaminate.find_contamination(docs, bench.limit(0), keep=["doc_id"]).collect()} == {0}


def test_windows_are_few_bytes(monkeypatch):
    """Two million windows take below 300 MB and a few seconds; those of equal keys that differ stay apart."""
    import time
    import tracemalloc

    rng = random.Random(6)
    vocabulary = [f"word{k}".encode() for k in range(50_000)]
    items = [(str(k), rng.choices(vocabulary, k=2_000)) for k in range(1_000)]
    began = time.process_time()
    tracemalloc.start()
    arrays = decontaminate.windows_of([*items, items[0]], 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    windows = decontaminate.Windows(arrays)
    assert len(windows.starts) == 1_000 * 1_988 and peak < 300 << 20
    assert sum(x.nbytes for x in arrays[:-1]) < 60 << 20 and time.process_time() - began < 20
    assert windows.items_of(0).count("0") in (0, 2)


def test_windows_against_a_plain_dictionary():
    rng = random.Random(7)
    for _ in range(50):
        items = [(rng.choice([None, str(k)]), [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 9))]) for k in range(8)]
        size, want = rng.randint(1, 5), {}
        for item, w in items:
            for i in range(max(1, len(w) - size + 1) if w else 0):
                want.setdefault(tuple(w[i : i + size]), set()).update([item] if item else [])
        made = decontaminate.Windows(decontaminate.windows_of(items, size))
        names = {h: w for w, h in zip([b"a", b"b"], decontaminate.hashes([b"a", b"b"]).tolist())}
        got = {tuple(names[made.terms[t]] for t in made.words_of(k).tolist()): set(made.items_of(k)) for k in range(len(made.starts))}
        assert got == want and len(made.starts) == len(want)
