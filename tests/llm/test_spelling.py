"""op13 against comparison of all pairs, and its edge cases."""

import random
import re
from collections import Counter
from zlib import crc32

from gradeloom.llm import spelling

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def grouped(spark, words: dict[str, int]) -> dict[str, tuple]:
    out = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r["word"]: tuple(r)[1:] for r in out.collect()}


def made(rng, letters, size):
    words = {}
    for _ in range(size):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 10)))
        for _ in range(rng.randint(1, 4)):
            words.setdefault(w, rng.choice([5, 6, 30, 31, 200, 1200, 9000]))
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            w = w if len(w) >= 6 else w + "zz"
    return words


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    for letters in ("abcdefghijklmnopqrstuvwxyzäöé", "abc"):
        words = made(rng, letters, 250)
        assert grouped(spark, words) == brute(words)


def test_short_thresholds_change_nothing(spark, monkeypatch):
    """Long grams and lists that go by deletions give the same groups."""
    words = made(random.Random(2), "abcd", 200)
    expected = brute(words)
    monkeypatch.setattr(spelling, "FREQUENT", 2)
    assert grouped(spark, words) == expected
    monkeypatch.setattr(spelling, "LIST", 3)
    assert grouped(spark, words) == expected
    monkeypatch.setattr(spelling, "MOST_FREQUENT", 10)
    assert grouped(spark, words) == expected


def test_grams_and_bound():
    grams, bound = spelling.grams_of("banana", {"an", "na", "ana"})
    assert grams == [("\x02b", 0), ("ba", 1), ("anan", 2), ("nan", 3), ("ana\x03", 4), ("na\x03", 5), ("a\x03", 6)]
    assert bound == max(sum(at <= i < at + len(g) for g, at in grams) for i in range(8))
    # An edit leaves all grams but the bound's number at the same distance from the start or the end.
    rng, letters = random.Random(3), "abc"
    for _ in range(2_000):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        k, x = rng.randrange(len(w)), rng.choice(letters)
        v = rng.choice([w[:k] + w[k + 1 :], w[:k] + x + w[k:], w[:k] + x + w[k + 1 :]])
        frequent = {"".join(rng.choice(letters) for _ in range(rng.choice([2, 2, 3, 4]))) for _ in range(12)}
        (a, bound), (b, _) = spelling.grams_of(w, frequent), spelling.grams_of(v, frequent)
        keys = {(g, at) for g, at in b} | {(g, at - len(v) - 99) for g, at in b}
        assert sum((g, at) in keys or (g, at - len(w) - 99) in keys for g, at in a) >= len(a) - bound > 0


def test_chains_and_ties(spark):
    words = {"letters": 5000, "letterz": 900, "lettezz": 150, "lezzezz": 20, "lettexz": 150, "latters": 1000, "letterss": 1000}
    assert grouped(spark, words) == brute(words)
    assert grouped(spark, words)["lettezz"][:2] == ("letterz", "letters")
    tie = {"abcdefg": 10, "abcdefz": 90, "abcdefb": 90}
    assert grouped(spark, tie)["abcdefg"][0] == "abcdefb"


def count(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(ASCII)
            h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            words[w] += 1
    return {w: n for w, n in words.items() if n >= 5 and len(w) >= 6}


def test_words_and_query(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["Österreich", "ÖSTERREICH", "österreich", "straßen", "ÉLÉMENT", "a×b÷cdef", "short", "letters", "LETTERS", "été", "naïveté", *made(rng, "abcdé", 30)]
    rows = [(k, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "1", "_"]) for _ in range(200))) for k in range(60)]
    rows += [(None, "letters " * 7), (3, None), (3, ""), (7, "letters " * 3), (7, "letters " * 3), (8, "longest" * 3_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: tuple(r)[1:] for r in spelling.op13_spelling_variants(spark, str(tmp_path)).collect()}
    expected = brute(count(rows))
    assert got == expected and any(x[0] for x in expected.values())


def test_empty_tables(spark):
    assert grouped(spark, {"abcdef": 5}) == {"abcdef": (None, "abcdef", 5, 0, None)}
    words = spelling.spelling_words(spark.createDataFrame([], "doc_id long, text string"))
    assert spelling.group_variants(words).collect() == []
