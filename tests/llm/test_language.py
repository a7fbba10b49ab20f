"""Language ID against brute force, in scripts beyond Latin, and on long and repeated texts."""

import math
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import language_id

SCHEMA = "doc_id long, text string, lang string"
SAMPLES = {
    "ru": "съешь же ещё этих мягких французских булок да выпей чаю и было это давно",
    "uk": "жебракують філософи при ґанку церкви в гадячі ще й шатро їхнє п'яне знаємо",
    "el": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία και το καλό που έχει αυτός ο κόσμος",
    "zh": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳",
    "ja": "いろはにほへとちりぬるをわかよたれそつねならむうゐのおくやまけふこえて",
    "ar": "نص حكيم له سر قاطع وذو شأن عظيم مكتوب على ثوب أخضر ومغلف بجلد أزرق",
    "en": "the quick brown fox jumps over the lazy dog and that is what it does with this",
}


def rows(n=20, seed=4):
    rng, out = random.Random(seed), []
    for lang, text in SAMPLES.items():
        words = text.split() if " " in text else [text[i : i + 2] for i in range(0, len(text), 2)]
        gap = " " if " " in text else ""
        out += [(len(out) + k, gap.join(rng.choice(words) for _ in range(25)), lang) for k in range(n)]
    return out


def test_scripts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    profiles = language_id.learn_profiles(df.filter("doc_id % 3 <> 1"))
    got = language_id.predict_language(df.filter("doc_id % 3 = 1"), profiles).collect()
    assert len(got) > 40 and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)


def brute_vector(text):
    chars = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    chars = " " + " ".join(chars.split()) + " "
    grams = {}
    for i in range(len(chars) - 2):
        grams[chars[i : i + 3]] = grams.get(chars[i : i + 3], 0) + 1
    return grams


def brute_bundle(grams, space):
    cp = lambda c: 0 if c == " " else ord(c)
    out = np.zeros(language_id.DIM)
    for g, n in grams.items():
        a, b, c = (space.letter(cp(x)).astype(float) for x in g)
        out += math.sqrt(n) * np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_against_brute_force(spark):
    data = [*rows(6, 9), (900, "A.", "en"), (901, "the the the", "en"), (901, "the the the", "en"), (902, "12 34", "en"), (903, None, "en"), (904, "words, of none", None)]
    df = spark.createDataFrame(data, SCHEMA)
    profiles, space, sums = language_id.learn_profiles(df), language_id.Space(), {}
    for _, text, lang in data:
        if lang and text:
            for g, n in brute_vector(text).items() if any(c.isalpha() for c in text) else ():
                sums.setdefault(lang, {})[g] = sums.get(lang, {}).get(g, 0) + n
    want = {lang: brute_bundle(g, space) for lang, g in sums.items()}
    assert set(profiles) == set(want)
    for lang, v in want.items():
        assert np.allclose(profiles[lang], v / np.linalg.norm(v), atol=1e-5)
    for r in language_id.predict_language(df, profiles).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = brute_bundle(brute_vector(r.text), space)
        cosines = {lang: float(v @ p) / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in want.items()}
        assert r.score == pytest.approx(max(0.0, max(cosines.values())), abs=1e-4) and cosines[r.lang_pred] == pytest.approx(max(cosines.values()), abs=1e-4)
    assert {r.lang_pred for r in language_id.predict_language(df.filter("doc_id = 901"), profiles).collect()} == {"en"}


def test_long_texts_and_strange_columns(spark):
    rng = random.Random(1)
    long = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(100_000)) + "𠀀𠀁" * 10
    df = spark.createDataFrame([(1, long, "zh"), (2, "the dog and the fox " * 5000, "en"), (3, "", "en")], SCHEMA).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(df, language_id.learn_profiles(df)).collect()}
    assert got == {1: "zh", 2: "en", 3: "und"}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    df = spark.range(5).select(F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language_id.learn_profiles(df)


def test_query(spark):
    out = language_id.op5_language_id(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert set(got) == {d.doc_id for d in docs}
    assert all(got[d.doc_id].held_out == (crc32(str(d.doc_id).encode()) % 3 == 1) for d in docs)
    judged = [d for d in docs if d.lang and got[d.doc_id].held_out and got[d.doc_id].lang_pred != "und"]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in judged) >= 0.97 * len(judged)
