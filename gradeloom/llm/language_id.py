"""Language ID with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, fold, table

DIM = 1024
GRAM = 3
SEED = 7
#: Bits of a code point in a trigram's number; 0 stands for all that is no letter.
POINT_BITS = 21
#: Trigrams bound at a time, and (language, trigram) pairs that a task holds before it passes them on.
CHUNK, HELD = 4096, 1 << 20
#: More distinct languages than this are an error: such a column doesn't hold languages, and each costs 4 KB at the driver.
MAX_LANGS = 10_000
UNKNOWN = "und"
#: The pipeline rejects documents of at least so many distinct trigrams whose cosine to the nearest profile is below this.
#: Between unrelated texts the cosine deviates by 1 / sqrt(DIM) = 0.031, and that of a clean short text is small itself;
#: of 23,000 generated documents with 128 trigrams or more, none was below 0.31, but shorter ones went down to 0.05.
MIN_SCORE, MIN_GRAMS = 0.1, 128
RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def letters_table() -> np.ndarray:
    """Which code points of the Basic Multilingual Plane are letters."""
    return np.array([not 0xD800 <= cp < 0xE000 and chr(cp).isalpha() for cp in range(0x10000)])


def _grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of the lower-cased text as numbers, and their counts; runs of other characters are one blank."""
    s = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    keep = letters[np.minimum(s, 0xFFFF)]
    far = np.flatnonzero(s > 0xFFFF)
    if len(far):
        kinds, which = np.unique(s[far], return_inverse=True)
        keep[far] = np.array([chr(cp).isalpha() for cp in kinds.tolist()])[which]
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[0], np.where(keep, s, 0), [0]])
    s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]
    if len(s) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((s[:-2] << 2 * POINT_BITS) | (s[1:-1] << POINT_BITS) | s[2:], return_counts=True)


class Space:
    """A random +1/-1 vector for each letter of any script, made from its code point, and the bound vectors of trigrams."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed, self.known = dim, seed, {}

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.known:
            self.known[cp] = (np.random.default_rng([self.seed, cp]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.known[cp]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each times the root of its count.

        A letter's vector is permuted by its place in the trigram, which keeps the order: abc and cba get unrelated vectors.
        """
        out, low = np.zeros(self.dim, dtype=np.float32), (1 << POINT_BITS) - 1
        for lo in range(0, len(grams), CHUNK):
            g = grams[lo : lo + CHUNK]
            points, at = np.unique(np.stack([g >> 2 * POINT_BITS, (g >> POINT_BITS) & low, g & low]), return_inverse=True)
            vectors = np.stack([self.letter(cp) for cp in points.tolist()])
            first, second, third = at.reshape(3, -1)
            bound = np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]
            out += np.sqrt(counts[lo : lo + CHUNK]).astype(np.float32) @ bound.astype(np.float32)
        return out


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """One unit vector per language: the bundle of the trigrams of all its texts.

    Executors count trigrams, and bundle the counted ones part by part; what reaches the driver is DIM numbers per
    language.  Rows without a language or without letters teach nothing; no rows give no profile.  More than MAX_LANGS
    languages are an error.
    """
    import pyarrow as pa

    def count(batches):
        letters, held, size = letters_table(), {}, 0

        def out():
            for lang, parts in held.items():
                grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _grams(text.as_py(), letters)
                if len(found[0]):
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    def bundle(batches):
        space, sums = Space(), {}
        for batch in batches:
            langs, which = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            grams, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            for k, lang in enumerate(langs.tolist()):
                mine = which == k
                sums[lang] = sums.get(lang, 0.0) + space.bundle(grams[mine], n[mine]).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], names=["lang", "d", "v"])

    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(bundle, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    vectors: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        if row["lang"] not in vectors and len(vectors) >= MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages")
        vectors.setdefault(row["lang"], np.zeros(DIM))[row["d"]] = row["v"]
    # Rounded, so that the order in which parts are added leaves no trace.
    return {lang: np.round(v / np.linalg.norm(v), 7).astype(np.float32) for lang, v in sorted(vectors.items()) if v.any()}


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, grams_col: str | None = None) -> DataFrame:
    """Add ``lang_pred``, the language whose profile has the largest cosine to the text's vector, and ``score``, that cosine (0 at least).

    ``und`` with score 0 for null texts, texts without letters, and where no profile was learned.  Of equal cosines the
    first language in code-point order wins.  Input columns named ``lang_pred`` or ``score`` are replaced.
    ``grams_col``: also add the number of distinct trigrams by this name.
    """
    langs = list(profiles)
    matrix = np.stack([profiles[x] for x in langs], axis=1) if langs else np.zeros((DIM, 0), np.float32)

    def make():
        letters, space = letters_table(), Space()

        def run(texts):
            preds, scores, n_grams = [], [], []
            for text in texts:
                grams, counts = _grams(text.as_py() or "", letters)
                pred, score = UNKNOWN, 0.0
                if len(grams) and langs:
                    v = space.bundle(grams, counts)
                    cosines = v @ matrix / max(float(np.linalg.norm(v)), 1e-9)
                    best = int(np.argmax(cosines))
                    pred, score = langs[best], min(1.0, max(0.0, float(cosines[best])))
                preds.append(pred)
                scores.append(score)
                n_grams.append(len(grams))
            return (preds, scores, n_grams) if grams_col else (preds, scores)

        return run

    fields = [*RESULT, T.StructField(grams_col, T.LongType())] if grams_col else RESULT
    return annotate(docs, [text_col], make, fields, keep)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; the languages of documents in fold 1 of 3 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.filter(fold("doc_id", 3) != 1))
    out = predict_language(docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), profiles, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


ORACLE: dict[str, str] = {}
