"""Toxicity: non-negative positive-unlabelled learning over what the corpus says of each word.

Words aren't weighed one by one: with as many words as documents, a classifier learns its own documents by heart.  All
training rows are counted instead: in how many documents a word stands, and in how many confirmed toxic ones.  By how many
deviations the second number exceeds what chance gives is the word's evidence, the document at hand left out of both
numbers.  A document is described by how many of its words have evidence of each strength, and the classifier is trained on
these descriptions by the class-prior-corrected, non-negative risk estimator over all unlabelled rows.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, fold, stored, table

#: Words are counted by hash in so many cells; it bounds what is broadcast.
BITS = 22
#: Confirmed toxic documents that are learned from at most: those with the smallest md5 of the id.
MAX_POSITIVE = 20_000
#: Strengths of evidence, in deviations, and how many words of one strength are told apart (as many, or more).
STRENGTHS, MOST = (2.5, 3.5, 5.0, 7.0, 10.0, 15.0), 3
#: Added to expected numbers, so that one odd document is no evidence.
SMOOTH = 0.5
#: Lengths of documents told apart, in powers of four words.
LENGTHS = 8
CELLS = (MOST + 1) ** len(STRENGTHS) * LENGTHS
STEPS, RATE = 400, 0.1
#: Weight of the squared weights, over the number of confirmed documents.
DECAY = 0.5
THRESHOLD = 0.7
RESULT = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

#: ASCII letters (lower-cased) and non-ASCII characters make words; the rest becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[int]:
    """Hashes of the distinct words of the whole text, ascending."""
    found = set(text.encode("utf-8", "surrogatepass").translate(LETTERS).split()) if text else ()
    return sorted({crc32(w) & ((1 << BITS) - 1) for w in found})


def evidence(toxic: np.ndarray, rows: np.ndarray, n_toxic: float, n_rows: float) -> np.ndarray:
    """Deviations by which a word's toxic documents exceed those expected of its documents."""
    expected = rows * (n_toxic / n_rows) if n_rows > 0 else np.zeros(len(rows))
    return (toxic - expected) / np.sqrt(expected + SMOOTH)


def cell_of(toxic: np.ndarray, rows: np.ndarray, n_toxic: int, n_rows: int, n_words: int) -> int:
    """The description of a document as one number, from its words' counts without the document itself."""
    length = min(LENGTHS - 1, (n_words + 1).bit_length() // 2)
    strong = np.searchsorted(STRENGTHS, evidence(toxic, rows, n_toxic, n_rows), side="right")
    held = np.minimum(MOST, np.bincount(strong, minlength=len(STRENGTHS) + 1)[1:])
    return int(((MOST + 1) ** np.arange(len(STRENGTHS)) * held).sum()) * LENGTHS + length


def design(cells: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: for each strength whether there are 1, 2, 3 or more words of it, and the length."""
    held, length = cells // LENGTHS, cells % LENGTHS
    levels = [held // (MOST + 1) ** k % (MOST + 1) for k in range(len(STRENGTHS))]
    return np.stack([*[(x >= m).astype(float) for x in levels for m in range(1, MOST + 1)], *[(length == k).astype(float) for k in range(LENGTHS)]], axis=1)


def risk(w: np.ndarray, b: float, x: np.ndarray, n_p: np.ndarray, n_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: prior * R_p(+), and R_u(-) - prior * R_p(-), with the logistic loss.

    ``n_p`` and ``n_u``: confirmed and unlabelled documents of each row of ``x``.
    """
    s = x @ w + b
    p, u = n_p / n_p.sum(), n_u / n_u.sum()
    return prior * float(p @ np.logaddexp(0, -s)), float((u - prior * p) @ np.logaddexp(0, s))


def fit_nnpu(cells: np.ndarray, n_p: np.ndarray, n_u: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by Adam over the counts of all documents.

    Where the second part is negative its gradient is reversed: it has fitted unlabelled rows as negatives too closely.
    The squared weights count DECAY over the number of confirmed documents, so they matter less as the sample grows.
    """
    x = design(cells)
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    if not n_p.sum() or not n_u.sum():
        return w, -5.0
    p, u = n_p / n_p.sum(), n_u / n_u.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sig = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        rest = risk(w, b, x, n_p, n_u, prior)[1]
        # Gradients in s of the losses for +1 and -1 are sig - 1 and sig.
        g = prior * p * (sig - 1) + (u - prior * p) * sig if rest >= 0 else -(u - prior * p) * sig
        grad = np.append(x.T @ g + DECAY * prior / n_p.sum() * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def count_words(rows: DataFrame, confirmed) -> DataFrame:
    """(word int, rows long, toxic long) over ``rows`` (id, text); ``confirmed``: a broadcast set of ids."""

    def count(batches):
        held = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(text.as_py())
                held[0, w] += 1
                if i in confirmed.value:
                    held[1, w] += 1
        used = np.flatnonzero(held[0])
        for lo in range(0, len(used), 1 << 16):
            at = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[0, at].astype(np.int64)), pa.array(held[1, at].astype(np.int64))], names=["word", "rows", "toxic"])

    return rows.mapInArrow(count, "word int, rows long, toxic long").groupBy("word").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"))


def describe(docs: DataFrame, training: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> tuple[DataFrame, float]:
    """The columns to keep, ``_cell`` (int: the description), ``_p`` (confirmed) and ``_u`` (training row), and the class prior.

    ``training``: name of a boolean column.  The prior is the share of label 1 among the labelled training ids.
    """
    spark = docs.sparkSession
    ids = docs.filter(F.col(training) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    marks = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).alias("_y")).filter("_y is not null and _lid is not null").groupBy("_lid").agg(F.max("_y").alias("_y"))
    marked = ids.join(marks, F.col("_id") == F.col("_lid")).select("_id", "_y")
    n_labelled, n_bad = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_y")), F.lit(0))).first()
    prior = min(0.95, max(1e-3, n_bad / n_labelled)) if n_labelled else 0.01
    chosen = marked.filter("_y = 1").orderBy(F.md5(F.col("_id").cast("string").cast("binary")), F.col("_id")).limit(MAX_POSITIVE)
    confirmed = spark.sparkContext.broadcast({r["_id"] for r in chosen.collect()})
    rows = docs.filter(F.col(training)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = count_words(rows, confirmed)
    # Of words whose evidence can't reach the least strength, whatever document is left out, nothing is sent.
    counts = stored(counts.filter("toxic > 0"))
    n_p = len(confirmed.value)
    n_u = rows.count()
    rate = n_p / max(1, n_u)
    expected = F.greatest(F.lit(0.0), F.col("rows") - 1) * rate * 0.999
    wanted = counts.filter((F.col("toxic") - expected) / F.sqrt(expected + SMOOTH) >= STRENGTHS[0] * 0.99).toArrow()
    listed = spark.sparkContext.broadcast(tuple(np.asarray(wanted.column(c).to_numpy(), dtype=np.int64) for c in ("word", "rows", "toxic")))

    def make():
        word, in_rows, in_toxic = listed.value
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[word] = np.arange(len(word))

        def run(found, learned, texts):
            cells, p, u = [], [], []
            for i, mine, text in zip(found.to_pylist(), learned.to_pylist(), texts, strict=True):
                w = words(text.as_py())
                at = place[w]
                at = at[at >= 0]
                is_u = int(bool(mine))
                is_p = int(is_u and i in confirmed.value)
                cells.append(cell_of(in_toxic[at] - is_p, in_rows[at] - is_u, n_p - is_p, n_u - is_u, len(w)))
                p.append(is_p)
                u.append(is_u)
            return cells, p, u

        return run

    fields = [T.StructField("_cell", T.IntegerType()), T.StructField("_p", T.IntegerType()), T.StructField("_u", T.IntegerType())]
    return annotate(docs, [id_col, training, text_col], make, fields, keep), prior


def score_toxicity(docs: DataFrame, training: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows marked by the boolean column ``training`` and score all rows.

    Training rows with label 1 are confirmed toxic (at most MAX_POSITIVE documents); all training rows, whatever their
    label, are the unlabelled sample, so that the class prior holds in it.  Adds ``score`` (0 to 1) and ``predicted`` (1
    where the score is THRESHOLD or more).

    A document labelled both ways is confirmed; rows that repeat an id and a text count each.  Null and empty texts have
    the score of a text without words; rows without an id are unlabelled.  Without confirmed documents every score is
    near 0.  Input columns named ``score`` or ``predicted`` are replaced.
    """
    kept = [c for c in (keep or docs.columns) if c.lower() not in ("score", "predicted", "_cell", "_p", "_u")]
    described, prior = describe(docs, training, labels, id_col, text_col, label_col, kept)
    described = stored(described)
    found = described.groupBy("_cell").agg(F.sum("_p").alias("p"), F.sum("_u").alias("u")).collect()
    cells = np.array(sorted(r["_cell"] for r in found), dtype=np.int64)
    place = {c: k for k, c in enumerate(cells.tolist())}
    n_p, n_u = np.zeros(len(cells)), np.zeros(len(cells))
    for r in found:
        n_p[place[r["_cell"]]], n_u[place[r["_cell"]]] = r["p"], r["u"]
    w, b = fit_nnpu(cells, n_p, n_u, prior)
    scores = 1 / (1 + np.exp(-np.clip(design(cells) @ w + b, -30, 30))) if len(cells) else np.zeros(0)
    # One row for each description that occurs: at most CELLS.
    listed = docs.sparkSession.createDataFrame([(int(c), float(s)) for c, s in zip(cells, scores, strict=True)], "_c int, score double")
    out = described.join(F.broadcast(listed), F.col("_cell") == F.col("_c"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of documents in fold 1 of 3 are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"), (fold("doc_id", 3) != 1).alias("_train"))
    return score_toxicity(docs, "_train", table(spark, sf_dir, "labels"), keep=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")


ORACLE: dict[str, str] = {}
