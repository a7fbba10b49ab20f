"""Word error rate of ASR transcripts, and the hook for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_edits(reference: Column, heard: Column) -> Column:
    """Word-level edit distance (Spark's own counts characters): one numpy row for each word of the reference."""

    @F.pandas_udf(T.LongType())
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> int:
            x, y = (x or "").lower().split(), (y or "").lower().split()
            number = {w: k for k, w in enumerate(dict.fromkeys([*x, *y]))}
            heard, at = np.array([number[w] for w in y], dtype=np.int64), np.arange(len(y) + 1)
            row = at.copy()
            for i, w in enumerate(x, 1):
                new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (heard != number[w]))])
                # Insertions run to the right: the least value so far, plus the steps from there.
                row = np.minimum.accumulate(new - at) + at
            return int(row[-1])

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    return edits(reference, heard)


#: Edits weigh this much against one word heard right, so that of the alignments with the fewest edits the one with the most such words counts.
EDIT = 1 << 32
KINDS = T.StructType([T.StructField(n, T.LongType()) for n in ("hits", "substitutions", "deletions", "insertions")])
STEPS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "reference", "heard")]))


def _numbered(x: str | None, y: str | None) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    x, y = (x or "").lower().split(), (y or "").lower().split()
    number = {w: k for k, w in enumerate(dict.fromkeys([*x, *y]))}
    return x, y, *(np.array([number[w] for w in z], dtype=np.int64) for z in (x, y))


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least costs of aligning all of ``x`` with the first 0, 1, ... words of ``y``; one row at a time."""
    at = np.arange(len(y) + 1, dtype=np.int64) * EDIT
    row = at.copy()
    for i, w in enumerate(x, 1):
        new = np.concatenate([[i * EDIT], np.minimum(row[1:] + EDIT, row[:-1] + np.where(y == w, -1, EDIT))])
        # Insertions run to the right: the least value so far, plus the steps from there.
        row = np.minimum.accumulate(new - at) + at
    return row


def count_kinds(x: str | None, y: str | None) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions and insertions of the alignment with the fewest edits, and of those the most hits."""
    _, _, a, b = _numbered(x, y)
    cost = int(_last_row(a, b)[-1])
    edits = -(-cost // EDIT)
    hits = edits * EDIT - cost
    insertions = edits - (len(a) - hits)
    deletions = insertions - (len(b) - len(a))
    return hits, len(a) - hits - deletions, deletions, insertions


def align(x: str | None, y: str | None) -> list[tuple[str, str | None, str | None]]:
    """That alignment, step by step: (kind, word of the reference, word heard).

    The reference is halved again and again, and the text heard is cut where the costs of both sides are least, so no
    more than two rows of costs are held.
    """
    x, y, a, b = _numbered(x, y)
    out: list[tuple[str, str | None, str | None]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, n = todo.pop()
        if i == j:
            out += [("insertion", None, w) for w in y[k:n]]
        elif k == n:
            out += [("deletion", w, None) for w in x[i:j]]
        elif j - i == 1:
            same = np.flatnonzero(b[k:n] == a[i])
            m = k + int(same[0]) if len(same) else k
            out += [("insertion", None, w) for w in y[k:m]]
            out.append(("hit" if len(same) else "substitution", x[i], y[m]))
            out += [("insertion", None, w) for w in y[m + 1 : n]]
        else:
            half = (i + j) // 2
            costs = _last_row(a[i:half], b[k:n]) + _last_row(a[half:j][::-1], b[k:n][::-1])[::-1]
            cut = k + int(costs.argmin())
            todo += [(half, j, cut, n), (i, half, k, cut)]
    return out


def word_edit_kinds(reference: Column, heard: Column) -> Column:
    """Struct of hits, substitutions, deletions and insertions by words, lower-cased; a null text has no words."""

    @F.pandas_udf(KINDS)
    def kinds(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_kinds(x, y) for x, y in zip(a, b, strict=True)], columns=KINDS.names, dtype="int64")

    return kinds(reference, heard)


def word_alignment(reference: Column, heard: Column) -> Column:
    """Array of (kind, reference, heard): what became of each word."""

    @F.pandas_udf(STEPS)
    def steps(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "reference", "heard"), s, strict=True)) for s in align(x, y)] for x, y in zip(a, b, strict=True)], dtype=object)

    return steps(reference, heard)


def _pair_kinds(df: DataFrame, keys: list[str], reference: str, heard: str, nli: bool = False) -> DataFrame:
    """(keys, ``_k``, ``_n``): kinds of edits of each distinct pair of texts, aligned once, and the rows that have it.

    ``nli`` also tells the rows apart whose pred is gold, as ``_nli``.
    """
    taken = [*keys, F.col(reference).alias("_x"), F.col(heard).alias("_y"), *([F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).alias("_nli")] if nli else [])]
    rows = df.select(*taken)
    pairs = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.withColumn("_k", word_edit_kinds(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def error_kinds(df: DataFrame, keys: list[str], reference: str, heard: str) -> DataFrame:
    """Hits, substitutions, deletions, insertions, words of the references and the error rate, over all rows of each group."""
    rows = _pair_kinds(df, keys, reference, heard)
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(f"_k.{n}") * F.col("_n")).alias(n) for n in KINDS.names])
    words = F.col("hits") + F.col("substitutions") + F.col("deletions")
    return sums.withColumns({"words": words, "wer": F.when(words > 0, (F.col("substitutions") + F.col("deletions") + F.col("insertions")) / words)})


def asr_by_nli(df: DataFrame, keys: list[str], reference: str, heard: str, most_wer: float = 0.0) -> DataFrame:
    """How often a wrong transcript goes with a wrong answer: rows of (gold, pred) in each of the four cells per group.

    ``asr_ok``: the row's own word error rate is at most ``most_wer``; a row whose reference has no words is right if
    nothing was heard.  ``nli_ok``: pred is gold; a missing one isn't.  Cells without rows are there with 0, and ``share``
    is a cell's part of the rows with the same ``asr_ok``.
    """
    kinds = F.col("_k")
    edits = kinds["substitutions"] + kinds["deletions"] + kinds["insertions"]
    words = kinds["hits"] + kinds["substitutions"] + kinds["deletions"]
    ok = F.when(words > 0, edits / words <= most_wer).otherwise(edits == 0)
    rows = _pair_kinds(df, keys, reference, heard, nli=True).select(*keys, ok.alias("_asr"), "_nli", "_n")
    cells = [(a, b) for a in (True, False) for b in (True, False)]
    counts = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when((F.col("_asr") == a) & (F.col("_nli") == b), F.col("_n"))), F.lit(0)).alias(f"_{a}_{b}") for a, b in cells])
    table = F.array(*[F.struct(F.lit(a).alias("asr_ok"), F.lit(b).alias("nli_ok"), F.col(f"_{a}_{b}").alias("n"), (F.col(f"_{a}_True") + F.col(f"_{a}_False")).alias("_all")) for a, b in cells])
    out = counts.select(*keys, F.explode(table).alias("c")).select(*keys, "c.*")
    return out.withColumn("share", F.when(F.col("_all") > 0, F.col("n") / F.col("_all"))).drop("_all")


def word_error_rate(df: DataFrame, keys: list[str], reference: str, heard: str) -> DataFrame:
    """Edits of all rows over the words of all references."""
    rows = df.withColumn("_e", word_edits(F.col(reference), F.col(heard))).withColumn("_n", F.size(F.filter(F.split(F.coalesce(reference, F.lit("")), r"\s+"), lambda w: w != "")))
    return rows.groupBy(*keys).agg(F.sum("_e").alias("edits"), F.sum("_n").cast("long").alias("words"), F.when(F.sum("_n") > 0, F.sum("_e") / F.sum("_n")).alias("wer"))


def run_model(df: DataFrame, init: Callable, prompt: str = "prompt", retries: int = 1) -> DataFrame:
    """Call a user's model on each prompt.  ``init()`` runs once per task and returns prompt -> answer.

    An empty answer is asked for again; an exception becomes the row's ``error``.  Adds pred_raw, error, retry_count.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("pred_raw", T.StringType()), T.StructField("error", T.StringType()), T.StructField("retry_count", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = init()
        for frame in frames:
            answers = []
            for p in frame[prompt]:
                answer, error, tries = None, None, 0
                try:
                    answer = model(p)
                    while not answer and tries < retries:
                        tries += 1
                        answer = model(p)
                except Exception as e:  # the row carries the error
                    error = f"{type(e).__name__}: {e}"
                answers.append((answer, error, tries))
            made = pd.DataFrame(answers, columns=["pred_raw", "error", "retry_count"], index=frame.index)
            yield pd.concat([frame, made], axis=1)

    return df.mapInPandas(run, schema)
