"""Periodic run detection: dyadic square catching over the words of each text, online.

A completed block of 2^k words, at a multiple of 2^k, has a catcher for the periods 2^(k+1) - 1 to 2^(k+2) - 2, which
together cover all periods.  As words are appended, each suffix of 2^k words is compared with the blocks that lie such a
period before it; where they agree, a square is caught, and squares of one period at successive blocks merge into one
repetition.  A repetition whose next block disagrees is closed: its ends are found word by word, and it becomes a run.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, annotate, table

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Words appended at a time, and words of short texts that are worked on together.
CHUNK, GROUP = 1 << 18, 1 << 15
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
ARROW_RUN = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))


class Catchers:
    """Catchers of all blocks of 2^k words whose periods are still open, and the squares they have caught."""

    def __init__(self, k: int):
        self.block, self.least = 1 << k, (2 << k) - 1
        #: Hashes of the suffixes of ``block`` words, from position ``base`` on.
        self.base, self.hashes = 0, np.zeros(0, np.uint64)
        #: Open repetitions: period, first and last block.
        self.open = np.zeros((3, 0), np.int64)

    def extend(self, hashes: np.ndarray) -> None:
        self.hashes = np.concatenate([self.hashes, hashes]) if len(self.hashes) else hashes

    @property
    def end(self) -> int:
        return self.base + len(self.hashes)

    def catch(self, seen: int) -> np.ndarray:
        """Compare the suffixes that start at ``seen`` or later; returns the repetitions that have come to an end."""
        b, p = self.block, np.arange(max(seen, self.least), self.end, dtype=np.int64)
        blocks = (p - self.least) & -b
        own = self.hashes[p - self.base]
        near = np.flatnonzero(own == self.hashes[blocks - self.base])
        wide = np.flatnonzero((own == self.hashes[np.maximum(blocks - b, self.base) - self.base]) & (blocks >= b))
        at, starts = np.concatenate([p[near], p[wide]]), np.concatenate([blocks[near], blocks[wide] - b])
        caught = merge(np.concatenate([self.open, np.stack([at - starts, starts, starts])], axis=1), b)
        over = caught[2] + b + caught[0] < self.end
        self.open = caught[:, ~over]
        return caught[:, over]

    def forget(self) -> None:
        """Drop hashes that no period of this level reaches any more."""
        drop = self.end - 6 * self.block - self.base
        if drop > self.block:
            self.base, self.hashes = self.base + drop, self.hashes[drop:].copy()


def merge(squares: np.ndarray, block: int) -> np.ndarray:
    """Join repetitions (period, first block, last block) of one period that follow each other."""
    if squares.shape[1] < 2:
        return squares
    period, first, last = squares[:, np.lexsort((squares[1], squares[0]))]
    new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (first[1:] != last[:-1] + block)]))
    ends = np.concatenate([new[1:], [len(period)]]) - 1
    return np.stack([period[new], first[new], last[ends]])


class Runs:
    """The runs found so far; a multiple of a run's period repeats over just the same words, so the smallest one counts."""

    def __init__(self, periods: dict | None = None, starts: list | None = None):
        #: Period by (start, end), and the same as a sorted list.
        self.periods, self.starts = periods or {}, starts or []

    def copy(self) -> Runs:
        return Runs(dict(self.periods), list(self.starts))

    def explains(self, start: int, end: int, period: int) -> bool:
        """Whether one of the last runs before ``start`` covers this repetition; a miss costs time only."""
        at = bisect_right(self.starts, (start, 1 << 62, 0))
        return any(e >= end and period % q == 0 for _, e, q in self.starts[max(0, at - 4) : at])

    def add(self, start: int, end: int, period: int) -> None:
        if period < self.periods.get((start, end), period + 1):
            self.periods[start, end] = period
            insort(self.starts, (start, end, period))


class RunFinder:
    """Finds all maximal runs of a growing sequence of word numbers.

    ``append`` takes one number or many; ``runs`` may be asked for at any time and is exact for what has been appended.
    Hashes only propose: every run is read off the words themselves.  ``longest``: no run is longer than this, so longer
    periods have no catchers.
    """

    def __init__(self, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, longest: int = 1 << 62):
        if least_exponent < 3:
            raise ValueError("blocks of this size are sure to lie in runs of exponent 3 or more")
        self.least_length, self.least_exponent, self.longest = least_length, least_exponent, longest
        self.words, self.n = np.zeros(0, np.int64), 0
        self.levels: list[Catchers] = []
        self.found = Runs()

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            grown = np.empty(max(self.n, 2 * before), np.int64)
            grown[:before] = self.words[:before]
            self.words = grown
        self.words[before : self.n] = words
        k = 0
        while 1 << k <= self.n and ((2 << k) - 1) * self.least_exponent <= self.longest:
            if k == len(self.levels):
                self.levels.append(Catchers(k))
            level = self.levels[k]
            seen = level.end
            if k == 0:
                level.extend((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            else:
                half = self.levels[k - 1]
                pairs = half.hashes[seen - half.base :]
                if len(pairs) > half.block:
                    turn = np.uint64((0xBF58476D1CE4E5B9 + 2 * k * 0x94D049BB133111EB) & (1 << 64) - 1)
                    level.extend((pairs[: -half.block] ^ pairs[: -half.block] >> np.uint64(29)) * turn + pairs[half.block :])
            self._close(level.catch(seen), level.block, self.found)
            k += 1
        for level in self.levels:
            level.forget()

    def _close(self, caught: np.ndarray, block: int, found: Runs) -> None:
        """Runs of repetitions that have ended: those long enough are read word by word, from one block before to one after."""
        if not caught.shape[1]:
            return
        period, first, last = caught
        need = np.maximum((self.least_exponent - 1) * period, self.least_length - period)
        long = np.flatnonzero(last - first + block + 2 * (block - 1) >= need)
        for q, a, z, least in zip(period[long].tolist(), first[long].tolist(), last[long].tolist(), need[long].tolist(), strict=True):
            if found.explains(a, z + block + q, q):
                continue
            low, high = max(0, a - block), min(z + 2 * block, self.n - q)
            same = np.concatenate([[False], self.words[low:high] == self.words[low + q : high + q], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
            for s, e in edges[edges[:, 1] - edges[:, 0] >= least].tolist():
                found.add(low + s, low + e + q, q)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start, then period."""
        found = self.found.copy()
        for level in self.levels:
            self._close(level.open, level.block, found)
        return sorted((s, e - s, q) for (s, e), q in found.periods.items())


def runs_of(texts: list[list], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """All maximal runs of each list of words.

    The lists are appended one after the other, each closed by a number that occurs nowhere else, so no run crosses it.
    """
    numbers: dict = defaultdict(count().__next__)
    ids = np.full(sum(map(len, texts)) + len(texts), -1, np.int64)
    starts, at = [], 0
    for k, words in enumerate(texts):
        starts.append(at)
        ids[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        ids[at + len(words)] = -1 - k
        at += len(words) + 1
    longest = max(map(len, texts), default=0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if longest >= least_length:
        finder = RunFinder(least_length, least_exponent, longest)
        for at in range(0, len(ids), CHUNK):
            finder.append(ids[at : at + CHUNK])
        for s, n, q in finder.runs():
            k = bisect_right(starts, s) - 1
            out[k].append((s - starts[k], n, q))
    return out


def collapse_runs(docs: DataFrame, text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Find the periodic runs of words in each text, and the text with each run cut to its first period.

    Words are runs of non-blank characters.  A run is a stretch of words in which each word equals the one ``period``
    places on, as long as possible, of at least ``least_length`` words and ``least_exponent`` (3 or more) periods; its
    period is the smallest.  Runs may overlap.

    Returns the columns of ``docs`` with ``runs`` (array of start, length and period, by start, then period) and
    ``collapsed`` (the words left, joined by one space: those that no run contains after its first period).

    A null or blank text has no words: no run, and an empty ``collapsed``.  Rows are judged one by one, so repeated rows
    and null ids are like any other.  Input columns named ``runs`` or ``collapsed`` are replaced.
    """

    def cut(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
        if found:
            gone = np.zeros(len(words) + 1, np.int64)
            for s, n, q in found:
                gone[s + q] += 1
                gone[s + n] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        return b" ".join(words)

    def make():
        def work(texts):
            runs, collapsed, group, size = [], [], [], 0

            def finish():
                for words, found in zip(group, runs_of(group, least_length, least_exponent), strict=True):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    collapsed.append(cut(words, found))
                group.clear()

            for text in texts.cast(pa.binary()):
                group.append((text.as_py() or b"").split())
                size += len(group[-1])
                if size >= GROUP:
                    finish()
                    size = 0
            finish()
            return [pa.array(runs, ARROW_RUN), pa.array(collapsed, pa.binary()).cast(pa.string())]

        return work

    return annotate(docs, [text_col], make, [T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: in every tenth document by crc32 of the id, the words from one on repeat with a period."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document: their number, the one of the greatest exponent, and digests of all runs and of the rest.

    A null id has no crc32, so its text stays as it is.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = collapse_runs(docs).select("doc_id", "runs", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    first = F.expr(
        "array_sort(runs, (a, b) -> CASE WHEN a.length * b.period > b.length * a.period THEN -1 WHEN a.length * b.period < b.length * a.period THEN 1"
        " WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END)"
    )
    best = found.withColumn("_best", F.try_element_at(first, F.lit(1)))
    all_runs = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(all_runs.cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
