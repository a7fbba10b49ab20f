"""Benchmark decontamination: a distributed positional inverted index over the training documents.

The index is sharded by document.  A shard holds the postings of all its words: the words' hashes in order, how often each
occurs, and its positions, ascending.  ``build_index`` stores the shards as a table, so another benchmark is searched
without reading the corpus again.  A window of benchmark words occurs where the lists of its words, each shifted by the
word's offset, intersect; the search starts with the words that are rarest in the shard.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, discard, stored, table

WINDOW = 13
#: Windows of the benchmark that are broadcast at once, some 40 bytes each; more are searched block by block, one broadcast at a time.
BLOCK_WINDOWS = 1 << 20
#: Words and bytes of text in a shard, at most (or one document).
SHARD_TOKENS, SHARD_BYTES = 1_000_000, 16 << 20
#: Windows, and places of their rarest words, that are looked at together.
SEARCHED_WINDOWS, SEARCHED_PLACES = 1 << 15, 1 << 19
#: Positions left free between documents, so that no window crosses from one to the next.
GAP = 64
#: Hits and items found so far, while a benchmark of several blocks is searched.
SO_FAR = T.StructType([T.StructField("_marked", T.BinaryType()), T.StructField("_items", T.ArrayType(T.ArrayType(T.StringType())))])

#: Words are maximal runs of ASCII letters and digits and of all non-ASCII characters; the rest becomes a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased (A-Z); null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def hashes(found) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in found], dtype=np.uint64)


class Windows:
    """The distinct windows of a block of benchmark items, as flat arrays that travel to executors as they are.

    ``terms``: hashes of the block's words; ``tokens``: the items' word numbers, one item after the other; ``starts`` and
    ``lengths``: each window's place in ``tokens``; ``edges`` and ``owners``: for each window a stretch of item numbers;
    ``names``: the items' ids.
    """

    def __init__(self, arrays: tuple):
        self.terms, self.tokens, self.starts, self.lengths, self.edges, self.owners, self.names = arrays

    def present(self, here: np.ndarray) -> np.ndarray:
        """The windows all of whose words a shard has; ``here``: the words' places in it, -1 for none."""
        lacking = np.concatenate([[0], np.cumsum(here[self.tokens] < 0, dtype=np.int32)])
        return np.flatnonzero(lacking[self.starts + self.lengths] == lacking[self.starts])

    def words_of(self, window: int) -> np.ndarray:
        return self.tokens[self.starts[window] : self.starts[window] + self.lengths[window]]

    def items_of(self, window: int) -> list[str]:
        return [self.names[k] for k in self.owners[self.edges[window] : self.edges[window + 1]].tolist()]


def windows_of(items: list[tuple[str | None, list[bytes]]], size: int) -> tuple:
    """The arrays of ``Windows`` for items (id, words).  Equal windows are one; an item without an id owns none."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    held, starts, lengths, owners, names, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [], 0
    for item, found in items:
        if found:
            n = max(1, len(found) - size + 1)
            held.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
            starts.append(np.arange(at, at + n))
            lengths.append(np.full(n, min(len(found), size)))
            owners.append(np.full(n, len(names) if item is not None else -1, dtype=np.int32))
            names += [item] if item is not None else []
            at += len(found)
    tokens, starts, lengths, owners = (np.concatenate(x) for x in (held, starts, lengths, owners))
    padded = np.concatenate([tokens, np.zeros(size, np.int32)])
    mixed = (padded.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = lengths.astype(np.uint64)
    for k in range(size):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + np.where(k < lengths, mixed[starts + k], np.uint64(0))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    other = starts[first[group]]
    same = lengths == lengths[first[group]]
    for k in range(size):
        same &= (k >= lengths) | (padded[starts + k] == padded[other + k])
    # Windows whose keys only happen to be equal stand for themselves.
    odd = np.flatnonzero(~same)
    group[odd] = len(first) + np.arange(len(odd))
    chosen = np.concatenate([first, odd])
    named = np.flatnonzero(owners >= 0)
    named = named[np.argsort(group[named], kind="stable")]
    edges = np.concatenate([[0], np.cumsum(np.bincount(group[named], minlength=len(chosen)))])
    return hashes(number), tokens, starts[chosen].astype(np.int32), lengths[chosen].astype(np.int32), edges, owners[named], names


class Shard:
    """Postings of some documents: hashes of the words, ascending; how often each occurs; its positions, ascending."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.lengths, self.terms, self.counts, self.places = lengths, terms, counts, places
        self.starts = np.cumsum([GAP, *(lengths[:-1] + GAP)]) if len(lengths) else np.zeros(0, np.int64)
        self.end = int(self.starts[-1] + lengths[-1] + GAP) if len(lengths) else GAP
        self.ends = np.cumsum(counts, dtype=np.int64)

    @classmethod
    def of(cls, docs: list[list[bytes]]) -> Shard:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = [np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens)) for tokens in docs]
        lengths = np.array([len(t) for t in docs], dtype=np.int64)
        terms = hashes(number)
        order = np.argsort(terms)
        rank = np.empty(len(terms), dtype=np.int32)
        rank[order] = np.arange(len(terms), dtype=np.int32)
        flat = rank[np.concatenate(ids)] if len(terms) else np.zeros(0, np.int32)
        shard = cls(lengths, terms[order], np.bincount(flat, minlength=len(terms)).astype(np.int32), np.zeros(0, np.int32))
        at = np.repeat(shard.starts - np.cumsum([0, *lengths[:-1]]), lengths) + np.arange(len(flat)) if len(lengths) else np.zeros(0, np.int64)
        shard.places = at[np.argsort(flat, kind="stable")].astype(np.int32)
        return shard

    def look_up(self, terms: np.ndarray) -> np.ndarray:
        """The places of these hashes among the shard's terms; -1 where it lacks one."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        return np.where(there, at, -1)

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.ends[term] - self.counts[term] : self.ends[term]].astype(np.int64)

    def occurrences(self, window: np.ndarray, slack: int = 0) -> np.ndarray:
        """Start positions at which every term stands at its offset, or within ``slack`` of it."""
        order = np.argsort(self.counts[window], kind="stable")
        rare = order[0]
        starts = self.list_of(window[rare]) - rare
        if slack:
            starts = np.unique((starts[:, None] + np.arange(-slack, slack + 1)).ravel())
        for k in order[1:]:
            if not len(starts):
                break
            listed = self.list_of(window[k])
            near = np.searchsorted(listed, starts + k - slack)
            ok = near < len(listed)
            ok[ok] = listed[near[ok]] <= starts[ok] + k + slack
            starts = starts[ok]
        return starts

    def near(self, windows: Windows, here: np.ndarray, slack: int):
        """(windows, start positions) of the places within ``slack``, window by window."""
        for w in windows.present(here).tolist():
            starts = self.occurrences(here[windows.words_of(w)], slack)
            if len(starts):
                yield np.full(len(starts), w), starts

    def exact(self, windows: Windows, here: np.ndarray):
        """(windows, start positions) of exact occurrences, many windows at a time.

        Each window's candidates are the places of its rarest word, moved by that word's offset; those stay at which
        every other word has a place too.  ``text`` has the lists turned round: which word is at a place.
        """
        if not len(self.terms):
            return
        text = np.full(self.end + GAP, -1, dtype=np.int32)
        text[self.places] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.counts)
        present, size = windows.present(here), int(windows.lengths.max(initial=0))
        for lo in range(0, len(present), SEARCHED_WINDOWS):
            chosen = present[lo : lo + SEARCHED_WINDOWS]
            inside = np.arange(size) < windows.lengths[chosen][:, None]
            cells = np.where(inside, here[windows.tokens[np.where(inside, windows.starts[chosen][:, None] + np.arange(size), 0)]], 0)
            often = np.where(inside, self.counts[cells], np.iinfo(np.int32).max)
            offset = often.argmin(axis=1)
            term, n = cells[np.arange(len(chosen)), offset], often.min(axis=1).astype(np.int64)
            upto = np.cumsum(n)
            at = 0
            while at < len(chosen):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SEARCHED_PLACES, side="right")))
                of = np.repeat(np.arange(at, to), n[at:to])
                first = self.ends[term[at:to]] - n[at:to]
                within = np.arange(len(of)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
                starts = self.places[np.repeat(first, n[at:to]) + within].astype(np.int64) - offset[of]
                for k in range(size):
                    ok = (text[starts + k] == cells[of, k]) | ~inside[of, k]
                    of, starts = of[ok], starts[ok]
                if len(of):
                    yield chosen[of], starts
                at = to

    def search(self, windows: Windows, slack: int, marked: np.ndarray, items: list[set[str]]) -> None:
        """Mark the words in exact occurrences (with ``slack``: the start positions), and add the items to their documents'."""
        here = self.look_up(windows.terms)
        edges = np.zeros(self.end + GAP, dtype=np.int32)
        found = self.near(windows, here, slack) if slack else self.exact(windows, here)
        for w, starts in found:
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + (1 if slack else windows.lengths[w]), -1)
            # With slack, a start may lie just before the first word of its document.
            at = np.searchsorted(self.starts, starts + slack, side="right") - 1
            for d, k in set(zip(at.tolist(), w.tolist(), strict=True)):
                items[d].update(windows.items_of(k))
        marked |= np.cumsum(edges) > 0

    def count(self, marked: np.ndarray, slack: int) -> list[int]:
        upto = np.concatenate([[0], np.cumsum(marked)])
        return (upto[self.starts + self.lengths] - upto[self.starts - slack]).tolist()


def _shards(texts):
    """Index the texts in turn: (how many, Shard)."""
    held, size, n = [], 0, 0
    for text in texts:
        found = text.as_py()
        held.append(words(found))
        size += len(found or "")
        n += len(held[-1])
        if n >= SHARD_TOKENS or size >= SHARD_BYTES:
            yield len(held), Shard.of(held)
            held, size, n = [], 0, 0
    if held:
        yield len(held), Shard.of(held)


def build_index(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The stored index: a row for each shard, with arrays of the kept columns' values and the postings.

    A shard has documents of one partition; nothing is shuffled.  Null and empty texts are documents without words.
    """
    kept = [f for f in docs.schema.fields if f.name in (keep if keep is not None else docs.columns)]
    names = [f.name for f in kept]
    schema = T.StructType([*[T.StructField(f.name, T.ArrayType(f.dataType)) for f in kept], T.StructField("_lengths", T.BinaryType()), T.StructField("_terms", T.BinaryType()), T.StructField("_counts", T.BinaryType()), T.StructField("_places", T.BinaryType())])

    def run(batches):
        for batch in batches:
            at = 0
            for n, shard in _shards(batch.column("_text")):
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(c).slice(at, n)) for c in names]
                parts = [pa.array([x.tobytes()], pa.binary()) for x in (shard.lengths, shard.terms, shard.counts, shard.places)]
                yield pa.RecordBatch.from_arrays([*lists, *parts], names=[*names, "_lengths", "_terms", "_counts", "_places"])
                at += n

    source = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_col}`").alias("_text"))
    return stored(source.mapInArrow(run, schema))


def search_index(index: DataFrame, bench: DataFrame, fields: list[T.StructField], finish, slack: int = 0, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per indexed document: its kept columns, and what ``finish(lengths, hits, items)`` makes of a shard.

    A benchmark of several blocks is searched block by block: the hits so far are stored between them, and a block's
    broadcast is dropped before the next, so executors hold one at a time.
    """
    check_slack(slack)
    return _search_blocks(index, _blocks(bench, item_col, text_col, window), fields, finish, slack)


def _search_blocks(index: DataFrame, blocks, fields: list[T.StructField], finish, slack: int) -> DataFrame:
    spark = index.sparkSession
    kept = [f for f in index.schema.fields if not f.name.startswith("_")]
    names, new = [f.name for f in kept], {f.name.lower() for f in fields}
    out_fields = [T.StructField(f.name, f.dataType.elementType) for f in kept if f.name.lower() not in new]
    sent = None

    def searched(batches, sent, last):
        windows = Windows(sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(*[np.frombuffer(batch.column(c)[k].as_py(), dtype=t) for c, t in (("_lengths", np.int64), ("_terms", np.uint64), ("_counts", np.int32), ("_places", np.int32))])
                marked, items = np.zeros(shard.end + GAP, dtype=bool), [set() for _ in shard.lengths]
                if "_marked" in batch.schema.names:
                    marked = np.unpackbits(np.frombuffer(batch.column("_marked")[k].as_py(), np.uint8), count=shard.end + GAP).astype(bool)
                    items = [set(x) for x in batch.column("_items")[k].as_py()]
                shard.search(windows, slack, marked, items)
                if last:
                    made = [x if isinstance(x, pa.Array) else pa.array(x) for x in finish(shard.lengths.tolist(), shard.count(marked, slack), items)]
                    lists = [batch.column(f.name)[k].values for f in out_fields]
                    yield pa.RecordBatch.from_arrays([*lists, *made], names=[f.name for f in [*out_fields, *fields]])
                else:
                    before = [batch.column(c).slice(k, 1) for c in [*names, "_lengths", "_terms", "_counts", "_places"]]
                    so_far = [pa.array([np.packbits(marked).tobytes()], pa.binary()), pa.array([[sorted(x) for x in items]], pa.list_(pa.list_(pa.string())))]
                    yield pa.RecordBatch.from_arrays([*before, *so_far], names=[*names, "_lengths", "_terms", "_counts", "_places", "_marked", "_items"])

    state = index
    for block, last in blocks:
        sent = spark.sparkContext.broadcast(block)
        if last:
            return state.mapInArrow(lambda b, sent=sent: searched(b, sent, True), T.StructType([*out_fields, *fields]))
        plain = [f for f in index.schema.fields]
        following = stored(state.mapInArrow(lambda b, sent=sent: searched(b, sent, False), T.StructType([*plain, *SO_FAR.fields])))
        sent.destroy()
        if state is not index:
            discard(state)
        state = following


def check_slack(slack: int) -> None:
    if not 0 <= slack < GAP // 2:
        raise ValueError(f"slack must be less than {GAP // 2}: matches would reach into the next document")


def _blocks(bench: DataFrame, item_col: str, text_col: str, size: int):
    """The benchmark's windows in blocks of about BLOCK_WINDOWS (or one item), one at a time, and whether each is the last."""
    if size > GAP:
        raise ValueError(f"windows of over {GAP} words would reach into the next document")
    held, n = [], 0
    for item, text in bench.select(F.col(item_col).cast("string"), text_col).toLocalIterator(prefetchPartitions=True):
        if held and n >= BLOCK_WINDOWS:
            yield windows_of(held, size), False
            held, n = [], 0
        held.append((item, words(text)))
        n += len(held[-1][1]) + 1
    yield windows_of(held, size), True


def _found(docs: DataFrame, bench: DataFrame, fields: list[T.StructField], finish, slack: int, text_col: str, item_col: str, window: int, keep: list[str] | None) -> DataFrame:
    """Through the stored index; where the texts themselves are kept, each shard is searched when it is indexed instead, so
    that they aren't written twice, unless the benchmark has several blocks."""
    check_slack(slack)
    blocks = _blocks(bench, item_col, "text", window)
    block, only = next(blocks)
    if not only or (keep is not None and text_col not in keep):
        return _search_blocks(build_index(docs, text_col, keep), chain([(block, only)], blocks), fields, finish, slack)
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        windows = Windows(sent.value)

        def run(texts):
            parts = []
            for _, shard in _shards(texts):
                marked, items = np.zeros(shard.end + GAP, dtype=bool), [set() for _ in shard.lengths]
                shard.search(windows, slack, marked, items)
                parts.append([x.to_pylist() if isinstance(x, pa.Array) else x for x in finish(shard.lengths.tolist(), shard.count(marked, slack), items)])
            return [pa.array([v for part in column for v in part], type=pa.list_(pa.string())) if isinstance(f.dataType, T.ArrayType) else [v for part in column for v in part] for f, column in zip(fields, zip(*parts, strict=True), strict=True)]

        return run

    return annotate(docs, [text_col], make, fields, keep)


def find_contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Exact occurrences of benchmark windows in documents.

    Texts are lower-cased (A-Z) and cut into words (runs of ASCII letters, digits and non-ASCII characters).  A window
    is ``window`` consecutive words of an item; an item of fewer words is one window.  A document's word is hit if it
    lies in any occurrence.  Adds ``n_words``, ``n_hit``, ``n_items`` (long), ``items_sha256`` (of the sorted item ids,
    comma-joined) and ``contaminated`` (at least one hit and 5 % of the words).

    A null text has no words, 0 hits and isn't contaminated; items of null text or without words have no windows; items
    with a null id hit, but aren't listed.  Repeated items count once by id.  Input columns with the names of the new
    ones are replaced.  Words are told apart by 64 bits of their hash.
    """

    def finish(lengths, hits, items):
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        return lengths, hits, [len(x) for x in items], sha, [h > 0 and 20 * h >= n for h, n in zip(hits, lengths, strict=True)]

    return _found(docs, bench, RESULT, finish, 0, text_col, item_col, window, keep)


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]


def find_near(docs: DataFrame, bench: DataFrame, slack: int = 2, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Proximity matches: a window matches at a place if each of its words stands within ``slack`` of where it should.

    Adds ``n_places`` (long: places with a match) and ``near_items`` (array of item ids, sorted).  Exact occurrences
    match too.  Nulls and clashing names as in ``find_contamination``.
    """
    fields = [T.StructField("n_places", T.LongType()), T.StructField("near_items", T.ArrayType(T.StringType()))]
    return _found(docs, bench, fields, lambda lengths, hits, items: (hits, pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))), slack, text_col, item_col, window, keep)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hits and items, from the stored index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def llm_proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places and items of near matches, from the stored index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = find_near(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return near.select("doc_id", "n_places", F.array_join("near_items", ",").alias("near_items"))


ORACLE = {
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), starts AS (
  SELECT item_id, ws, least(len(ws), 13) AS n, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram FROM starts
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n
), grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram FROM places
), hits AS (
  SELECT g.doc_id, g.i, g.n, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
""",
}
