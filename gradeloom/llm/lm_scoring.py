"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(group | class, context) * P(token | group).  The first two factors are
softmaxes over hashed n-gram and skip features of the three tokens before.  The most frequent tokens are a group each, so
for them the last factor is 1; the other tokens of a group share it by their counts.

Training climbs the log-likelihood by sums over all training documents, so the model doesn't depend on partitions.  The
first step starts at the unigram model, where the gradient of a weight is observed minus expected occurrences; divided by
their logarithmic mean it is the log of their ratio, by which each weight moves.  The next steps train how far: a factor
for each kind of feature and size of row, by Newton steps over gradients that leave the token at hand out of its own row.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, batches_of, fold, stored, table

CLASSES, GROUPS = 32, 32
#: The most frequent tokens have a group each; all others go by their last two characters.
OWN_GROUP = CLASSES * GROUPS // 2
#: Kinds of features: the token before, the groups of the two before, of the second before and of the third before.
FEATURES = 4
#: Rows of hashed weights: one for so many training tokens, within these bounds (the upper one bounds the broadcast).
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 16, 1 << 12, 1 << 16
#: Occurrences that a weight's ratio is smoothed by.
SMOOTH = 2.0
#: Sizes of rows told apart, in powers of four, and Newton steps; a document belongs to one step.
SIZES, STEPS = 8, 3
#: A factor's distance from its start counts as so many nats squared.
RIDGE = 10.0
#: Positions worked on at a time, and read at a time.
BLOCK_TOKENS, READ_TOKENS = 1 << 13, 1 << 16
#: Most tokens, and most bytes of tokens, whose counts are broadcast; the counts of all others are joined.
HEAD, HEAD_BYTES = 1 << 17, 8 << 20
#: Longer tokens are never broadcast.
LONGEST = 256
#: Distinct tokens that a task counts before it passes them on, and their bytes.
HELD, HELD_BYTES = 1 << 20, 64 << 20
#: Ends of tokens whose groups are held.
MOST_ENDS = 1 << 16
#: Hashes of tokens keep 21 bits, so that one and a group fit into 31: some 30 times as many as rows of weights.
HASH_SHIFT = 11
#: Tokens beside the frequent ones whose codes are held.
MOST_CODES = 1 << 18
#: Documents in a batch: what a worker and its executor hold of texts, tokens and scores at a time.
BATCH_ROWS = 1 << 11
ALPHA = 0.1
ONES = np.ones(CLASSES, np.float32)


def tokens(text: str | None) -> list[bytes]:
    """Non-blank runs, lower-cased (A-Z), and the end, which is the empty token."""
    return [*(text.encode("utf-8", "surrogatepass").lower().split() if text else ()), b""]


def token_counts(texts: DataFrame) -> DataFrame:
    """(token string, n long) over a single text column."""

    def count(batches):
        from collections import Counter

        held: Counter = Counter()
        size = 0

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["token", "n"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                size += len(text.as_py() or "")
                if len(held) >= HELD or size >= HELD_BYTES:
                    yield out()
                    size = 0
        yield out()

    return texts.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class EndGroups(dict):
    """Groups by the last two characters: the class goes by the last one, the group within it by both.

    Filled as ends come up, and emptied when MOST_ENDS are held.  A plain dict, so that it travels by value.
    """

    def __missing__(self, end: str) -> int:
        half = CLASSES // 2
        if len(self) >= MOST_ENDS:
            self.clear()
        self[end] = group = (half + crc32(end[-1:].encode()) % half) * GROUPS + crc32(end.encode()) % GROUPS
        return group


def _tail_group(token: bytes, ends: EndGroups) -> int:
    end = token[-2:]
    return ends[end.decode() if end.isascii() else token[-8:].decode("utf-8", "replace")[-2:]]


class Vocabulary:
    """Counts, groups and hashes of the frequent tokens, by number."""

    def __init__(self, head: list[str], counts: np.ndarray):
        toks, ends = [t.encode("utf-8", "surrogatepass") for t in head], EndGroups()
        self.head, self.counts = head, counts
        self.groups = np.array([k if k < OWN_GROUP else _tail_group(t, ends) for k, t in enumerate(toks)], dtype=np.int64)
        self.hashes = np.array([crc32(t) >> HASH_SHIFT for t in toks], dtype=np.int64)


class Codes(dict):
    """Tokens to numbers: a frequent one's own, from 0; any other's is below zero and holds its hash and group.

    Up to MOST_CODES of the others are held.
    """

    def __init__(self, head: list[str]):
        super().__init__((t.encode("utf-8", "surrogatepass"), k) for k, t in enumerate(head))
        self.ends, self.room = EndGroups(), MOST_CODES

    def __missing__(self, token: bytes) -> int:
        code = -1 - ((crc32(token) >> HASH_SHIFT) * CLASSES * GROUPS + _tail_group(token, self.ends))
        if self.room:
            self[token] = code
            self.room -= 1
        return code

    def read(self, toks: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, toks), dtype=np.int32, count=len(toks))


def decode(codes: np.ndarray, groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and hashes of coded tokens; ``groups`` and ``hashes`` are those of the frequent ones."""
    rare, packed = codes < 0, -1 - codes
    at = np.where(rare, 0, codes)
    known = (groups[at], hashes[at]) if len(groups) else (0, 0)
    return np.where(rare, packed % (CLASSES * GROUPS), known[0]), np.where(rare, packed // (CLASSES * GROUPS), known[1])


def encode(texts: DataFrame, head, keep: list[str]) -> DataFrame:
    """The kept columns of a table with ``_text``, and its tokens: ``_codes``, and each rare token of a text with its
    count, ``_names`` and ``_times``.  Stored by ``_step``, so tokens are read from text once and a step reads its own."""

    def make():
        codes = Codes(head.value)

        def run(texts):
            from collections import Counter

            coded, ends, names, times, edges = [], [0], [], [], [0]
            for text in texts:
                toks = tokens(text.as_py())
                coded.append(codes.read(toks))
                ends.append(ends[-1] + len(toks))
                rare = Counter([toks[k] for k in np.flatnonzero(coded[-1] < 0).tolist()])
                names.extend(rare)
                times.extend(rare.values())
                edges.append(len(names))
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            return lists(ends, pa.array(np.concatenate(coded))), lists(edges, pa.array(names, pa.binary()).cast(pa.string())), lists(edges, pa.array(times, pa.int64()))

        return run

    fields = [T.StructField("_codes", T.ArrayType(T.IntegerType())), T.StructField("_names", T.ArrayType(T.StringType())), T.StructField("_times", T.ArrayType(T.LongType()))]
    made = annotate(texts, ["_text"], make, fields, keep=keep)
    return stored(made, by=("_step",))


def feature_rows(groups: np.ndarray, hashes: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the four features of each position; the two skip features have rows of their own, the others are hashed.

    ``starts``: at which positions a document begins; what would lie before it is a mark of its own.
    """
    n, width = len(groups), CLASSES * GROUPS + 1
    since = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))

    def back(x: np.ndarray, k: int) -> np.ndarray:
        return np.where(since >= k, np.concatenate([np.zeros(min(k, n), np.int64), x[: max(0, n - k)]]) + 1, 0)

    one, two, three = (back(groups, k) for k in (1, 2, 3))

    def mixed(x: np.ndarray, salt: int) -> np.ndarray:
        h = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)

    free = rows - 2 * width
    return np.stack([2 * width + mixed(back(hashes, 1), 1) % free, 2 * width + mixed(one * width + two, 1 << 41) % free, two, width + three], axis=1)


def inner_rows(feats: np.ndarray, cls: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the second softmax: the features' rows, moved by the class."""
    return (feats + (cls * 40503)[:, None]) % rows


class Model:
    """Weights by row of both softmaxes, their biases, and the factors by kind of feature and size of row."""

    def __init__(self, state: dict, factors: np.ndarray):
        """``state``: what ``weights_of`` returns, so plain arrays travel to the executors."""
        self.weights, self.seen, self.prior, self.bias, self.size = (state[k] for k in ("weights", "seen", "prior", "bias", "size"))
        self.rows, self.state, self.factors = len(self.weights[0]), state, factors
        self.scaled = None
        self.by_row = [[factors[k, f].astype(np.float32)[self.size[k]] for f in range(FEATURES)] for k in range(2)]

    def parts(self, feats: np.ndarray, group: np.ndarray):
        """For both softmaxes: its number, the rows, the biases and the right cell of each position."""
        cls = group // GROUPS
        yield 0, feats, self.bias[0][None, :], cls
        yield 1, inner_rows(feats, cls, self.rows), self.bias[1][cls], group % GROUPS

    def log_probs(self, feats: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Natural logs of P(class | context) P(group | class, context)."""
        out, at = np.zeros(len(group)), np.arange(len(group))
        if self.scaled is None:
            self.scaled = [[self.weights[k] * x[:, None] for x in self.by_row[k]] for k in range(2)]
        for k, rows, bias, gold in self.parts(feats, group):
            z = np.take(self.scaled[k][0], rows[:, 0], axis=0)
            for f in range(1, FEATURES):
                z += np.take(self.scaled[k][f], rows[:, f], axis=0)
            z += bias
            right = z.ravel().take(at * CLASSES + gold)
            # Sums of a few log ratios: far from where exp overflows.
            out += right - np.log(np.exp(z, out=z) @ ONES)
        return out

    def gradients(self, feats: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the positions of the log-likelihood's gradient in the factors, and of its outer products.

        Each position is left out of its own rows, so that rows of few occurrences aren't trusted for knowing it.
        """
        n, width = len(group), FEATURES * SIZES
        grad, outer, at = np.zeros((2, width)), np.zeros((2, width, width)), np.arange(n)
        for k, rows, bias, gold in self.parts(feats, group):
            cell = at * CLASSES + gold
            own, p = self.seen[k].ravel().take(rows * CLASSES + gold[:, None]), self.prior[k].take(gold)[:, None]
            less = np.log((np.maximum(own - 1, 0) + p) / (own + p))
            w = [self.weights[k].take(rows[:, f], axis=0) for f in range(FEATURES)]
            scale = np.stack([self.by_row[k][f].take(rows[:, f]) for f in range(FEATURES)], axis=1)
            z = w[0] * scale[:, :1]
            for f in range(1, FEATURES):
                z += w[f] * scale[:, f : f + 1]
            z += bias
            flat = z.ravel()
            flat[cell] += (less * scale).sum(axis=1)
            np.exp(z, out=z)
            z /= (z @ ONES)[:, None]
            miss = 1 - flat.take(cell)
            g = np.stack([w[f].ravel().take(cell) - np.einsum("nc,nc->n", w[f], z) for f in range(FEATURES)], axis=1) + less * miss[:, None]
            each = np.zeros(n * width, np.float32)
            each[(at * width)[:, None] + np.arange(FEATURES) * SIZES + self.size[k].take(rows)] = g
            each = each.reshape(n, width)
            grad[k], outer[k] = each.sum(axis=0, dtype=np.float64), each.T @ each
        return grad, outer


def weights_of(seen: tuple[np.ndarray, np.ndarray], share: np.ndarray) -> dict:
    """The first step: from the occurrences (rows x classes; rows x groups) and the unigram shares of the groups."""
    cells = share.reshape(CLASSES, GROUPS)
    outer, inner = cells.sum(axis=1), cells / cells.sum(axis=1, keepdims=True)
    total = [x.sum(axis=1) for x in seen]
    # In a row of the second softmax the classes mix as they do in the rows of the first that were moved there.
    wanted = np.zeros(seen[1].shape)
    for c in range(CLASSES):
        wanted += np.roll(seen[0][:, c], c * 40503 % len(wanted))[:, None] * inner[c]
    expected = (total[0][:, None] * outer, wanted)
    prior = (SMOOTH * outer, SMOOTH * inner.mean(axis=0))
    return {
        "weights": [np.log((s + p) / (e + p)).astype(np.float32) for s, e, p in zip(seen, expected, prior, strict=True)],
        "seen": [x.astype(np.float32) for x in seen],
        "prior": [x.astype(np.float32) for x in prior],
        "bias": [np.log(outer).astype(np.float32), np.log(inner).astype(np.float32)],
        "size": [np.minimum(SIZES - 1, np.log2(t + 1) / 2).astype(np.int8) for t in total],
    }


def _stretches(column: pa.ListArray, groups: np.ndarray, hashes: np.ndarray, rows: int):
    """(codes, groups, features, first positions of documents) of a column of codes, some whole documents at a time.

    Every document has a token, its end.
    """
    edges, codes = column.offsets.to_numpy().astype(np.int64), column.flatten().to_numpy().astype(np.int64)
    edges = edges - edges[0]
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + READ_TOKENS, side="right")) - 1)
        part, begins = codes[edges[lo] : edges[hi]], edges[lo:hi] - edges[lo]
        first = np.zeros(len(part), dtype=bool)
        first[begins] = True
        g, h = decode(part, groups, hashes)
        yield part, g, feature_rows(g, h, first, rows), begins
        lo = hi


def _blocks(column: pa.ListArray, groups: np.ndarray, hashes: np.ndarray, rows: int, size: int = BLOCK_TOKENS):
    """Arrays (features, groups) of at most ``size`` tokens; features reach over a block's edge, never over a document's."""
    for _, g, feats, _ in _stretches(column, groups, hashes, rows):
        for lo in range(0, len(g), size):
            yield feats[lo : lo + size], g[lo : lo + size]


def count_features(texts: DataFrame, numbers, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each class in each row, and of each group within its class; a table of bounded size reaches the driver."""
    names = [f"n{k}" for k in range(CLASSES)]
    assert CLASSES == GROUPS

    def count(batches):
        seen = np.zeros((2, rows * CLASSES), dtype=np.int32)
        for batch in batches:
            for feats, group in _blocks(batch.column(0), *numbers.value, rows):
                cls = group // GROUPS
                for k, (r, gold) in enumerate(((feats, cls), (inner_rows(feats, cls, rows), group % GROUPS))):
                    # In place: a block touches few of the cells, of which there are millions.
                    np.add.at(seen[k], (r * CLASSES + gold[:, None]).ravel(), np.int32(1))
        seen = seen.reshape(2 * rows, CLASSES)
        used = np.flatnonzero(seen.any(axis=1))
        for lo in range(0, len(used), 1 << 14):
            at = used[lo : lo + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(seen[at, k].astype(np.int64)) for k in range(CLASSES)]], names=["r", *names])

    sums = texts.mapInArrow(count, ", ".join(["r int", *[f"{n} long" for n in names]])).groupBy("r").agg(*[F.sum(n).alias(n) for n in names])
    # As bytes, a row of counts stays small on its way.
    packed = sums.select("r", F.array(*[F.col(n).cast("float") for n in names]).alias("n"))
    seen = np.zeros((2 * rows, CLASSES))
    got = packed.toArrow()
    if got.num_rows:
        flat = got.column("n").combine_chunks()
        seen[got.column("r").to_numpy()] = flat.flatten().to_numpy().reshape(-1, CLASSES)
    return seen[:rows], seen[rows:]


def train(texts: DataFrame, numbers, share: np.ndarray, rows: int, steps: int = STEPS) -> Model:
    """``texts``: (_codes, _step).  All documents are counted; each then takes part in the gradient of one step.

    The sums of a step are a few thousand numbers; they reach the driver from a distributed aggregation.
    """
    spark = texts.sparkSession
    # The steps' folders have a file each from every task that wrote them: counted together again, so that there are no more
    # tables of counts than texts had partitions.
    together = texts.select("_codes").coalesce(max(1, texts.rdd.getNumPartitions() // STEPS))
    state = weights_of(count_features(together, numbers, rows), share)
    factors = np.full((2, FEATURES, SIZES), 1.0 / FEATURES)
    shared = spark.sparkContext.broadcast(state)
    width = FEATURES * SIZES
    for step in range(steps):

        def climb(batches, factors=factors):
            model = Model(shared.value, factors)
            grad, outer = np.zeros((2, width)), np.zeros((2, width, width))
            for batch in batches:
                for feats, group in _blocks(batch.column(0), *numbers.value, rows):
                    g, o = model.gradients(feats, group)
                    grad += g
                    outer += o
            flat = np.concatenate([grad.ravel(), outer.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "v"])

        sums = np.zeros(2 * width + 2 * width * width)
        for row in texts.filter(F.col("_step") == step).select("_codes").mapInArrow(climb, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[row["k"]] = row["v"]
        grad, outer = sums[: 2 * width].reshape(2, width), sums[2 * width :].reshape(2, width, width)
        for k in range(2):
            pull = RIDGE * (factors[k].ravel() - 1.0 / FEATURES)
            move = np.linalg.solve(outer[k] + RIDGE * np.eye(width), grad[k] - pull)
            # Rounded, so that the order in which tasks' sums are added leaves no trace.
            factors[k] = np.round(factors[k] + np.clip(move, -0.5, 0.5).reshape(FEATURES, SIZES), 6)
        factors = factors.copy()
    shared.unpersist()
    return Model(state, factors)


def head_of(counts: DataFrame, limit: int = HEAD, limit_bytes: int = HEAD_BYTES) -> tuple[list[tuple[str, int]], int]:
    """The tokens of at most LONGEST bytes with a count of at least a threshold, and that threshold: the smallest step of
    counts at which no more than ``limit`` tokens and ``limit_bytes`` remain."""
    short = counts.filter(F.octet_length("token") <= LONGEST)
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.octet_length("token")).alias("bytes"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
    total, size, least = 0, 0, None
    for s in steps:
        total += s["tokens"]
        size += s["bytes"]
        if total > limit or size > limit_bytes:
            break
        least = s["least"]
    if least is None:
        return [], 1 << 62
    head = [(r["token"], r["n"]) for r in short.filter(F.col("n") >= least).collect()]
    return sorted(head, key=lambda x: (-x[1], x[0])), least


def group_mass(counts: DataFrame, head: list[tuple[str, int]]) -> np.ndarray:
    """Smoothed counts of all tokens of each group."""
    half = CLASSES // 2
    code = lambda n: F.crc32(F.right(F.col("token"), F.lit(n)).cast("binary"))
    group = (half + code(1) % half) * GROUPS + code(2) % GROUPS
    mass = np.full(CLASSES * GROUPS, ALPHA)
    for row in counts.groupBy(group.cast("int").alias("g")).agg(F.sum(F.col("n") + ALPHA).alias("m")).collect():
        mass[row["g"]] += row["m"]
    ends = EndGroups()
    for k, (token, n) in enumerate(head[:OWN_GROUP]):
        mass[_tail_group(token.encode("utf-8", "surrogatepass"), ends)] -= n + ALPHA
        mass[k] += n
    return np.maximum(np.round(mass, 6), ALPHA)


def score_texts(docs: DataFrame, train_rows: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from ``train_rows`` and score every row of ``docs``.  ``train_rows``: a table, or a condition that picks rows of
    ``docs``, whose tokens are then read once for both.

    Returns the columns of ``docs`` but the text, and ``n_tokens``, ``n_known``, ``train_tokens`` (long), ``base_score``
    (log10 probability under smoothed unigram counts) and ``score`` (under the model).

    A null text counts as empty: one end token.  A token that training lacks has the share of one unseen token of its
    group.  With no training rows all scores are those of the smoothing alone.  Rows that repeat an id are scored each
    for itself; rows without an id take part in the first step.  Input columns with the names of the new ones are
    replaced; names that begin with an underscore and are used here (``_row``, ``_step``, ``_text``, ``_codes``, ``_names``,
    ``_times``, ``_n_head``, ``_lex``, ``_inner``) are left out.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _score_texts(docs, train_rows, id_col, text_col)


def _score_texts(docs: DataFrame, train_rows: DataFrame | Column, id_col: str, text_col: str) -> DataFrame:
    """Everything that runs in Python ends in a stored table here, so it runs with the batches of ``score_texts``."""
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "_row", "_step", "_text", "_codes", "_names", "_times", "_n_head", "_lex", "_inner")
    kept = [c for c in docs.columns if c.lower() not in made and c != text_col]
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    step = F.coalesce(F.floor(F.crc32(F.col(id_col).cast("string").cast("binary")) / 10) % STEPS, F.lit(0)).cast("int")
    one = isinstance(train_rows, Column)
    counts = stored(token_counts((docs.filter(train_rows) if one else train_rows).select(text.alias("text"))))
    n_train, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head, least = head_of(counts)
    mass = group_mass(counts, head)
    log_mass = np.log10(mass)
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (max(1, n_train) // TOKENS_A_ROW).bit_length()))
    # Plain lists and arrays: executors need no class of this package to read them.
    vocab = Vocabulary([t for t, _ in head], np.array([n for _, n in head], dtype=np.int64))
    words, numbers = spark.sparkContext.broadcast(vocab.head), spark.sparkContext.broadcast((vocab.groups, vocab.hashes))
    trains = F.when(train_rows, step) if one else F.lit(None).cast("int")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text.alias("_text"), trains.alias("_step"), F.monotonically_increasing_id().alias("_row"))
    # Stored, so that row numbers stay as they are.
    encoded = encode(source, words, [*kept, "_row", "_step"])
    training = encoded if one else encode(train_rows.select(text.alias("_text"), step.alias("_step")), words, ["_step"])
    model = train(training.filter("_step is not null").select("_codes", "_step"), numbers, mass / mass.sum(), rows)
    shared, logs_known = spark.sparkContext.broadcast(({**model.state, "seen": None}, model.factors)), np.log10(vocab.counts + ALPHA)

    def make():
        m = Model(*shared.value)

        def run(column):
            n_head, lexical, inner = [], [], []
            for codes, g, feats, begins in _stretches(column, *numbers.value, m.rows):
                logs = np.empty(len(g))
                for lo in range(0, len(g), BLOCK_TOKENS):
                    part = slice(lo, lo + BLOCK_TOKENS)
                    logs[part] = m.log_probs(feats[part], g[part])
                # A group of one token has no share to multiply.
                inner.append(np.add.reduceat(logs / math.log(10) - log_mass[g], begins))
                there = codes >= 0
                lexical.append(np.add.reduceat(np.where(there, logs_known[np.where(there, codes, 0)] if len(logs_known) else 0.0, 0.0), begins))
                n_head.append(np.add.reduceat(there.astype(np.int64), begins))
            n = column.value_lengths().cast(pa.int64())
            return n, *[pa.array(np.concatenate(x)) for x in (n_head, lexical, inner)]

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("_n_head", T.LongType()), T.StructField("_lex", T.DoubleType()), T.StructField("_inner", T.DoubleType())]
    scored = stored(annotate(encoded, ["_codes"], make, fields, keep=[*kept, "_row"]))
    rare = encoded.select("_row", F.explode(F.arrays_zip("_names", "_times")).alias("x")).select("_row", F.col("x._names").alias("token"), F.col("x._times").alias("tf"))
    known = rare.join(counts.filter((F.col("n") < least) | (F.octet_length("token") > LONGEST)), "token", "left")
    sums = known.groupBy("_row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("_rare_lex"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("_rare_known"))
    out = scored.join(sums, "_row", "left")
    lex = F.col("_lex") + F.coalesce("_rare_lex", F.lit(0.0))
    norm = math.log10(n_train + ALPHA * (n_types + 1))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_tokens",
        (F.col("_n_head") + F.coalesce("_rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (lex - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (lex + F.col("_inner")).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; documents of fold 0 of 10 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fold("doc_id", 10) != 0)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


ORACLE: dict[str, str] = {}
