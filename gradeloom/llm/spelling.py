"""Spelling variant grouping: a variable-length gram index over words, whose lists are merged within affected-gram bounds.

A word, between marks for its start and end, has one gram at each position: as short as is rare, so the gram of two code
points is lengthened while it is frequent among all words, up to MOST_GRAM.  An edit changes just the grams over the code
point it touches; at most as many as lie over one code point, the word's bound.  Words one edit apart therefore share all
but that many grams, each at the same distance from the start or from the end, so it is enough to merge the lists of each
word's rarest grams, one more than its bound.  Pairs from the lists are verified by edit distance.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Letters as the contract has them.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
LEAST_GRAM, MOST_GRAM = 2, 5
#: Grams that occur more often are lengthened; at least this, and so often that no more than MOST_FREQUENT of one length are.
FREQUENT, MOST_FREQUENT = 64, 1 << 16
#: Words in a list that are compared pair by pair; longer lists go by the words with one code point deleted.
LIST = 128
START, END = "\x02", "\x03"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 0, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): occurrences of each run of letters of at least ``least_letters``, A-Z lower-cased.

    ``noise``: if positive, a run loses one letter where that divides the crc32 of ``<id>:<run>`` (the contract's misspellings;
    a null id is the empty string).
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("_run"))
    # lower() would also change the letters beyond A-Z.
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = F.when(F.octet_length("_run") == F.char_length("_run"), F.lower("_run")).otherwise(F.translate("_run", upper, upper.lower()))
    words = runs.select("_id", word.alias("word"))
    if noise:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        words = words.select("word", h.alias("_h"))
        at = (F.col("_h") % F.char_length("word")).cast("int")
        words = words.select(F.when(F.col("_h") % noise == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(F.col("word")).alias("word"))
    return words.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent_grams(words: DataFrame, word: str = "word") -> tuple[set[str], int]:
    """The grams of LEAST_GRAM to MOST_GRAM - 1 code points that are to be lengthened, and the count they exceed.

    No more than MOST_FREQUENT of each length: the threshold is at least that share of all positions.
    """
    positions = words.agg(F.sum(F.char_length(word).cast("long") + 1).alias("n")).first()["n"] or 0
    least = max(FREQUENT, positions // MOST_FREQUENT)

    def count(batches):
        from collections import Counter

        for batch in batches:
            held: Counter = Counter()
            for w in batch.column(0).to_pylist():
                marked = f"{START}{w}{END}"
                for size in range(LEAST_GRAM, MOST_GRAM):
                    held.update(marked[at : at + size] for at in range(len(marked) - size + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    grams = words.select(F.col(word)).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"] for r in grams.filter(F.col("n") > least).select("gram").collect()}, least


def grams_of(word: str, frequent: set[str]) -> tuple[list[tuple[str, int]], int]:
    """The word's grams with their positions between its marks, and how many of them one edit may change at most."""
    marked = f"{START}{word}{END}"
    grams, over = [], [0] * (len(marked) + 1)
    for at in range(len(marked) - LEAST_GRAM + 1):
        end = at + LEAST_GRAM
        while end - at < MOST_GRAM and end < len(marked) and marked[at:end] in frequent:
            end += 1
        grams.append((marked[at:end], at))
        over[at] += 1
        over[end] -= 1
    bound = here = 0
    for change in over:
        here += change
        bound = max(bound, here)
    return grams, bound


def gram_index(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, size, list): the lists that hold each word, those of its rarest grams, one more than its bound, at their
    distance from the start and from the end."""
    frequent, _ = frequent_grams(words, word)

    def decompose(batches):
        for batch in batches:
            out = [[], [], [], []]
            for w in batch.column(0).to_pylist():
                grams, bound = grams_of(w, frequent)
                for gram, at in grams:
                    for column, x in zip(out, (w, gram, at, bound), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["word", "gram", "at", "bound"])

    grams = stored(words.select(F.col(word).alias("word")).mapInArrow(decompose, "word string, gram string, at int, bound int"))
    # Stored, so that Spark can split a frequent gram's rows in the join.
    counts = stored(grams.groupBy(F.col("gram").alias("_g")).agg(F.count(F.lit(1)).alias("_n")))
    # rank() keeps all of equally rare grams together, so the same ones lead in every word.
    rank = F.rank().over(Window.partitionBy("word").orderBy("_n", "gram"))
    rarest = grams.join(counts, F.col("gram") == F.col("_g")).withColumn("_rank", rank).filter(F.col("_rank") <= F.col("bound") + 1)
    size = F.char_length("word")
    lists = F.array(F.concat(F.lit("<"), F.col("at"), F.lit(":"), "gram"), F.concat(F.lit(">"), size - F.col("at"), F.lit(":"), "gram"))
    index = stored(rarest.select("word", size.alias("size"), F.explode(lists).alias("list")))
    discard(grams, counts)
    return index


def near_pairs(index: DataFrame) -> DataFrame:
    """(a, b), once each: the words that one inserted, deleted or replaced code point tells apart, from lists of ``gram_index``.

    A list is merged with itself and with that of the words one longer.  Lists of over LIST words are not compared pair by
    pair: their words are joined by what is left when one code point is deleted, which words one edit apart share.
    """
    sizes = stored(index.groupBy(F.col("list").alias("_list"), F.col("size").alias("_size")).agg(F.count(F.lit(1)).alias("_n")))
    # A list counts as long if it, or the one of the next size, is.
    both = sizes.union(sizes.select("_list", F.col("_size") - 1, "_n")).groupBy("_list", "_size").agg(F.max("_n").alias("_n"))
    both = stored(both)
    rows = index.join(both, (F.col("list") == F.col("_list")) & (F.col("size") == F.col("_size"))).select("word", "size", "list", (F.col("_n") > LIST).alias("long"))
    # The same lists as the longer side: a word is met by those of its own size, and by those one shorter.
    met = index.select(F.col("word").alias("other"), F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("size"), "list", F.col("size").alias("other_size"))
    met = met.join(both, (F.col("list") == F.col("_list")) & (met["size"] == F.col("_size"))).select("other", met["size"], "list", "other_size", (F.col("_n") > LIST).alias("long"))
    once = (F.col("other_size") > F.col("size")) | (F.col("word") < F.col("other"))
    near = F.levenshtein("word", "other", 1) == 1
    short = rows.filter(~F.col("long")).join(met.filter(~F.col("long")), ["list", "size"]).filter(once & near).select("word", "other")
    long = rows.filter("long").select("word").distinct()
    other = met.filter("long").select("other").distinct()
    left, right = stored(deletions(long, "word")), stored(deletions(other, "other"))
    rest = left.join(right, "key").filter((F.col("word") != F.col("other")) & near).select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other"))
    pairs = short.select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other")).union(rest)
    return pairs.distinct().select(F.col("word").alias("a"), F.col("other").alias("b"))


def deletions(words: DataFrame, word: str) -> DataFrame:
    """(word, key): the word itself, and with each of its code points deleted."""
    w = F.col(word)
    cut = F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.char_length(w))))
    return words.select(w, F.explode(F.array_distinct(F.concat(F.array(w), cut))).alias("key"))


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """For each row of (word, n), distinct words of two letters or more: its near words, the form it is a variant of, and the root.

    A word's near words are one inserted, deleted or replaced code point away.  The form is the most frequent of them
    (of equally frequent ones the first by code points), if it is at least ``ratio`` times as frequent as the word; the
    root is reached by following forms.

    Returns word, form, root, n, n_near, form_n; form and form_n are null, and the root is the word itself, where there is
    no form.  An empty table gives an empty one.
    """
    words = stored(words.select("word", "n"))
    index = gram_index(words)
    pairs = stored(near_pairs(index))
    discard(index)
    links = pairs.select(F.col("a").alias("_w"), F.col("b").alias("_o")).union(pairs.select("b", "a"))
    counted = links.join(words.select(F.col("word").alias("_o2"), F.col("n").alias("_on")), F.col("_o") == F.col("_o2"))
    # min of (-n, word) is the most frequent, then the first by code points: UTF-8 bytes sort as code points do.
    best = counted.groupBy("_w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_on")).alias("m"), F.col("_o").alias("o"))).alias("_best"))
    joined = words.join(best, F.col("word") == F.col("_w"), "left").withColumn("_ok", -F.col("_best.m") >= ratio * F.col("n"))
    formed = stored(joined.select("word", F.when(F.col("_ok"), F.col("_best.o")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_ok"), -F.col("_best.m")).alias("form_n")))
    roots = follow(formed.filter("form is not null").select("word", "form"))
    out = formed.join(roots, formed["word"] == roots["_word"], "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def follow(forms: DataFrame) -> DataFrame:
    """(_word, _root) of (word, form): forms are followed by doubling until none leads on; each is rarer than the next, so they end."""
    roots = stored(forms.select(F.col("word").alias("_word"), F.col("form").alias("_root")))
    while True:
        ahead = roots.select(F.col("_word").alias("_at"), F.col("_root").alias("_next"))
        stepped = stored(roots.join(ahead, F.col("_root") == F.col("_at"), "left").select("_word", F.coalesce("_next", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved")))
        discard(roots)
        roots = stepped.select("_word", "_root")
        if not stepped.filter("_moved").head(1):
            return roots
        roots._stored_at = stepped._stored_at


def spelling_words(docs: DataFrame, noise: int = 199) -> DataFrame:
    return count_words(docs, noise=noise).filter(F.col("n") >= LEAST_COUNT)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with the form it is a variant of: word, form, root, n, n_near, form_n."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_variants(spelling_words(docs))
