"""Mixing, sharding and the pipeline against plain Python versions; each opN query's columns and folds."""

import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, language_id, mixing, queries, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def corpus(seed=11, n=90):
    """Two languages, sources of very unlike sizes, planted copies, benchmark passages, very short and empty texts."""
    rng = random.Random(seed)
    lexicon = {"en": "the and that with this from which would there about people".split(), "fr": "les des une dans pour avec être où très même déjà eaux".split()}
    passage = " ".join(f"bench{k}" for k in range(20))
    rows = []
    for k in range(n):
        lang = "en" if k % 2 else "fr"
        text = "\n".join(" ".join(rng.choice(lexicon[lang]) + rng.choice(["", "", "a", "es"]) for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 9)))
        rows.append([k, text, lang, [None, "a", "b", "c", "d"][min(4, int(rng.expovariate(0.6)))], len(text)])
    for k in (7, 8, 9):
        rows[k][1] = rows[3][1]
    for k in (20, 21):
        rows[k][1] = rows[k][1][:40] + " " + passage
    rows += [[n, None, None, "a", 0], [n + 1, "", "en", "a", 0], [n + 2, "12 34", "en", "b", 0], [n + 3, "The", "en", "b", 3], [n + 4, "word " * 3000, "en", "d", 15000], [n + 5, "A.", "fr", None, 2]]
    return [tuple(r) for r in rows], [(1, passage), (2, "of")]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return want | share, weight
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            free.discard(s)
    return want, weight


def brute_mix(rows):
    """(id, copy, words, position) of every reading, from the definition."""
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    targets, weight = brute_targets(sizes)
    lines = {w: (start, end) for w, (start, end) in zip((1, 2, 3), mixing.SCHEDULES)}

    def demand(t):
        return sum(targets[s] * (2 * lines[weight[s]][0] * t + (lines[weight[s]][1] - lines[weight[s]][0]) * t * t) / sum(lines[weight[s]]) for s in targets) / sum(targets.values())

    def when(s, share):
        low, high = 0.0, 1.0
        start, end = lines[weight[s]]
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (2 * start * mid + (end - start) * mid * mid) / (start + end) < share else (low, mid)
        return low

    out = []
    for s in sizes:
        at, goal = 0, int(math.floor(targets[s] + 0.5))
        mine = sorted((i for i in source if source[i] == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        for copy in range(3):
            for i in mine:
                words = max(0, min(size[i], goal - at))
                if words:
                    out.append((i, copy, words, demand(when(s, at / targets[s]))))
                at += size[i]
    return out, size, sizes, targets


def test_mix_emits_what_it_plans(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want, size, sizes, targets = brute_mix(rows)
    text = {r[0]: r[1] for r in rows}
    mixed = mixing.mix_sources(df).collect()
    assert sorted((r.doc_id, r.copy, r.words) for r in mixed) == sorted(x[:3] for x in want)
    place = {x[:2]: x[3] for x in want}
    assert all(r.position == pytest.approx(place[r.doc_id, r.copy], abs=1e-9) for r in mixed)
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    for r in mixed:
        assert len(r.text.split()) == r.words and (r.text == text[r.doc_id] if r.words == size[r.doc_id] else text[r.doc_id].startswith(r.text))
    taken = {r.doc_id: r.taken for r in mixing.plan_mix(df).collect()}
    assert sum(r.words for r in mixed) == sum(taken.values())
    for s in sizes:
        assert abs(sum(r.words for r in mixed if r.source == s) - targets[s]) <= 1
    # A position is the share of the mix's words that stand before it, as near as whole documents allow.
    before = 0
    for r in mixed:
        assert abs(before / sum(taken.values()) - r.position) < 0.25
        before += r.words


def test_first_words(spark):
    cases = [(" a  b\tc ", 2, " a  b"), ("a", 1, "a"), ("é ß x", 2, "é ß"), ("w " * 5000, 4999, ("w " * 4999).rstrip())]
    df = spark.createDataFrame(cases, "t string, n long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", mixing.first_words(F.col("t"), F.col("n"))).collect())


def brute_shards(rows, leaves, cats):
    """The k-d tree from the definition, one node at a time."""
    CELLS = sharding.CELLS
    md5 = lambda x: hashlib.md5(("" if x is None else str(x)).encode()).hexdigest()
    dims = ["size", *cats]
    cells = {
        k: ([min(CELLS - 1, int(math.floor(math.log2(len((r["text"] or "").encode()) + 16) * (CELLS / 48))))] + [crc32(("\0" if r[c] is None else str(r[c])).encode()) % CELLS for c in cats], int(md5(r["doc_id"])[:3], 16), len((r["text"] or "").encode()) + 16)
        for k, r in enumerate(rows)
    }
    spread = lambda ks, d: max(cells[k][0][d] for k in ks) - min(cells[k][0][d] for k in ks) if ks else 0
    whole = [spread(list(cells), d) or 1 for d in range(len(dims))]
    shard = {}

    def split(ks, n, first):
        if n == 1:
            shard.update(dict.fromkeys(ks, first))
            return
        d = max(range(len(dims)), key=lambda d: (spread(ks, d) / whole[d], -d)) if ks else 0
        goal = sum(cells[k][2] for k in ks) * (n // 2) / n
        below = lambda v: sum(cells[k][2] for k in ks if cells[k][0][d] < v)
        values = [v for v in sorted({cells[k][0][d] for k in ks}) if below(v) <= goal]
        value = values[-1] if values else 0
        rest = goal - below(value)
        inside = [k for k in ks if cells[k][0][d] == value]
        under = lambda t: sum(cells[k][2] for k in inside if cells[k][1] < t)
        tie = min(({cells[k][1] for k in inside}), key=lambda t: (abs(under(t) - rest), t)) if inside else 0
        left = [k for k in ks if (cells[k][0][d], cells[k][1]) < (value, tie)]
        split(left, n // 2, first)
        split([k for k in ks if k not in set(left)], n - n // 2, first + n // 2)

    split(list(cells), leaves, 0)
    return shard


@pytest.mark.parametrize("leaves", [1, 6, 13])
def test_shards_against_brute_force(spark, leaves):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in corpus()[0]] + [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}] * 3
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = sharding.assign_shards(df.withColumn("k", F.monotonically_increasing_id()), leaves=leaves, categories=["source", "lang"])
    want = brute_shards(rows, leaves, ["source", "lang"])
    by_row = {}
    for k, r in enumerate(rows):
        by_row.setdefault((r["doc_id"], r["text"]), set()).add(want[k])
    assert {(r.doc_id, r.text): {r.shard} for r in got.collect()} == by_row


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole of run(): every row that should be there, with its copies, and nothing else; shards near equal, slots gapless."""
    import corpus_pipeline

    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    prints = {}
    for r in kept:
        prints.setdefault(simhash.fingerprint(r[1]) % 2**64, []).append(r[0])
    root = {f: min(ids) for f, ids in prints.items()}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= 2 and root[a] > root[b]:
                    root[a], changed = root[b], True
    kept = [r for r in kept if r[0] in set(root.values())]
    windows = [w[i : i + 13] for _, t in bench for w in [decontaminate.words(t)] for i in range(max(1, len(w) - 12))]

    def contaminated(text):
        w, hit = decontaminate.words(text), set()
        for win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
        return bool(hit) and 20 * len(hit) >= len(w)

    kept = [r for r in kept if not contaminated(r[1])]
    assert {20, 21} & {r[0] for r in rows} and not {20, 21} & {r[0] for r in kept}
    want, _, _, _ = brute_mix(kept)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = out.collect()
    assert sorted((r.doc_id, len(r.text.split())) for r in got) == sorted((i, n) for i, _, n, _ in want)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    # Slots follow the training order.
    order = {}
    for i, copy, n, at in want:
        order.setdefault((i, n), []).append(at)
    order = {k: sorted(v) for k, v in order.items()}
    # The copies of a document stand in one shard, in the order of their positions.
    for shard in slots:
        placed = [order[r.doc_id, len(r.text.split())].pop(0) for r in sorted((x for x in got if x.shard == shard), key=lambda x: x.slot)]
        assert placed == sorted(placed)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, None)])):
        spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


COLUMNS = {
    "op1_line_dedup": "doc_id n_lines n_removed text",
    "op2_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op6_mixing": "doc_id size source_size target taken position position_2 position_3",
    "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_html_extraction": "page_id url text n_chars",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_simhash_dedup": "doc_id fingerprint component_id",
    "op11_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_each_query(spark, name):
    """One row per document or page of the table, the contract's columns, and folds by crc32 of the id."""
    out = queries.QUERIES[name](spark, SF)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows, key = out.collect(), COLUMNS[name].split()[0]
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet").select(key).collect()]
    assert sorted(r[key] for r in rows) == sorted(ids)
    if "held_out" in out.columns:
        mod, fold = (10, 0) if name.startswith("op4") else (3, 1)
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % mod == fold) for r in rows)


def test_languages_of_the_pipeline_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    import corpus_pipeline

    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).select("doc_id").collect()}
    profiles = language_id.learn_profiles(docs)
    judged = language_id.predict_language(docs, profiles, grams_col="n").collect()
    assert all((r.doc_id in kept) == (r.lang_pred != "und" and (r.score >= language_id.MIN_SCORE or r.n < language_id.MIN_GRAMS)) for r in judged)
