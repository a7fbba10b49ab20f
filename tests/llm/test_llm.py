"""Operators of the llm subpackage against brute force, and on nulls, empty and long texts, repeats and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, html_text, language_id, line_dedup, lm_scoring, media, mixing, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=60):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), vocab)}" for _ in range(n))


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = "\n".join(words(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 8)))
        rows.append((k, text, "en" if k % 2 else "fr", None if k % 11 == 0 else f"s{k % 4}", len(text)))
    rows[7] = (7, rows[3][1], "en", "s1", 0)
    rows[8] = (8, rows[3][1] + " tail", "en", "s1", 0)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \n\t ", None, "s0", 0), (n + 3, words(rng, 20000), "fr", "s2", 0)]
    rows += [rows[5], rows[5], (None, "a row without an id", "en", "s0", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BENCH = [(1, "w1 w2 w3"), (2, ""), (3, None), (None, "w5 w1"), (10, "w0 w1 w0 w2 w1 w3 w0 w4 w1 w0 w2 w0 w1 w1 w9"), (2, "W7, w3!")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def test_line_dedup(docs, empty, spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "b\nc\nd\nb\nc\nd"), (4, None), (5, ""), (6, "a\nb"), (None, "q\nq\nq\nq")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(rows.withColumn("n_lines", F.lit("clash"))).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("x", 4, 3), 3: ("", 6, 6), 4: (None, 0, 0), 5: ("", 1, 0), 6: ("a\nb", 2, 0), None: ("q", 4, 3)}
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_brute(docs):
    seen, want = set(), {}
    rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}, key=lambda r: r[0])
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        want[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs.filter("doc_id is not null")).collect()} == want


def test_media(docs, empty):
    out = media.media_digest(docs.withColumn("feature", F.lit(1))).collect()
    assert len(out) == docs.count()
    for r in out:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert media.media_digest(empty).count() == 0


def test_media_sniffs_and_carves(spark):
    payload = bytes(range(256)) * 9
    for kind in media.STORED_AS:
        b = media.encode(payload, kind)
        assert media.VALIDATORS[kind](b, 0) == len(b)
        assert media.decode(b, kind) == payload
        assert media.VALIDATORS[kind](b[:-30], 0) == 0
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    png = media.encode(b"\x01" * 576, "image/png")
    blob = b"junk BM RIFF" + png + b"more" + gif + b"GIF89a"
    df = spark.createDataFrame([(1, bytearray(blob), "image/png"), (2, bytearray(gif), "image/png"), (3, None, None), (4, bytearray(b""), "audio/wav")], "id long, data binary, declared string")
    got = {r.id: r for r in media.sniff_column(df, "data", "declared").collect()}
    assert [(e.type, e.offset) for e in got[1].embedded] == [("image/png", 12), ("image/gif", 16 + len(png))]
    assert got[2].media_type == "image/gif" and got[2].corrected
    assert got[3].media_type is None and not got[3].embedded
    assert got[4].media_type == "audio/wav" and not got[4].corrected
    carved = {r.type: bytes(r.carved) for r in media.carve(media.sniff_column(df, "data", "declared"), "data").collect()}
    assert carved == {"image/png": png, "image/gif": gif}


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("block", [None, 1])
def test_decontamination(docs, empty, spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    got = decontaminate.find_contamination(docs.withColumn("n_hit", F.lit("clash")), bench(spark)).collect()
    windows = set()
    for item, text in BENCH:
        w = cut(text)
        windows |= {(item, tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12) if w else 0)}
    for r in got:
        w, hit, items = cut(r.text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    items |= {str(item)} if item is not None else set()
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(items))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.find_contamination(empty, bench(spark)).count() == 0
    assert {r.n_hit for r in decontaminate.find_contamination(docs, bench(spark).limit(0)).collect()} == {0}


def test_proximity(docs, spark):
    for r in decontaminate.find_near(docs.filter("length(text) < 2000"), bench(spark), slack=2).collect():
        w, places, items = cut(r.text), set(), set()
        for item, text in BENCH:
            win = cut(text)[:13]
            for win in [cut(text)[i : i + 13] for i in range(max(1, len(cut(text)) - 12) if cut(text) else 0)]:
                for s in range(-2, len(w) + 3):
                    if all(any(0 <= s + k + d < len(w) and w[s + k + d] == x for d in range(-2, 3)) for k, x in enumerate(win)):
                        places.add(s)
                        items |= {str(item)} if item is not None else set()
        assert r.near_items == sorted(items)
        assert (r.n_places > 0) == bool(places)


def test_lm_scores(docs, empty):
    train = docs.filter("doc_id % 10 <> 0")
    got = lm_scoring.score_texts(docs, train).collect()
    assert len(got) == docs.count()
    counts = {}
    for r in train.collect():
        for t in [*(r.text or "").lower().split(), ""]:
            counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        toks = [*(by_id[r.doc_id] or "").lower().split(), ""]
        assert r.n_tokens == len(toks) and r.train_tokens == n
        assert r.n_known == sum(t in counts for t in toks)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in toks))
        assert r.score < 0
    assert lm_scoring.score_texts(empty, empty).count() == 0
    assert {r.n_known for r in lm_scoring.score_texts(docs.limit(3), empty).collect()} == {0}


def test_lm_learns_order(spark):
    """Two vocabularies that don't mix, each in a fixed cycle: held-out texts become far likelier than word by word."""
    rows = [(k, " ".join(f"{'ab'[k % 2]}{(k + i) % 12}" for i in range(80)), None, None, 0) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lm_scoring.score_texts(df.filter("doc_id >= 300"), df.filter("doc_id < 300")).collect()
    assert sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_lm_rare_tokens_are_joined(docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in lm_scoring.score_texts(docs, docs).collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 20)
    few = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in lm_scoring.score_texts(docs, docs).collect()}
    assert whole == few


def test_language(docs, empty, spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the and thing", "with that this"] if k % 2 else ["les des eaux", "pour été où"]) for _ in range(30)), "en" if k % 2 else "fr", "s", 0) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    profiles = language_id.learn_profiles(df.filter("doc_id < 40"))
    got = language_id.predict_language(df.withColumn("score", F.lit("x")), profiles).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    odd = language_id.predict_language(docs, profiles).collect()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in odd)
    assert language_id.learn_profiles(empty) == {}
    assert {r.lang_pred for r in language_id.predict_language(docs, {}).collect()} == {"und"}


def test_mixing(docs, empty):
    plan = mixing.plan_mix(docs.withColumn("size", F.lit("x"))).collect()
    assert len(plan) == docs.count()
    sizes, taken, targets = {}, {}, {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            free.discard(s)
    assert targets == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    mixed = mixing.mix_sources(docs).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in plan if r.taken}
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_sharding(docs, empty, spark):
    rows = spark.createDataFrame([(k, "x" * (k * 37 % 91), None if k % 5 else "en", f"s{k % 3}", 0) for k in range(3000)], SCHEMA)
    out = sharding.with_slots(sharding.assign_shards(rows.withColumn("shard", F.lit("x")), leaves=7, categories=["source", "lang"])).collect()
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.text) + 16
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) < 1.03 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = sharding.with_slots(sharding.assign_shards(docs, target_bytes=2000, categories=["source"]))
    assert odd.count() == docs.count() and odd.filter("shard is null or slot is null").count() == 0
    assert sharding.with_slots(sharding.assign_shards(empty, leaves=4)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy this. Now, please, today.</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First   part,<br>with a
break.<p>Second &eacute;t&#233;, longer text. With, some; marks.</p><ul><li>One</li><li>Two</li></ul>
<div class="comments"><p>A reader says much, very much, indeed. Really.</p></div><form><p>Sign up</p></form></article>
<aside>Side words, many, many.</aside><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    assert html_text.extract(PAGE) == "Head & line\nFirst part, with a break.\nSecond été, longer text. With, some; marks.\nOne\nTwo"
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain words"), (5, "<p>a<p>b"), (6, "<script>x"), (7, "<div><p>" + "long text. " * 5000 + "<p>end"), (8, "a < b & c")], "page_id long, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r.text for r in html_text.extract_text(rows).collect()}
    assert (got[2], got[3], got[4], got[5], got[6], got[8]) == ("", "", "plain words", "a\nb", "", "a < b & c")
    assert got[7] == ("long text. " * 5000).strip() + "\nend"
    assert html_text.extract_text(rows.limit(0)).count() == 0


def blocks(kind, size):
    """Three texts of about ``size`` characters in all, and their markup."""
    texts = [f"{kind} {k}, " + "some words, more. " * (size // 54) + "end." for k in range(3)]
    one = {"section": "<p>{}</p>", "div": "<p>{}</p>", "blockquote": "<p>{}</p>", "ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}[kind]
    return texts, f"<{kind}>" + "".join(one.format(t) for t in texts) + f"</{kind}>"


@pytest.mark.parametrize("large", ["section", "div", "blockquote", "ul", "table"])
@pytest.mark.parametrize("small", ["section", "div", "blockquote", "ul", "table"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div><div>{}</div></div>", "{}"])
def test_html_keeps_all_parts(wrap, small, large):
    """An article in two parts, of which one holds over half of the text, with a heading above."""
    (a, big), (b, little) = blocks(large, 600), blocks(small, 300)
    for parts, texts in ((big + little, a + b), (little + big, b + a)):
        page = "<html><body><nav><a>Home</a></nav>" + wrap.format("<h1>The head</h1>" + parts) + "<footer>foot</footer></body></html>"
        assert html_text.extract(page).split("\n") == ["The head", *texts]


def test_html_keeps_all_articles():
    page = "<body><h1>Head</h1><div>Buy this, now, please.</div><article><p>" + "Long, text. " * 60 + "</p></article><article><p>Short, too.</p></article></body>"
    assert html_text.extract(page).split("\n") == ["Head", ("Long, text. " * 60).strip(), "Short, too."]


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "has-ads", "main no-comments", "widget-text", "promo"])
def test_html_names_of_wrappers(name):
    """A name doesn't empty a page whose text it wraps, or whose parts all have it."""
    parts = [f"<section{{}}><p>Part {k}, with words, and more words. Really.</p></section>" for k in range(3)]
    want = [f"Part {k}, with words, and more words. Really." for k in range(3)]
    for body in (f'<div class="{name}">' + "".join(parts).format("", "", "") + "</div>", "".join(parts).format(*[f' class="{name}"'] * 3)):
        got = html_text.extract(f'<body><nav>Home</nav><h1>Head</h1>{body}<div class="sidebar"><p>Side words, many.</p></div></body>')
        assert got.split("\n") == ["Head", *want]


@pytest.mark.parametrize("name", ["article-header", "entry-header", "post_header", "header"])
def test_html_names_of_heads(name):
    page = f'<body><div class="site-header"><p>The site</p></div><article><div class="{name}"><h1>Head</h1><p>By one.</p></div><p>First, words. More.</p><div class="comments"><p>{"A reader, says. " * 20}</p></div></article></body>'
    assert html_text.extract(page).split("\n")[:3] == ["Head", "By one.", "First, words. More."]
    page = f'<body><article><h1>Head</h1><p>First, words. More.</p></article><div class="comments"><p>{"A reader, says. " * 20}</p></div></body>'
    assert html_text.extract(page) == "Head\nFirst, words. More."
    assert html_text.extract('<body><div class="entry-header"><h1>Head</h1></div><div><p>First, words. More.</p></div></body>') == "Head\nFirst, words. More."


def brute_components(rows):
    prints = {}
    for i, text in rows:
        prints.setdefault(simhash.fingerprint(text), set()).add(i)
    nodes = {fp: min(x for x in ids if x is not None) for fp, ids in prints.items() if any(x is not None for x in ids)}
    root = {v: v for v in nodes.values()}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, x), (b, y) in itertools.combinations(nodes.items(), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            p, q = sorted((top(x), top(y)))
            root[q] = p
    return {fp: top(v) for fp, v in nodes.items()}


def test_fingerprint_bits():
    import xxhash

    text = "The cat  sat\non THE mat the cat sat on"
    w = "the cat sat on the mat the cat sat on".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) % 2**64 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("one two") % 2**64 == xxhash.xxh64_intdigest(b"one two", 42)


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        fp = int(r.fingerprint, 16)
        assert r.component_id == want.get(fp - 2**64 if fp >> 63 else fp)
    kept = simhash.keep_representatives(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert sum(r.doc_id is None for r in kept) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_representatives(empty).count() == 0


@pytest.mark.parametrize("limit", [2, 512])
def test_links_of_clusters(spark, monkeypatch, limit):
    """Chains and balls of fingerprints, also where every shard is over its limit and is split."""
    monkeypatch.setattr(simhash, "TREE_LIMIT", limit)
    rng = random.Random(9)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            values.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    values = sorted(values)
    rows = [(k, v - 2**64 if v >> 63 else v) for k, v in enumerate(values)]
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(spark.createDataFrame(rows, "node long, fp long"))).collect()}
    root = list(range(len(values)))
    for a, b in itertools.combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= 2:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    assert [roots.get(k, k) for k in range(len(values))] == root


def test_pipeline(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = corpus_pipeline.identify_language(spark, docs, sf)
    step = corpus_pipeline.drop_near_duplicates(spark, step, sf)
    texts = [(r.doc_id, r.text) for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")]
    assert {r.doc_id for r in step.collect()} == set(brute_components(texts).values())
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"]
    clean = {r.doc_id for r in decontaminate.find_contamination(step, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("not contaminated").collect()}
    assert {r.doc_id for r in out.collect()} <= clean


def test_pipeline_keeps_short_documents(spark):
    """Each word of the corpus alone, and in pairs; only the texts without letters and a long one of strange letters go."""
    import corpus_pipeline

    rng = random.Random(4)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(40)] + [w.capitalize() + "." for w in vocab] + [f"{a} {b}" for a, b in itertools.pairwise(vocab)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    strange = "".join(rng.choice("bcdfgjkmpqvwxyz") for _ in range(2000))
    df = spark.createDataFrame([*rows, (-1, "12 ... 34", None, "s", 0), (-2, strange, None, "s", 0), (-3, None, "en", "s", 0)], SCHEMA)
    kept = corpus_pipeline.identify_language(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows]
