"""The tag-path ratios decide: pages that no list can read, ablations, brute-force scores, and hostile pages."""

import math
import random
import re
import time

import pytest

from gradeloom.llm import html_text


def sentence(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", "", ","]) for _ in range(n)).strip(",").capitalize() + "."


def unnamed_page(seed):
    """A page of plain div boxes: links, a teaser and a legal line around the text; no element or name says what is what."""
    rng = random.Random(seed)
    head, parts = sentence(rng, 6), [" ".join(sentence(rng, rng.randint(6, 20)) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(4, 12))]
    links = "".join(f'<div class="x1"><a href="/{k}">{sentence(rng, 2)}</a></div>' for k in range(rng.randint(3, 9)))
    body = f"<h2>{head}</h2>" + "".join(f"<p>{p}</p>" for p in parts)
    page = f'<html><body><div class="x0">{links}</div><div class="x2">{sentence(rng, 7)}</div><div class="x3">{body}</div><div class="x4"><div>{sentence(rng, 5)}</div></div></body></html>'
    return page, "\n".join([head, *parts])


def test_ratios_alone_find_the_text():
    """Of 60 pages without names, the ratios read all; without the ratios, the lists alone change every one of them."""
    for seed in range(60):
        page, want = unnamed_page(seed)
        assert html_text.extract(page) == want
        assert html_text.extract(page, lists=False) == want
        assert html_text.extract(page, ratios=False) != want


def test_lists_alone_keep_a_named_article():
    """A name on a small box weighs; where the ratios of all are alike, the weight decides."""
    page = '<div class="x"><p>One text, here.</p></div><div class="sidebar"><p>Two text, here.</p></div>'
    assert html_text.extract(page) == "One text, here."
    assert html_text.extract(page, lists=False) == "One text, here.\nTwo text, here."


def test_scores_against_brute_force():
    """Each leaf's score from the definition: ratios per path, smoothed by likeness, fused, weighed."""
    for seed in range(20):
        rng = random.Random(seed)
        page = unnamed_page(seed)[0].replace("</body>", f"<nav><p>{sentence(rng, 3)}</p></nav></body>")
        leaves = [x for x in html_text.leaves_of(page)]
        for x in leaves:
            x.text = " ".join("".join(x.pieces).split())
        leaves = [x for x in leaves if x.text]

        def names(p):
            out = []
            while p.parent is not None:
                out.append(p)
                p = p.parent
            return out[::-1]

        paths = [names(x.path) for x in leaves]
        keys = [tuple(map(id, p)) for p in paths]
        weight = [html_text.WEIGHT if any(q.tag == "nav" for q in p) else 1.0 for p in paths]
        total = {k: sum(len(x.text) for x, y in zip(leaves, keys) if y == k) for k in keys}
        most = max(total[k] * w for k, w in zip(keys, weight))
        ratio = {}
        for k in keys:
            mine = [x.text for x, y in zip(leaves, keys) if y == k]
            root = math.sqrt(min(1.0, total[k] / most))
            ratio[k] = (root * total[k] / len(mine), root * sum(len(re.findall(r"[.,;:!?]", t)) + 1 for t in mine) / len(mine))

        def alike(a, b):
            if a == b:
                return 1.0
            same = next((i for i, (p, q) in enumerate(zip(a, b)) if p is not q), min(len(a), len(b)))
            half = 0.5 if len(a) == len(b) == same + 1 and a[-1].tag in html_text.TEXT_BLOCKS and b[-1].tag in html_text.TEXT_BLOCKS else 0.0
            return max(half, same / max(len(a), len(b)))

        want = []
        for i in range(len(leaves)):
            near = [(j, alike(paths[i], paths[j]) / (abs(i - j) + 1) if i != j else 1.0) for j in range(max(0, i - 2), min(len(leaves), i + 3))]
            mean = [sum(ratio[keys[j]][r] * a for j, a in near) / sum(a for _, a in near) for r in (0, 1)]
            want.append(math.sqrt(max(mean[0], ratio[keys[i]][0]) * max(mean[1], ratio[keys[i]][1])) * weight[i])
        got, _ = html_text.path_scores(leaves)
        assert got.tolist() == pytest.approx(want)


@pytest.mark.parametrize("piece", ["<script", '<p class="', "<div>a", "<a '", "<b>", "<li><b>", "</b><div>", "<a '>' ", '<div class="x"><p>a. b', "<p>a</p>", "<!-", "</script"])
@pytest.mark.parametrize("end", ["", '"', "<"])
def test_hostile_pages_take_linear_time(piece, end):
    """Twice the page takes about twice the time, also where quotes, tags and elements never close."""
    times = []
    for size in (1 << 17, 1 << 18):
        began = time.process_time()
        html_text.extract(piece * (size // len(piece)) + end)
        times.append(time.process_time() - began)
    assert times[1] < 3 * times[0] + 0.2 and times[1] < 5


def test_deep_and_unclosed_pages():
    deep = "<div>" * 5000 + "deep, text. " * 20 + "</div>" * 5000 + "<p>after, that. More.</p>"
    assert html_text.extract(deep).startswith("deep, text.")
    assert html_text.extract('<p>first, text.</p><p title="never closed>second, text.</p><p>third, text.</p>') == "first, text.\nsecond, text.\nthird, text."
    assert html_text.extract("a <b") == "a <b"
    assert html_text.extract("x<script>var a = '<p>';</script >y, z") == "xy, z"
    assert html_text.extract("<p>one<!-- <p>two --><p>three &amp four") == "one\nthree & four"


ARTICLE = "<p>The article text, which is long enough to be read. It goes on, and on.</p>"
SAID = "The article text, which is long enough to be read. It goes on, and on."
READER = "<p>First comment here, I like it. Really, well.</p><p>Second one, no.</p>"


@pytest.mark.parametrize("depth", [50, 120, 125, 126, 127, 128, 130, 300, 5000])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_boxes_end_where_they_end_at_any_depth(depth, tag):
    """Elements beyond DEPTH have ends of their own, which don't close boxes outside them."""
    nested = lambda x: f"<{tag}>" * depth + x + f"</{tag}>" * depth
    page = f"<{tag}>{nested(ARTICLE * 3)}<{tag} class='comments'>{nested(READER)}</{tag}></{tag}><footer><p>Imprint.</p></footer>"
    assert html_text.extract(page) == "\n".join([SAID] * 3)


def test_items_and_paragraphs_end_beyond_the_depth():
    deep = "<div>" * 200
    page = f"{deep}<ul><li>One, item of text. Long.<li>Two, item of text. Long.</ul><p>Three, text. More.<p>Four, text. More.<div>Five, text. More.</div>" + "</div>" * 200
    assert html_text.extract(page).split("\n") == ["One, item of text. Long.", "Two, item of text. Long.", "Three, text. More.", "Four, text. More.", "Five, text. More."]


@pytest.mark.parametrize("name", ["commentary", "reply-quote", "respond-to-critics", "commented", "uncommented", "replying"])
def test_names_like_those_of_comments_stay(name):
    page = f"<article>{ARTICLE}<div class='{name}'><p>A paragraph, which stays.</p></div>{ARTICLE}</article>"
    assert html_text.extract(page) == f"{SAID}\nA paragraph, which stays.\n{SAID}"


@pytest.mark.parametrize("name", ["comments", "comment", "comment-list", "post-comments", "user_comment", "disqus_thread", "replies", "reply", "respond", "reply-list"])
def test_reader_comments_go(name):
    page = f"<article>{ARTICLE * 2}</article><div class='{name}'>{READER * 5}</div>"
    assert html_text.extract(page) == f"{SAID}\n{SAID}"
    assert html_text.extract(f"<div class='post'>{ARTICLE * 2}<div id='{name}'>{READER}</div></div>") == f"{SAID}\n{SAID}"


@pytest.mark.parametrize("times", [1, 4, 40])
def test_a_notice_of_any_length_goes(times):
    notice = "".join(f"<p>We use cookies, and more of them, on every page you see. Number {k}.</p>" for k in range(times))
    page = f"<div class='notice'>{notice}</div><div class='text'><h1>Title</h1>{ARTICLE * 3}</div><div class='footer'>Imprint, x.</div>"
    assert html_text.extract(page) == "\n".join(["Title", *[SAID] * 3])


@pytest.mark.parametrize("name", ["sidebar-right", "layout sidebar", "has-ads", "promo-page"])
def test_a_named_wrapper_of_all_keeps_its_text(name):
    page = f"<div class='{name}'><h1>Title</h1>{ARTICLE * 3}</div><div class='footer'>Imprint, x.</div><a href='#'>Skip</a>"
    assert html_text.extract(page).split("\n")[:4] == ["Title", *[SAID] * 3]
    page = f"<div class='{name}'><main><h1>Title</h1>{ARTICLE * 3}</main></div><div class='sidebar'><p>Other, text.</p></div>"
    assert html_text.extract(page).split("\n") == ["Title", *[SAID] * 3]


def test_clashing_names_and_odd_rows(spark):
    rows = [(1, "u", "<p>a, b.</p>", "old"), (None, None, None, None), (2, "u", "", "x"), (1, "u", "<p>a, b.</p>", "old")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string"))
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted(map(str, out.select("page_id", "text", "n_chars").collect())) == sorted(map(str, out.sparkSession.createDataFrame([(1, "a, b.", 5), (None, "", 0), (2, "", 0), (1, "a, b.", 5)], "page_id long, text string, n_chars long").collect()))
    assert html_text.extract_text(out.limit(0).select("page_id", "html")).count() == 0
