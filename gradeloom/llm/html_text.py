"""HTML extraction by tag-path ratios."""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, table

# Fixed values from the HTML standard: elements without content, whose content isn't markup, and that end an open <p>.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that stand within an article, and are never the whole of one.
TEXT_BLOCKS = HEADINGS | frozenset("address blockquote caption dd details dl dt figcaption figure hgroup legend li ol p pre summary ul".split())
#: Elements whose text is never shown as running text.
UNSEEN = frozenset("head button select option object canvas".split())
#: Elements that surround an article: they weigh on a path's score, and don't decide by themselves.
AROUND = frozenset("nav footer aside form menu dialog label fieldset".split())
#: Words of class, id and role that name what surrounds an article, with the same weight.
AROUND_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|footer\w*|header|masthead|sidebar\w*|side|widget\w*|notice\w*|cookie\w*|consent|gdpr|alert|popup|modal|overlay|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search|pager|pagination|toolbar|complementary|contentinfo|navigation)(?:$|[^a-z])"
)
#: Names of reader comments, of which each is a whole one: commentary, or a reply that an article quotes, is its own.  Comments
#: are prose with the ratios of an article, so they weigh far less.
READERS = re.compile(r"(?:^|[-_])comments?(?:$|[-_])|^disqus\w*$|^(?:reply|replies|respond)$|^repl(?:y|ies)[-_](?:list|form|box|area|section)$")
#: Names that only say what a wrapper holds or lacks, and those of an article's own head.
WRAPPER_NAMES = re.compile(r"(?:^|[-_])(?:with|without|no|not|has|have|hide|show|is)[-_]|(?:^|[-_])(?:article|entry|post|story|section|content)[-_]*header$")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
NAMES = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
CLOSE = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I) for name in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: A block ends an open paragraph; items and cells end their like.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
STOPS = frozenset("ul ol table dl article section div main body".split())
#: Elements deeper than this have no path of their own; where they begin and end is kept track of all the same.
DEPTH = 128
#: Half width of the smoothing over leaves in page order.
SMOOTH = 2
#: A path is content from this part of the page's mean score on; what surrounds an article by its name weighs less than that.
STRICT, WEIGHT, READERS_WEIGHT = 0.4, 0.05, 0.05**3
#: Short blocks go with the container in which this share of the text is content.
SHARE = 0.6


class Path:
    """A root-to-leaf tag path below <body>: its names, and the sums over the leaves that have it."""

    __slots__ = ("parent", "tag", "depth", "called", "around", "unseen", "main", "wraps", "n", "length", "marks")

    def __init__(self, parent: Path | None, tag: str, called: str, around: bool, unseen: bool):
        self.parent, self.tag, self.called, self.around, self.unseen = parent, tag, called, around, unseen
        self.depth = parent.depth + 1 if parent else 0
        self.main = tag in ("article", "main") or (parent is not None and parent.main)
        #: Whether an article or main stands within it.
        self.wraps = False
        if self.main and not (parent is not None and parent.main):
            while parent is not None:
                parent.wraps, parent = True, parent.parent
        self.n = self.length = self.marks = 0


class Leaf:
    """A run of text of one block, its path and its pieces."""

    __slots__ = ("path", "pieces", "text")

    def __init__(self, path: Path):
        self.path, self.pieces, self.text = path, [], ""


def around_name(named: str, inside: bool) -> str:
    """Those of an element's names that speak of what surrounds an article; ``inside`` an article or main, a header is its own."""
    names = [x for x in named.split() if (AROUND_NAMES.search(x) or READERS.search(x)) and not WRAPPER_NAMES.search(x)]
    return " ".join(x for x in names if not (inside and (m := AROUND_NAMES.search(x)) and m[0].strip("-_") == "header"))


def tags_of(page: str):
    """(text, tag match) pieces in page order, in one pass forward: each is one or the other.

    A quote that never closes makes all later quotes plain characters, and a tag that never ends is text.
    """
    at, end, tag = 0, len(page), TAG
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            yield page[at : lt if lt >= 0 else end], None
            if lt < 0:
                return
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = close + 1 if close >= 0 else end
            continue
        following = page[lt + 1 : lt + 3].lstrip("/")[:1]
        if not (following.isascii() and following.isalpha()):
            yield "<", None
            at = lt + 1
            continue
        m = tag.match(page, lt)
        if m is None and tag is TAG:
            tag = BARE_TAG
            m = tag.match(page, lt)
        if m is None:
            yield page[lt:], None
            return
        at = m.end()
        name = m[2].lower()
        if name in RAW and not m[1]:
            close = CLOSE[name].search(page, at)
            close = page.find(">", close.end()) if close else -1
            at = close + 1 if close >= 0 else end
            continue
        yield None, m


def leaves_of(page: str) -> list[Leaf]:
    """Blocks of text in page order.  Inline elements join; the start or end of a block, or of a named element, parts them."""
    root = Path(None, "", "", False, False)
    known: dict[tuple[int, str, str], Path] = {}
    stack: list[tuple[str, Path, Path]] = []  # name, path inside, path outside
    opened: dict[str, int] = {}
    deep: list[str] = []  # the elements beyond DEPTH
    deep_opened: dict[str, int] = {}
    out: list[Leaf] = []
    leaf: Leaf | None = None
    here = root

    def rise(depth: int) -> None:
        """Close the elements beyond DEPTH from ``depth`` on."""
        for name in deep[depth:]:
            deep_opened[name] -= 1
        del deep[depth:]

    def close(depth: int) -> bool:
        """Close the elements from ``depth`` on; true if one of them has a path of its own."""
        nonlocal here
        own = False
        rise(0)
        for name, inner, outer in stack[depth:]:
            opened[name] -= 1
            own |= inner is not outer
        here = stack[depth][2]
        del stack[depth:]
        return own

    for text, m in tags_of(page):
        if m is None:
            if leaf is None:
                leaf = Leaf(here)
                out.append(leaf)
            leaf.pieces.append(text)
            continue
        name = m[2].lower()
        if m[1]:
            if deep_opened.get(name):
                depth = len(deep) - 1
                while deep[depth] != name:
                    depth -= 1
                rise(depth)
                if name in BLOCKS:
                    leaf = None
            elif opened.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                if close(depth) or name in BLOCKS:
                    leaf = None
            continue
        if name in VOID:
            if name == "br" and leaf is not None:
                leaf.pieces.append(" ")
            elif name == "hr":
                leaf = None
            continue
        if name in BLOCKS:
            leaf = None
            ends, met = (*ENDS.get(name, ()), "p"), len(deep) > DEPTH
            for k in range(len(deep) - 1, max(-1, len(deep) - 1 - DEPTH), -1):
                met = met or deep[k] in ends or deep[k] in STOPS
                if met:
                    if deep[k] in ends:
                        rise(k)
                    break
            if not met and any(opened.get(x) for x in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in STOPS:
                        break
        if m[3].endswith("/"):
            continue
        if len(stack) >= DEPTH:
            deep.append(name)
            deep_opened[name] = deep_opened.get(name, 0) + 1
            continue
        names = {k.lower(): (a or b or c).lower() for k, a, b, c in NAMES.findall(m[3])} if "=" in m[3] else {}
        called = around_name(" ".join(names.values()), here.main or name in ("article", "main")) if names and name not in ("html", "body") else ""
        around = name in AROUND or (name == "header" and not here.main)
        outer = here
        if name not in ("html", "body") and (name in BLOCKS or around or called or name in UNSEEN):
            # Containers go by their class too, so that boxes of another kind are another path.
            kind = "" if name in TEXT_BLOCKS else names.get("class", "")
            key = (id(here), name, f"{kind}\n{called}")
            here = known.get(key) or known.setdefault(key, Path(here, name, called, around, here.unseen or name in UNSEEN))
            leaf = None
        stack.append((name, here, outer))
        opened[name] = opened.get(name, 0) + 1
    return out


def likeness(a: Path, b: Path) -> float:
    """Share of two paths that is the same, from the root: 1 for equal ones; text blocks side by side are half alike at least."""
    if a is b:
        return 1.0
    deepest, least = max(a.depth, b.depth), 0.5 if a.parent is b.parent and a.tag in TEXT_BLOCKS and b.tag in TEXT_BLOCKS else 0.0
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    while a is not b:
        a, b = a.parent, b.parent
    return max(least, a.depth / deepest if deepest else 1.0)


def path_scores(leaves: list[Leaf], lists: bool = True, ratios: bool = True) -> tuple[np.ndarray, dict[int, float]]:
    """The score of each leaf's path in the place of the leaf, and the weight of each path (by id).

    A path's two ratios are the length of its text and its punctuation per leaf, both times the root of the path's text
    over that of the page's largest path (by weight).  They are smoothed over the leaves in page order, by the likeness of the paths,
    and fused as their geometric mean.  What surrounds an article by its element or name weighs WEIGHT for each, reader
    comments READERS_WEIGHT.  A name doesn't weigh on a box that an article or main stands in.
    ``lists`` and ``ratios`` switch either part off, for tests.
    """
    weights: dict[int, float] = {}

    def weight(p: Path | None) -> float:
        todo = []
        while p is not None and id(p) not in weights:
            todo.append(p)
            p = p.parent
        w = weights[id(p)] if p is not None else 1.0
        for q in reversed(todo):
            if lists and q.around:
                w *= WEIGHT
            if lists and q.called and not q.wraps:
                w *= READERS_WEIGHT if any(READERS.search(x) for x in q.called.split()) else WEIGHT
            weights[id(q)] = w
        return w

    for leaf in leaves:
        p = leaf.path
        p.n, p.length, p.marks = p.n + 1, p.length + len(leaf.text), p.marks + len(PUNCTUATION.findall(leaf.text)) + 1
    n = len(leaves)
    weighed = np.array([weight(x.path) for x in leaves])
    if not ratios:
        return weighed, weights
    most = max(x.path.length * weights[id(x.path)] for x in leaves)
    own = np.array([(x.path.length / x.path.n, x.path.marks / x.path.n) for x in leaves]) * np.sqrt([[min(1.0, x.path.length / most)] for x in leaves])
    total, mass = own.copy(), np.ones(n)
    for k in range(1, SMOOTH + 1):
        alike = np.array([likeness(leaves[i].path, leaves[i + k].path) for i in range(n - k)]) / (k + 1)
        if n > k:
            total[:-k] += own[k:] * alike[:, None]
            total[k:] += own[:-k] * alike[:, None]
            mass[:-k] += alike
            mass[k:] += alike
    smooth = np.maximum(own, total / mass[:, None])
    return np.sqrt(smooth[:, 0] * smooth[:, 1]) * weighed, weights


def extract(page: str | None, lists: bool = True, ratios: bool = True) -> str:
    """The main text of a page.

    A leaf is content if the score of its path reaches STRICT of the page's mean score, weighed by text length over the
    leaves outside all that surrounds an article.  Headings take the best score of the three leaves after them.  A leaf
    below that stays if SHARE of the text of a container around it, within the same surroundings, is content.
    """
    leaves = []
    for leaf in leaves_of(page or ""):
        leaf.text = " ".join(html.unescape("".join(leaf.pieces)).split())
        if leaf.text and not leaf.path.unseen:
            leaves.append(leaf)
    if not leaves:
        return ""
    scores, weights = path_scores(leaves, lists, ratios)
    sizes = np.array([len(x.text) for x in leaves], dtype=float)
    plain = np.array([weights[id(x.path)] == 1 for x in leaves])
    judged = plain if plain.any() else np.ones(len(leaves), dtype=bool)
    least = STRICT * float((scores * sizes)[judged].sum() / sizes[judged].sum())
    for i in range(len(leaves) - 1, -1, -1):
        if leaves[i].path.tag in HEADINGS and i + 1 < len(leaves):
            after = max(scores[j] / weights[id(leaves[j].path)] * min(1.0, weights[id(leaves[j].path)] / weights[id(leaves[i].path)]) for j in range(i + 1, min(i + 4, len(leaves))))
            scores[i] = max(scores[i], after * weights[id(leaves[i].path)])
    content = scores >= least
    if not content.any():
        content = scores >= scores.max()
    # Text of each path and of those below it in the same surroundings, and what of it is content.
    sums: dict[int, list[float]] = {}
    order: dict[int, Path] = {}
    for leaf, size, good in zip(leaves, sizes, content, strict=True):
        p = leaf.path
        while p is not None and id(p) not in order:
            order[id(p)] = p
            p = p.parent
        s = sums.setdefault(id(leaf.path), [0.0, 0.0])
        s[0] += size
        s[1] += size * good
    for p in sorted(order.values(), key=lambda p: -p.depth):
        s = sums.setdefault(id(p), [0.0, 0.0])
        if p.parent is not None and weights[id(p)] == weights[id(p.parent)]:
            above = sums.setdefault(id(p.parent), [0.0, 0.0])
            above[0] += s[0]
            above[1] += s[1]
    inside: dict[int, bool] = {}
    for p in sorted(order.values(), key=lambda p: p.depth):
        s = sums[id(p)]
        same = p.parent is not None and weights[id(p)] == weights[id(p.parent)]
        inside[id(p)] = p.parent is not None and (0 < s[0] * SHARE <= s[1] or (same and inside[id(p.parent)]))
    return "\n".join(leaf.text for leaf, good in zip(leaves, content, strict=True) if good or inside[id(leaf.path)])


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the page's main text, and ``n_chars``, its code points.

    Null and empty pages, and pages without text, give an empty text.  Broken markup is read as far as it goes, in time
    linear in the page's length.  Input columns named ``text`` or ``n_chars`` are replaced.
    """

    def make():
        def run(pages):
            texts = [extract(p.as_py()) for p in pages]
            return texts, [len(t) for t in texts]

        return run

    return annotate(pages, [html_col], make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))
    return extract_text(pages, keep=["page_id", "url"])


ORACLE: dict[str, str] = {}
