"""Labels: vocabularies, parsers of free-text answers, and small string functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels of each task in their published order, and the names of their accuracy columns.
LABELS = {
    "nli": ["ENTAILMENT", "NEUTRAL", "CONTRADICTION"],
    "consistency": ["CONSISTENT", "INCONSISTENT"],
    "plausibility": ["PLAUSIBLE", "IMPLAUSIBLE"],
    "commonsense": ["YES", "NO"],
    "restraint": ["SUPPORTED", "UNSUPPORTED"],
    "accent_drift": ["TRUE", "FALSE"],
}
ACCURACY_NAMES = {"ENTAILMENT": "EACC", "NEUTRAL": "NACC", "CONTRADICTION": "CACC"}
DIFFICULTIES = ["easy", "medium", "hard"]
ACCENT_GOLD = {"ACCENT_INVARIANT": "TRUE", "ACCENT_TEST": "FALSE"}
POSITIVE_LABELS = ["TRUE", "CONSISTENT", "PLAUSIBLE", "SUPPORTED", "ENTAILMENT"]
UNPARSEABLE = "UNPARSEABLE"
BLANKS = " \t\n\r\f\x0b"
# The phrases and verbs by which the keyword rules read an answer.
NEUTRAL_PHRASES = [
    "does not contain information that would entail or contradict",
    "does not contain any information that would contradict or entail",
    "neutral and does not seem to be contradicted",
    "does not provide any evidence to support or refute",
    "cannot be determined from the audio",
    "no clear indication",
    "neither supports nor contradicts",
]
ENTAIL_WORDS = ["entail", "support", "confirm", "agree"]
CONTRADICT_WORDS = ["contradict", "refute", "disagree", "oppose"]
NEGATIONS = ["does not", "not", "no", "cannot"]


def strip(c: Column) -> Column:
    """White space of all kinds off both ends (``trim`` takes off blanks only)."""
    return F.btrim(c, F.lit(BLANKS))


def task_family(task: str) -> str:
    return "nli" if task in ("nli", "interview_nli", "nli_caption") else task


def _any(c: Column, words: list[str]) -> Column:
    return F.coalesce(c.rlike("|".join(words)), F.lit(False))


def _cases(pairs: list[tuple[Column, str]], otherwise: Column) -> Column:
    for test, label in reversed(pairs):
        otherwise = F.when(test, F.lit(label)).otherwise(otherwise)
    return otherwise


def parse_label(text: Column, task: str, strategy: str = "boundary", missing: str = UNPARSEABLE) -> Column:
    """The label that a free-text answer gives.

    Strategies (they disagree on purpose; each defines its own published numbers):
    ``boundary``: whole words, longer labels first.  ``ordered``: whole words in the order entailment, contradiction,
    neutral; lower-case result.  ``substring``: parts of words in a fixed order, so that INCONSISTENT reads as CONSISTENT,
    and so on.  ``prefix_fallback``: as ``substring`` on the text without LABEL: and ANSWER:, else its first word of more
    than two letters.  ``keyword_rules``: phrases and negated verbs (NLI).  ``raw``: the stripped, upper-cased text.
    ``missing`` stands for no label, except in ``raw``; null texts have none.
    """
    task = task_family(task)
    text = F.coalesce(text, F.lit(""))
    none = F.lit(missing)
    upper, lower = F.upper(text), F.lower(strip(text))
    if strategy == "raw":
        return strip(upper)
    if task == "intent":
        # An open set: the answer itself is the label; ``boundary`` compares it in upper case.
        said = strip(upper) if strategy == "boundary" else strip(text)
        return F.when(said == "", none).otherwise(said)
    if strategy == "boundary":
        labels = sorted(LABELS[task], key=lambda x: (-len(x), x))
        return _cases([(upper.rlike(rf"\b{x}\b"), x) for x in labels], none)
    if strategy == "ordered":
        order = ["ENTAILMENT", "CONTRADICTION", "NEUTRAL"] if task == "nli" else LABELS[task]
        return _cases([(upper.rlike(rf"\b{x}\b"), x.lower()) for x in order], F.lower(none))
    if strategy == "substring":
        has = lower.contains
        rules = {
            "nli": [(has("entail"), "ENTAILMENT"), (has("contradict"), "CONTRADICTION"), (has("neutral") | has("neither"), "NEUTRAL")],
            "consistency": [(has("consistent"), "CONSISTENT")],
            "plausibility": [(has("plausible"), "PLAUSIBLE")],
            "commonsense": [(lower.startswith("yes") | (lower == "y"), "YES"), (lower.startswith("no") | (lower == "n"), "NO")],
            "restraint": [(has("support") & ~has("not"), "SUPPORTED"), (has("not support") | has("unsupport"), "UNSUPPORTED")],
            "accent_drift": [(lower.startswith("true") | (lower == "t"), "TRUE"), (lower.startswith("false") | (lower == "f"), "FALSE")],
        }
        return _cases(rules[task], none)
    if strategy == "prefix_fallback":
        bare = strip(F.replace(F.replace(strip(upper), F.lit("LABEL:"), F.lit("")), F.lit("ANSWER:"), F.lit("")))
        has = bare.contains
        rules = {
            "nli": [(has("ENTAIL"), "ENTAILMENT"), (has("CONTRADICT"), "CONTRADICTION"), (has("NEUTRAL"), "NEUTRAL")],
            "consistency": [(has("CONSISTENT"), "CONSISTENT")],
            "plausibility": [(has("PLAUSIBLE"), "PLAUSIBLE")],
            "commonsense": [(has("ALIGN"), "ALIGNED")],
            "restraint": [(has("SUPPORTED"), "SUPPORTED")],
            "accent_drift": [(has("TRUE") | has("YES"), "TRUE"), (has("FALSE") | has("NO"), "FALSE")],
        }
        first = F.regexp_extract(bare, r"^(\S+)", 1)
        return _cases([(text == "", missing), *rules[task]], F.when(F.length(first) > 2, first).otherwise(none))
    if strategy == "keyword_rules":
        denied = lambda verb: [f"{n} {verb}" for n in NEGATIONS]
        entails, refutes = _any(lower, ENTAIL_WORDS), _any(lower, CONTRADICT_WORDS)
        return _cases(
            [
                (text == "", missing),
                (_any(lower, NEUTRAL_PHRASES), "NEUTRAL"),
                (entails & _any(lower, denied("entail")), "NEUTRAL"),
                (entails, "ENTAILMENT"),
                (refutes & _any(lower, denied("contradict")), "NEUTRAL"),
                (refutes, "CONTRADICTION"),
                (upper.contains("NEUTRAL"), "NEUTRAL"),
            ],
            none,
        )
    raise ValueError(f"unknown strategy: {strategy}")


def resolve_prediction(raw: Column, pred: Column, task: str) -> Column:
    """The raw answer's label by whole words, else the given prediction, stripped and lower-cased, else ''."""
    return F.coalesce(F.lower(F.nullif(parse_label(raw, task, "boundary", ""), F.lit(""))), F.lower(strip(pred)), F.lit(""))


def strip_icl_prefix(c: Column) -> Column:
    """What stands between the first ``Target Hypothesis:`` and the next line ``Answer:``; the whole text if either is missing; null gives ''."""
    c = F.coalesce(c, F.lit(""))
    mark, end = "Target Hypothesis:", "\nAnswer:"
    # Split once by a literal, which skips through a long prompt; what follows is looked at in one place, so it is made once.
    rest = F.slice(F.split(c, mark, 2), 2, 1)
    found = F.transform(rest, lambda r: F.when(r.contains(end), F.substring_index(r, end, 1)))
    return strip(F.coalesce(F.try_element_at(found, F.lit(1)), c))


def assistant_tail(c: Column) -> Column:
    """Lower-cased text after the last of the first mark found: ``assistant`` and a line end, a colon or a blank."""
    low, out = F.lower(c), F.lower(strip(c))
    for mark in ("assistant ", "assistant:", "assistant\n"):
        out = F.when(low.contains(mark), strip(F.substring_index(low, mark, -1))).otherwise(out)
    return out


def first_json(c: Column) -> Column:
    """The text from the first { to the last } as VARIANT; an empty object where that isn't JSON."""
    return F.coalesce(F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))), F.parse_json(F.lit("{}")))


def clip_text(c: Column, n: int | None) -> Column:
    """At most ``n`` characters, the last an ellipsis if any went; unchanged without a limit."""
    if n is None or n <= 0:
        return c
    s = strip(c)
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - 1)), F.lit("…"))).otherwise(s)


def strip_prefixes(path: Column) -> Column:
    """The path without the folders that data sets put before it, each taken off once, in this order."""
    for prefix in ("data/", "/data/", "Audio/", "/Audio/"):
        path = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    return path


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def dataset_of_path(path: Column) -> Column:
    low = F.lower(path)
    return _cases([(low.contains("general"), "General"), (low.contains("medical"), "Medical"), (low.contains("afrispeech200"), "AfriSpeech200")], F.lit("Unknown"))


def variant_of_path(path: Column) -> Column:
    return _cases([(path.contains(v), v) for v in ("original", "v2_explicit", "v3_simple")], F.lit("default"))


def task_of_key(key: Column) -> Column:
    return _cases([(key.endswith(f"_{t}"), t) for t in ("accent_drift", "nli", "consistency", "plausibility", "restraint")], F.lit("unknown"))


def dataset_of_key(key: Column) -> Column:
    return _cases([(key.startswith(f"{d}_"), d) for d in ("afri200", "medical", "general", "afrinames")], F.lit("unknown"))


def safe_name(label: str, upper: bool = True) -> str:
    name = label.strip().replace(" ", "_")
    return name.upper() if upper else name


def relabel_audit(df: DataFrame, old: str, new: str, keys: list[str] | None = None) -> DataFrame:
    """Per new label: rows, and rows whose label the parser changed."""
    return df.groupBy(*(keys or []), new).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed"))
