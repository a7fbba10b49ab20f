"""Personal data: regular expressions propose spans, validators confirm them, and words nearby adjust the score.

Native expressions over each row's text, without a shuffle.  A pattern's matches and the pieces of text between them give
all positions as running sums, and each match its surroundings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Kind:
    """A kind of span.  ``pattern`` proposes in linear time: possessive where a greedy one would recurse or back off, and
    tried only where a match can begin.  ``plain`` is the same pattern as a contract states it, ``needs`` a character that
    every match has, ``valid`` a SQL condition on the match ``s.m``, ``clear`` one on the characters before (``s.l``) and after
    (``s.r``) it; both must hold.  ``score`` is the score of a confirmed match, ``near`` adds to it if one of the words
    ``words`` stands nearby, and ``against`` takes away if one of ``others`` does.
    """

    name: str
    pattern: str
    plain: str
    needs: str = ""
    valid: str = "true"
    clear: str = "true"
    base: bool = False
    score: float = 0.6
    near: float = 0.3
    words: str = "$^"
    against: float = 0.3
    others: str = "$^"


DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
#: Sum of all digits, every second from the right doubled, nines cast out.
LUHN = f"aggregate(transform(split(reverse({DIGITS}), ''), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = 0 THEN int(c) WHEN c > '4' THEN 2 * int(c) - 9 ELSE 2 * int(c) END), 0, (a, x) -> a + x) % 10 = 0"
COMPACT = "replace(s.m, ' ', '')"
#: The country and check digits go last, letters count as 10 to 35; the number is read digit by digit, modulo 97.
MOD97 = f"aggregate(split(concat(substring({COMPACT}, 5), left({COMPACT}, 4)), ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c <= '9' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
PARTS = "forall(split(s.m, '[.]'), x -> regexp_replace(x, '^0+', '') rlike '^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')"

#: Characters of the text on each side of a match in which words count.
BEFORE, AFTER = 48, 24
#: Confirmed proposals are kept from this score on; those of the base kinds always.
THRESHOLD = 0.5
#: Entries whose running sums are taken in one go.
BLOCK = 1024

_PHONE_WORDS = "phone|tel|call|mobile|cell|fax|contact|anruf|appel|portable|llam|m.vil"
#: In the order in which spans that start together are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", base=True, score=0.8, near=0.2, words="mail|contact|write|schreib|kontakt|courriel|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ".", PARTS, base=True, words=r"\bip\b|address|host|server|adresse|direcci|serv", others="version|release|section|kapitel|chapter"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9]([\x20-]?[0-9])+", "", f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}", base=True, score=0.7, words="card|visa|master|amex|credit|debit|karte|carte|tarjeta", others="order|invoice|serial|tracking|isbn|token"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", f"length({DIGITS}) BETWEEN 9 AND 15", base=True, score=0.7, words=_PHONE_WORDS),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", r"[A-Z]{2}[0-9]{2}((\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", "", f"length({COMPACT}) BETWEEN 15 AND 34 AND {MOD97}", "NOT (s.l rlike '[A-Za-z0-9]$' OR s.r rlike '^[A-Za-z0-9]')", words="iban|account|konto|compte|cuenta|bank", against=0.0),
    Kind("national_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "", "true", r"NOT (s.l rlike '[A-Za-z0-9+.-]$|[+][0-9]{1,3}[ .(-]{0,2}$' OR s.r rlike '^[.-]?[A-Za-z0-9]')", score=0.3, words=_PHONE_WORDS, others="order|invoice|serial|tracking|isbn|token"),
    Kind("social_security", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", "NOT (s.m rlike '^(000|666|9)|-00-|-0000$')", "NOT (s.l rlike '[A-Za-z0-9.-]$' OR s.r rlike '^[.-]?[A-Za-z0-9]')", score=0.3, words=r"\bssn\b|social|security"),
    Kind("birth_date", r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", "", "s.m rlike '^([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})$'", "NOT (s.l rlike '[A-Za-z0-9./-]$' OR s.r rlike '^[./-]?[A-Za-z0-9]')", score=0.2, words=r"born|birth|\bdob\b|gebor|geburt|n.e? le|naissance|nacid|nacim"),
)


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``pii``: the personal data of each text, an array of (start, kind_no, end, kind, text, score, base), in that order.

    Each kind's pattern proposes its leftmost matches that don't overlap; its validator (Luhn, mod-97, ranges of numbers)
    confirms or drops a match, without trying a shorter one.  A confirmed match has its kind's score, more if a word of
    the kind stands in the BEFORE characters before it or the AFTER ones behind it (not beyond a neighbouring match of the
    kind), less if a word that speaks against it does.  Matches of a base kind stay whatever their score; others stay
    from ``threshold`` on.  Positions count code points from 0, ``end`` is exclusive.  Spans of different kinds may overlap.

    A null or empty text has an empty array.  Rows are judged one by one, so repeated rows and null ids are like any
    other.  An input column named ``pii`` is replaced; names beginning with ``_pii_`` are taken.
    """
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    text = f"coalesce(`{text_col}`, '')"
    per_kind = lambda make: "array(" + ", ".join(make(k, kind) for k, kind in enumerate(kinds)) + ")"
    case = lambda field: "CASE s.kind_no " + " ".join(f"WHEN {k} THEN {getattr(kind, field)}" for k, kind in enumerate(kinds)) + " END"

    def said(field: str) -> str:
        words = " ".join(f"WHEN {k} THEN around rlike {quoted(getattr(kind, field))}" for k, kind in enumerate(kinds))
        return f"(CASE s.kind_no {words} END)"

    nothing = "cast(array() AS array<string>)"
    out = docs.drop(*[c for c in docs.columns if c.lower() == "pii"])
    found = per_kind(lambda k, kind: f"CASE WHEN instr({text}, '{kind.needs}') > 0 THEN regexp_extract_all({text}, {quoted(kind.pattern)}, 0) ELSE {nothing} END" if kind.needs else f"regexp_extract_all({text}, {quoted(kind.pattern)}, 0)")
    steps = [
        ("_pii_found", found),
        ("_pii_pieces", per_kind(lambda k, kind: f"CASE WHEN size(_pii_found[{k}]) > 0 THEN split({text}, {quoted(kind.pattern)}, -1) ELSE {nothing} END")),
        # How far each match begins behind the start of the one before it.
        ("_pii_steps", "transform(_pii_found, (f, k) -> transform(f, (m, i) -> char_length(_pii_pieces[k][i]) + CASE WHEN i = 0 THEN 0 ELSE char_length(f[i - 1]) END))"),
        # Running sums in blocks, since an array that grows is copied each time.
        ("_pii_sums", f"transform(_pii_steps, s -> CASE WHEN size(s) = 0 THEN cast(array() AS array<array<int>>) ELSE transform(sequence(0, (size(s) - 1) div {BLOCK}), b -> aggregate(slice(s, b * {BLOCK} + 1, {BLOCK}), cast(array() AS array<int>), (acc, x) -> array_append(acc, x + coalesce(try_element_at(acc, -1), 0)))) END)"),
        ("_pii_before", "transform(_pii_sums, b -> aggregate(b, array(0), (acc, x) -> array_append(acc, element_at(acc, -1) + element_at(x, -1))))"),
        (
            "_pii_all",
            f"flatten(transform(_pii_found, (f, k) -> transform(f, (m, i) -> named_struct('start', _pii_sums[k][i div {BLOCK}][i % {BLOCK}] + _pii_before[k][i div {BLOCK}],"
            f" 'end', _pii_sums[k][i div {BLOCK}][i % {BLOCK}] + _pii_before[k][i div {BLOCK}] + char_length(m), 'kind_no', k, 'm', m, 'l', right(_pii_pieces[k][i], {BEFORE}), 'r', left(_pii_pieces[k][i + 1], {AFTER}), 'joined', i > 0 AND _pii_pieces[k][i] = '' OR _pii_pieces[k][i + 1] = '' AND i + 1 < size(f)))))",
        ),
    ]
    for name, made in steps:
        out = out.withColumn(name, F.expr(made))
    checks = " ".join(f"WHEN {k} THEN ({kind.valid}) AND ({kind.clear})" + (" AND NOT s.joined" if kind.clear != "true" else "") for k, kind in enumerate(kinds))
    out = out.withColumn("_pii_valid", F.expr(f"filter(_pii_all, s -> CASE s.kind_no {checks} END)"))
    # Words are sought on each side by itself.
    both = "lower(concat(s.l, '\\n', s.r))"
    near, other = said("words").replace("around", both), said("others").replace("around", both)
    score = f"round(least(1D, greatest(0D, ({case('score')}) + CASE WHEN {near} THEN {case('near')} ELSE 0 END - CASE WHEN {other} THEN {case('against')} ELSE 0 END)), 3)"
    names = "CASE s.kind_no " + " ".join(f"WHEN {k} THEN '{kind.name}'" for k, kind in enumerate(kinds)) + " END"
    out = out.withColumn("_pii_scored", F.expr(f"transform(_pii_valid, s -> named_struct('start', s.start, 'kind_no', s.kind_no, 'end', s.end, 'kind', {names}, 'text', s.m, 'score', cast({score} AS double), 'base', {case('base')}))"))
    kept = f"filter(_pii_scored, s -> s.base OR s.score >= {threshold})"
    return out.select(*[c for c in docs.columns if c.lower() != "pii"], F.expr(f"array_sort({kept})").alias("pii"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and a digest of the contract's base spans, and the list of all spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    named = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(pii, s -> s.kind = '{kind.name}')) AS bigint)").alias(f"n_{kind.name}") for kind in KINDS if kind.base]
    return found.select("doc_id", *counts, F.expr(f"sha2(cast({named('filter(pii, s -> s.base)')} AS binary), 256)").alias("base_sha256"), F.expr(named("pii")).alias("spans"))


def _oracle() -> str:
    """The same rows in DuckDB, from the plain patterns."""
    proposals, checks, scores = [], [], []
    text = lambda s: "'" + s.replace("'", "''") + "'"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(generate_series(1, length({digits})), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INT) ELSE CAST(substr(reverse({digits}), i, 1) AS INT) * 2 - CASE WHEN substr(reverse({digits}), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
    compact = "replace(m, ' ', '')"
    turned = f"(substr({compact}, 5) || left({compact}, 4))"
    number = f"array_to_string(list_transform(generate_series(1, length({compact})), lambda i: CASE WHEN substr({turned}, i, 1) <= '9' THEN substr({turned}, i, 1) ELSE CAST(ascii(substr({turned}, i, 1)) - 55 AS VARCHAR) END), '')"
    mod97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(generate_series(1, length({number})), lambda i: CAST(substr({number}, i, 1) AS BIGINT))), lambda a, c: (a * 10 + c) % 97) = 1"
    valid = {
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({compact}) BETWEEN 15 AND 34 AND {mod97}",
    }
    def sql(condition: str) -> str:
        return re.sub(r"s\.([mlr]) rlike ('(?:[^'])*')", r"regexp_matches(\1, \2)", condition)

    for k, kind in enumerate(KINDS):
        proposals.append(f"SELECT doc_id, {k} AS kind_no, regexp_extract_all(t, {text(kind.plain)}) AS f, regexp_split_to_array(t, {text(kind.plain)}) AS p FROM docs")
        check = " AND ".join(f"({c})" for c in [valid.get(kind.name, sql(kind.valid)), sql(kind.clear)])
        checks.append(f"WHEN {k} THEN {check}" + (" AND NOT joined" if kind.clear != "true" else ""))
        around = "lower(l || chr(10) || r)"
        scores.append(f"WHEN {k} THEN {kind.score} + CASE WHEN regexp_matches({around}, {text(kind.words)}) THEN {kind.near} ELSE 0 END - CASE WHEN regexp_matches({around}, {text(kind.others)}) THEN {kind.against} ELSE 0 END")
    names = " ".join(f"WHEN {k} THEN '{kind.name}'" for k, kind in enumerate(KINDS))
    base = ", ".join(str(k) for k, kind in enumerate(KINDS) if kind.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind_no = {k}) AS n_{kind.name}" for k, kind in enumerate(KINDS) if kind.base)
    zeros = ", ".join(f"CAST(coalesce(s.n_{kind.name}, 0) AS BIGINT) AS n_{kind.name}" for kind in KINDS if kind.base)
    named = "kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR)"
    order = "ORDER BY start, kind_no, stop"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
proposals AS ({' UNION ALL '.join(proposals)}),
matches AS (SELECT doc_id, kind_no, p, len(f) AS n, unnest(f) AS m, generate_subscripts(f, 1) AS i, f FROM proposals WHERE len(f) > 0),
placed AS (
  SELECT doc_id, kind_no, m, right(p[i], {BEFORE}) AS l, left(p[i + 1], {AFTER}) AS r, (i > 1 AND p[i] = '') OR (i < n AND p[i + 1] = '') AS joined,
         CAST(sum(length(p[i]) + CASE WHEN i > 1 THEN length(f[i - 1]) ELSE 0 END) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS BIGINT) AS start
  FROM matches
), confirmed AS (
  SELECT *, start + length(m) AS stop, CASE kind_no {names} END AS kind, CASE kind_no {' '.join(scores)} END AS score
  FROM placed WHERE CASE kind_no {' '.join(checks)} END
), kept AS (SELECT * FROM confirmed WHERE kind_no IN ({base}) OR round(score, 3) >= {THRESHOLD}),
sums AS (
  SELECT doc_id, {counts}, string_agg(CASE WHEN kind_no IN ({base}) THEN {named} END, ',' {order}) AS base, string_agg({named}, ',' {order}) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, {zeros}, sha256(coalesce(s.base, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM docs d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""


ORACLE = {"op11_pii": _oracle()}
