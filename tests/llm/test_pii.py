"""op11 against plain Python, and the edge cases of its docstring."""

import hashlib
import re
import time

import pytest

from gradeloom.llm import pii

# The contract's base patterns, as it states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[str]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TEXTS = [
    None,
    "",
    "no data here",
    "a@b.c_d@e.f, x@y, a@b..c, é@b.co.uk. ü.z%+-1@-.-.x@q.r",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 0001.002.255.0 999999999999999999999.1.1.1 1.2.3",
    "4111 1111-1111 1111 and 4111111111111112; 4111  1111 1111 1111; 0000000000000 00000000000000000000 4111111111111111 5",
    "+1 (830) 555-5433 ext; +49-170.1234567.. +1 23 +123456789012345678 +1+1 555 555 5555 +12(34)56-78 9 (",
    "𝄞𝄞 né le 😀 a@b.de 😀 10.0.0.1",
    "10.0.0.1\n4111111111111111\na@b.de\n+1 830 555 5433",
    "call (830) 555-5433 or 830-555-5433; id 830-555-5433x",
]


def test_base_spans_equal_plain_python(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["base"]] == base_spans(r["text"])
        for s in r["pii"]:
            assert r["text"][s["start"] : s["end"]] == s["text"] and 0 <= s["score"] <= 1


def found(spark, text, **kw):
    return [(s["kind"], s["text"]) for s in pii.find_pii(spark.createDataFrame([(text,)], "text string"), **kw).first()["pii"]]


def test_validators_and_context(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    assert found(spark, f"Konto: {iban}.") == [("iban", iban)]
    assert found(spark, "IBAN DE89370400440532013000") == [("iban", "DE89370400440532013000")]
    assert found(spark, f"Konto: {iban.replace('89', '88', 1)}.") == []
    assert found(spark, "xDE89370400440532013000") == []
    assert found(spark, "please call 830-555-5433 now") == [("national_phone", "830-555-5433")]
    assert found(spark, "the value 830-555-5433 now") == []
    assert found(spark, "call invoice 830-555-5433 now") == []
    assert found(spark, "tel. +1 (830) 555-5433") == [("phone", "+1 (830) 555-5433")]
    assert found(spark, "SSN: 123-45-6789") == [("social_security", "123-45-6789")]
    assert found(spark, "SSN: 000-45-6789") == [] and found(spark, "part 123-45-6789") == []
    assert found(spark, "born on 12.03.1980, paid on 1.2.2020 for it; much later, much later, much later") == [("birth_date", "12.03.1980")]
    assert found(spark, "the value 830-555-5433 now", threshold=0.2) == [("national_phone", "830-555-5433")]
    scores = {t: pii.find_pii(spark.createDataFrame([(t,)], "text string")).first()["pii"][0]["score"] for t in ("host 10.0.0.1", "see 10.0.0.1", "release 10.0.0.1")}
    assert scores["host 10.0.0.1"] > scores["see 10.0.0.1"] > scores["release 10.0.0.1"]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a.", "a@", "+1 ", "a@b.c ", "10.0.0.1 ", "A1", "AB12", "1-", "(", "a@b."])
def test_long_texts_in_linear_time(spark, unit):
    text = unit * (60_000 // len(unit))
    began = time.time()
    got = pii.find_pii(spark.createDataFrame([(text,)], "text string")).first()["pii"]
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got if s["base"]] == base_spans(text)
    assert time.time() - began < 60


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a@b.de", "x")], "doc_id long, text string, PII string")
    out = pii.find_pii(df)
    assert out.columns == ["doc_id", "text", "pii"] and out.first()["pii"][0]["kind"] == "email"
    assert pii.find_pii(df.limit(0)).collect() == []


def test_query_digests(spark):
    rows = {r["doc_id"]: r for r in pii.op11_pii(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(rows)
    for doc_id, text in docs:
        spans = base_spans(text)
        assert rows[doc_id]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(rows[doc_id]["spans"].split(",")) | {""}
        assert [rows[doc_id][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
