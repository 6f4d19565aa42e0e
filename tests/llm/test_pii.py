"""Personal data against Python's re."""

import hashlib
import re
import time

import pytest

from energylake.llm import pii

from .conftest import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else False,
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def plain(text):
    found = {
        k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m[0])]
        for k, p in PATTERNS.items()
    }
    listed = ",".join(f"{k}:{a}:{b}" for k, s in found.items() for a, b in s)
    return (*[len(s) for s in found.values()], hashlib.sha256(listed.encode()).hexdigest()), listed


def reported(df):
    rows = pii.report(pii.find(df)).collect()
    return sorted(
        (str(r.row.doc_id), (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in rows
    )


def test_odd_rows(odd):
    assert reported(odd) == sorted((str(i), plain(t)[0]) for i, t in ODD)


def test_table(documents, texts):
    assert reported(documents) == sorted((str(i), plain(t)[0]) for i, t in texts.items())


TEXTS = [
    "a@b.c", "a@b", "a@b.c.d-e.f@g.h", "x@y.z_w@v.u", "é@b.c ö.x@b.c", "a@b.c@d.e", "%@a.b..c@d.e.", "a@@b.c",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.0255", "1.2.3.256 1.2.3.4", "99999999999999999999.1.1.1",
    "4111111111111111", "4111-1111 1111-1111", "4111 1111  1111 1111", "5411111111111111 1", "0" * 16, "0" * 20,
    "4111111111111111 4111111111111111", "+1 (988) 555-2485", "+12345678", "+1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "++49 30 1234567-", "+1((((((((", "🙂 a@b.c 🙂 10.0.0.1 é +4930123456", "+1 4111 1111 1111 1111", "a" * 300 + "@b.c",
    "", " ", "\n1.1.1.1\n", "1.2.3.4@x.y", "..@x.y", "+1.2.3.4.5.6.7.8",
]


def test_cases(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert reported(df) == sorted((str(i), plain(t)[0]) for i, t in enumerate(TEXTS))
    for r in pii.report(pii.find(df)).collect():
        assert r.spans.startswith(plain(TEXTS[r.row.doc_id])[1])


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("IBAN DE89370400440532013000.", "iban:5:27"),
        ("GB82 WEST 1234 5698 7654 32", "iban:0:27"),
        ("DE89370400440532013001", ""),
        ("my SSN is 123-45-6789", "ssn:10:21"),
        ("part 123-45-6789", ""),
        ("SSN 000-45-6789", ""),
    ],
)
def test_added_kinds(spark, text, spans):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    added = [s for s in pii.report(pii.find(df)).first().spans.split(",") if s.split(":")[0] in ("iban", "ssn")]
    assert ",".join(added) == spans


IBAN, SPACED = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
WORDS = " and so on with many more words between them, "


BEHIND = [
    (f"{SPACED} Bitte", "iban:0:27"),
    (f"{SPACED} AND 12 MORE", "iban:0:27"),
    (f"{SPACED} 5 EUR", "iban:0:27"),
    (f"{IBAN} GB82 WEST 1234 5698 7654 32 NO93 8601 1117 947 X", "iban:0:22,iban:23:50,iban:51:69"),
    (f"AB12 CD34 {SPACED} X", "iban:10:37"),
    (f"{IBAN}x {IBAN}1", ""),
    (f"🙂 {SPACED}, {IBAN}.", "iban:2:29,iban:31:53"),
    ("SSN 123-45-6789, 234-56-7890", "ssn:4:15,ssn:17:28"),
    ("123-45-6789 (SSN)", "ssn:0:11"),
    ("123-45-6789, 234-56-7890: tax id", "ssn:0:11,ssn:13:24"),
    ("SSN" + ", 123-45-6789" * 300, ",".join(f"ssn:{5 + 13 * i}:{16 + 13 * i}" for i in range(300))),
    (f"SSN {WORDS} 123-45-6789 {WORDS} SSN", ""),
]


def test_added_kinds_with_text_behind_and_in_lists(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BEHIND)], "doc_id long, text string")
    for r in pii.report(pii.find(df)).collect():
        added = [s for s in r.spans.split(",") if s.split(":")[0] in ("iban", "ssn")]
        assert ",".join(added) == BEHIND[r.row.doc_id][1]


def test_added_kinds_in_long_runs_take_no_long_time(spark):
    texts = [f"{SPACED} " * 4_000, "AA11 " * 10_000, "A" * 200_000, "SSN " + "123-45-6789 x " * 15_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begun = time.time()
    got = {r.row.doc_id: r.spans.count("iban") for r in pii.report(pii.find(df)).collect()}
    assert got[0] == 4_000
    assert pii.redact(df).filter("doc_id = 0").first().text == "[IBAN] " * 4_000
    assert time.time() - begun < 60


def test_redaction(spark):
    rows = [
        (1, "mail a.b@c.de or 🙂 x@y.zz, from 10.0.0.1"),
        (2, "call +49 30 123456 10.0.0.1 now"),
        (3, "nothing here"),
        (4, None),
        (5, ""),
        (6, "a@b.cc"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'x' AS clean", "1 AS email")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {
        1: "mail [EMAIL] or 🙂 [EMAIL], from [IP]",
        2: "call [PHONE] now",
        3: "nothing here", 4: None, 5: "", 6: "[EMAIL]",
    }


def test_no_rows(empty):
    assert pii.report(pii.find(empty)).collect() == []
    assert pii.redact(empty).collect() == []


def test_long_runs_take_no_long_time(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1." * 100_000, "a.a@" * 50_000, "a@" + "b." * 100_000, "+1" + "(" * 200_000, "1 " * 100_000, "+1" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begun = time.time()
    got = {r.row.doc_id: r for r in pii.report(pii.find(df)).collect()}
    assert got[2].n_ip == 25_000
    assert got[3].n_email == 25_000
    assert pii.redact(df).filter("doc_id = 3").first().text == "[EMAIL]" + "@[EMAIL]" * 24_999 + "@"
    assert time.time() - begun < 60


def test_no_python_in_the_plan(odd):
    for df in (pii.report(pii.find(odd)), pii.redact(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
