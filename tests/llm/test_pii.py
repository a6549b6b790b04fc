import hashlib
import re

import pytest

from scenaria.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(re.sub("[^0-9]", "", x)) <= 19 and luhn(re.sub("[^0-9]", "", x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
}


def brute(text):
    found = []
    for k, (kind, (pattern, ok)) in enumerate(PLAIN.items()):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


TEXTS = [
    None,
    "",
    "write to a.b@c.d or x_y@z.co_w@e.f, a@b@c.de ..@a.b 1@2.3.4.5",
    "ip 999.1.2.3.4 and 1.2.3.4.5.6.7.8 and 010.0.0.0000255 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500 0000 0000 0004 12 345 6 7 4111111111111111 4111 1111 1111 11115",
    "0" * 12 + "  " + "0" * 19 + "- " + "0" * 20 + " 0-0 0-0 0-0 0-0 0-0 0-0",
    "call +1 (415) 555-0100. +12+3 456 789 012 34 5 or +49.30.1234567-",
    "é€𝄞 a@b.cd 𝄞 +33 1 23 45 67 89 et 192.168.0.1",
    "7 " * 40 + "+" * 5 + "1" * 400,
    "iban DE89 3704 0044 0532 0130 00 IS, GB82WEST12345698765432 my ssn 123-45-6789, 123-45-6789",
    "1" * 3_000 + "@" + "a." * 20_000 + " " + "1.2.3.4 " * 300,
]


def test_base_spans_equal_plain_patterns(docs_of):
    df = pii.find_pii(docs_of(*enumerate(TEXTS)))
    for row in df.collect():
        got = [(x.kind, x.s, x.e) for x in row.pii if x.kind in PLAIN]
        text = TEXTS[row.doc_id]
        assert got == brute(text), text and text[:80]
        assert all(x.text == text[x.s : x.e] and 0 <= x.score <= 1 for x in row.pii)


def test_whole_table_equals_plain_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = pii.op2_pii(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_checksums_and_context(docs_of):
    df = pii.find_pii(docs_of((1, TEXTS[9]), (2, "no 123-45-6789 here"), (3, "DE88 3704 0044 0532 0130 00")))
    got = {r.doc_id: [(x.kind, x.text) for x in r.pii if x.kind in pii.ADDED] for r in df.collect()}
    assert ("iban", "GB82WEST12345698765432") in got[1] and ("ssn", "123-45-6789") in got[1]
    assert got[2] == [] and got[3] == []


def test_redact_and_extra_columns(spark):
    df = spark.createDataFrame(
        [(1, "to a@b.cd at 1.2.3.4!", "x", 5), (2, None, "y", 6), (3, "", "z", 7)], "doc_id int, text string, pii string, m_email int"
    )
    got = {r.doc_id: tuple(r) for r in pii.redact(df).collect()}
    assert got == {1: (1, "to [EMAIL] at [IP]!", "x", 5), 2: (2, None, "y", 6), 3: (3, "", "z", 7)}
    assert pii.redact(df.limit(0)).columns == df.columns


def test_native_plan_without_shuffle(spark, sf_dir):
    plan = pii.op2_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "Exchange") if x in plan]


@pytest.mark.parametrize("number,ok", [("4111111111111111", True), ("4111111111111112", False), ("0000-0000 0000", True)])
def test_luhn(spark, number, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(number))).first()[0] is ok
