"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and value checks confirm them, and
words in the neighbourhood raise the score. Everything is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenaria.llm.common import free_name, table

#: Kinds in their order. The patterns match what their plain forms match (leftmost, greedy, not
#: overlapping), written without backtracking: possessive, and each run tried from its start only.
#: - a card is a whole chain of 12 to 19 digits, so chains of another length are never proposed;
#: - an e-mail's local part may also begin where the match before it ended (\G).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
ADDED = {
    "iban": r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = {**BASE, **ADDED}
#: A character without which a kind can't occur; saves the regular expression for most texts.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|master|amex|credit|debit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
    "ssn": "ssn|social|security|insurance",
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.6, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
#: Bonus of a confirmed checksum, and of a context word within NEAR characters.
CHECKED, IN_CONTEXT, NEAR = 0.3, 0.2, 40
#: An added kind counts from this score on; base kinds always count.
LEAST_SCORE = 0.5

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_LUHN_DOUBLED = "0246813579"


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass Luhn's check."""
    d = F.regexp_replace(x, "[^0-9]", "")

    def digit(i: Column) -> Column:
        return F.substr(d, -i, F.lit(1))

    doubled = lambda i: F.substr(F.lit(_LUHN_DOUBLED), digit(i).cast("int") + 1, F.lit(1))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(doubled(i)).cast("int"),
    )
    return total % 10 == 0


def mod97(x: Column) -> Column:
    """Whether ``x`` (an IBAN, blanks allowed) leaves 1 modulo 97."""
    c = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        ch = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(ch < 58, a * 10 + ch - 48).otherwise(a * 100 + ch - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, x: Column) -> Column:
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.rlike(x, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "card": lambda: luhn(x),
        "phone": lambda: digits.between(9, 15),
        "iban": lambda: mod97(x),
        "ssn": lambda: F.rlike(x, F.lit("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")),
    }[kind]()


_SPAN = "array<struct<s:int,k:int,kind:string,e:int,text:string,score:double>>"


def _located(kind: str) -> Column:
    """Spans from the matches and the pieces of text between them, confirmed and scored."""
    order = list(KINDS).index(kind)
    p, m = F.col(f"__p_{kind}"), F.col(f"__m_{kind}")
    zipped = F.arrays_zip(p, m, F.col(f"__n_{kind}"))

    def step(acc: Column, z: Column) -> Column:
        before, match, after = z[f"__p_{kind}"], z[f"__m_{kind}"], z[f"__n_{kind}"]
        start = acc["at"] + F.length(before)
        near = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))))
        bonus = F.when(F.rlike(near, F.lit(CONTEXT[kind])), IN_CONTEXT).otherwise(0.0)
        base = PRIOR[kind] + (CHECKED if kind in ("card", "iban") else 0.0)
        span = F.struct(
            start.alias("s"),
            F.lit(order).alias("k"),
            F.lit(kind).alias("kind"),
            (start + F.length(match)).alias("e"),
            match.alias("text"),
            F.least(F.lit(1.0), F.lit(base) + bonus).alias("score"),
        )
        keep = match.isNotNull() & _valid(kind, match)
        return F.struct(
            (start + F.coalesce(F.length(match), F.lit(0))).alias("at"),
            F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))
    found = F.aggregate(zipped, zero, step, lambda acc: acc["out"])
    if kind in ADDED:
        found = F.filter(found, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(F.size(m) > 0, found).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out``: the spans of each text, sorted by start and kind.

    A span has s and e (code points, end exclusive), kind, text and score (0 to 1). Base kinds
    (email, ip, card, phone) are always returned when their check holds; iban needs mod 97, ssn
    a context word. A null or empty text has no spans. All rows and all other columns stay as
    they are, whatever their names; only a column named ``out`` is replaced.
    """
    # the user's columns travel under numbers, so that none can clash with the operator's own
    given = [c for c in docs.columns if c.lower() != out.lower()]
    df = docs.select(*[F.col(c).alias(f"__given_{i}") for i, c in enumerate(given)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    matches = {}
    for kind, pattern in KINDS.items():
        found = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
        if kind in NEEDS:
            found = F.when(F.contains("__text", F.lit(NEEDS[kind])), found).otherwise(F.expr("cast(array() as array<string>)"))
        matches[f"__m_{kind}"] = found
    df = df.withColumns(matches)
    df = df.withColumns(
        {f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__text", p, -1)) for k, p in KINDS.items()}
    )
    df = df.withColumns({f"__n_{k}": F.slice(f"__p_{k}", F.lit(2), F.size(f"__p_{k}")) for k in KINDS})
    spans = F.array_sort(F.concat(*[_located(k) for k in KINDS]))
    return df.select(*[F.col(f"__given_{i}").alias(c) for i, c in enumerate(given)], spans.alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; overlapping
    spans become one, named after the first. Null texts stay null; columns of any name stay as they are."""
    spans = free_name(docs, "__pii")
    found = find_pii(docs, text_col, spans)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col(text_col), acc["at"] + 1, x["s"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        more = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(gap, mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), more.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col(text_col), acc["at"] + 1))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(F.col(text_col))
    return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs)
    base = F.filter("pii", lambda x: x["k"] < len(BASE))

    def count(k: int) -> Column:
        return F.size(F.filter("pii", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans")
    )
