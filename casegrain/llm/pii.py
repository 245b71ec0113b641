"""Personal data, in DataFrame operations only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges for address
parts and social security numbers, digit counts for phone numbers, mixed characters for secrets), and words nearby move the score. The four base kinds stay whatever their
score; the kinds that the method adds (ADDED_KINDS) need MIN_SCORE.

Places come from splitting a text at the matches and adding up the lengths of pieces and matches. The patterns are
possessive, and begin only where a run of their characters begins, so that each text is read in linear time; they match what
the plain patterns in PLAIN match.

Defined results: null and empty texts have no spans; overlapping spans of different kinds are all reported, and
redacted as one; rows equal in all columns are each reported; an empty table gives an empty result; of extra
columns all stay, except one named ``spans``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.common import table

#: The base patterns as they are meant; for reference and tests.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS, ADDED_KINDS = tuple(PLAIN), ("short_card", "iban", "ssn", "secret")
#: A secret's name and the sign that sets it.
NAMED = r"(?i:token|secret|passwd|password|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?"
#: kind: pattern, a quick test that texts without a match mostly fail.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]"),
    # Chains of fewer than 16 digits fail anyway.
    "card": (r"(?=(?:[ -]?[0-9]){16})[0-9]++(?:[ -][0-9]++)*+", r"(?:[ -]?[0-9]){16}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    "short_card": (r"(?<![0-9])(?<![0-9][ -])(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3(?:0[0-5]|[68][0-9])[0-9][ -]?[0-9]{6}[ -]?[0-9]{4})(?![ -]?[0-9])", r"3[04678][0-9]{2}"),
    "iban": (r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9_])", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"),
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    # What a name of a secret is set to.
    "secret": (rf"{NAMED}[A-Za-z0-9_/+=.~-]{{16,}}+", rf"{NAMED}[A-Za-z0-9_/+=.~-]{{16}}"),
}
#: What a pattern begins with that is no part of the span.
LEADS = {"secret": rf"^{NAMED}"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "short_card": 0.5, "iban": 0.9, "ssn": 0.6, "secret": 0.8}
MIN_SCORE, NEAR, MORE, LESS = 0.5, 40, 0.1, 0.3
#: Different characters that a secret has.
LEAST_DIFFERENT = 8
#: Words that make a kind likelier or less likely when they stand nearby.
CONTEXT = {
    "email": ("mail|contact|write to", "example only|noreply"),
    "ip": (r"\bip\b|server|host|address|login", "version|release|section|chapter"),
    "card": ("card|visa|credit|payment|paid", "order|tracking|isbn|serial"),
    "phone": ("phone|call|tel|fax|mobile", "isbn|serial|invoice"),
    "short_card": ("card|amex|diners|credit|payment", "order|tracking|isbn|serial"),
    "iban": ("iban|bank|account|transfer", "serial|model"),
    "ssn": ("ssn|social|security|tax", "part|serial|order|isbn"),
    "secret": ("key|auth|bearer|login", "example|placeholder|dummy"),
}
SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    figures = F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(figures, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's letters and digits, the first four moved to the end, leave 1 over 97."""
    whole = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(whole, 5, 1 << 20), F.substring(whole, 1, 4))
    figures = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(figures, F.lit(0), lambda r, d: (r * F.when(d > 9, 100).otherwise(10) + d) % 97) == 1


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & luhn(value)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "short_card":
        return luhn(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$")
    if kind == "secret":  # letters and figures, and no few characters over and over
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


def located(text: Column, kind: str, check: Callable[[str, Column], Column] = valid) -> Column:
    """The confirmed matches of ``kind`` with their places in code points, in order; scores by the words nearby."""
    pattern, quick = PATTERNS[kind]
    maybe = text.contains(quick) if len(quick) == 1 else text.rlike(quick)
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["before"]) + F.length(x["value"])
        value = F.regexp_replace(x["value"], LEADS[kind], "") if kind in LEADS else x["value"]
        one = F.array(F.struct(F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), _score(kind, x).alias("score")))
        return F.struct(end.alias("at"), F.when(check(kind, value), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    def summed(between: Column) -> Column:
        sides = F.zip_with(between, F.slice(between, F.lit(2), F.size(between)), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        rows = F.zip_with(F.slice(sides, F.lit(1), F.size(between) - 1), match, lambda s, m: F.struct(s["before"].alias("before"), s["after"].alias("after"), m.alias("value")))
        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])

    none = F.array().cast(SPANS)
    return F.when(maybe, F.transform(F.array(F.split(text, pattern, -1)), summed)[0]).otherwise(none)


def _score(kind: str, x: Column) -> Column:
    """By the words in what is between this match and its neighbours, NEAR characters at most on each side."""
    before = F.substring(x["before"], F.greatest(F.lit(1), F.length(x["before"]) + 1 - NEAR), F.lit(NEAR))
    near = F.lower(F.concat(before, F.lit(" "), F.substring(x["after"], F.lit(1), F.lit(NEAR))))
    more, less = CONTEXT[kind]
    moved = SCORES[kind] + F.when(near.rlike(more), MORE).otherwise(0.0) - F.when(near.rlike(less), LESS).otherwise(0.0)
    return F.least(F.lit(1.0), moved)


def with_spans(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``spans``: by kind as listed, then start."""
    out = docs.drop("spans").withColumns({f"_pii_{k}": located(F.col("text"), k) for k in PATTERNS})
    kept = [F.filter(f"_pii_{k}", lambda s: s["score"] >= min_score) if k in ADDED_KINDS else F.col(f"_pii_{k}") for k in PATTERNS]
    return out.withColumn("spans", F.coalesce(F.concat(*kept), F.array().cast(SPANS))).drop(*[f"_pii_{k}" for k in PATTERNS])


def redacted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by its kind in brackets, and ``spans`` in the old text."""
    out = with_spans(docs, min_score)
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    text = F.aggregate(in_order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.lit((1 << 31) - 1))))
    return out.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text")))


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    joined = F.array_join(F.transform(base, name), ",")
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined, 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))
