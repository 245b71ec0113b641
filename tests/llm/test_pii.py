import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casegrain.llm import pii


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in pii.PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def base_of(rows):
    return [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE_KINDS]) for r in rows]


def test_query_equals_brute_force(spark, sf):
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = brute(d["text"])
        counts = [sum(k == kind for k, _, _ in own) for kind in pii.BASE_KINDS]
        want[d["doc_id"]] = (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest())
    rows = pii.op8_pii(spark, sf).collect()
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows}
    assert got == want and any(sum(v[:4]) for v in want.values())
    for r in rows:
        base = [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE_KINDS] if r["spans"] else []
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


PIECES = ["a@b.c", "a@b.c_d@e.f", "@", "x", ".", "1", "0", "255", "256", " ", "-", "+1", "(2)", "4111 1111 1111 1111", "4111111111111111", "+49 (30) 123-45.67", "é", "😀", "192.168.0.1", "1.2.3.4.5", "_%", "\n", "5500-0000-0000-0004", "12", "999999999999"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30), min_size=80, max_size=120))
def test_patterns_match_what_the_plain_ones_match(spark, docs_of, texts):
    docs = docs_of([(k, "".join(t)) for k, t in enumerate(texts)])
    assert sorted(base_of(pii.with_spans(docs).collect())) == [(k, brute("".join(t))) for k, t in enumerate(texts)]


def test_added_kinds_and_scores(spark, docs_of):
    docs = docs_of([
        (1, "My iban é: DE89 3704 0044 0532 0130 00, thanks"),
        (2, "IBAN GB82WEST12345698765432."),
        (3, "IBAN GB82WEST12345698765431 is wrong"),
        (4, "amex 3782 822463 10005 paid"),
        (5, "tracking 378282246310005"),
        (6, "378282246310006"),
        (7, f"ssn 078-05-1120, {'and so on ' * 5} a part 219-09-9999, 000-12-3456 1078-05-1120"),
        (8, "token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\" API_KEY: AAAAAAAAAAAAAAAAAAAA1 password=short1 é secret:abcdefghijk123456789"),
    ])
    out = {r["doc_id"]: [(s["kind"], s["value"], round(s["score"], 2)) for s in r["spans"]] for r in pii.with_spans(docs).collect()}
    assert out[1] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)]
    assert out[2] == [("iban", "GB82WEST12345698765432", 1.0)] and out[3] == [] == out[6]
    assert out[4] == [("short_card", "3782 822463 10005", 0.6)] and out[5] == []
    assert out[7] == [("ssn", "078-05-1120", 0.7)]
    assert [(k, v) for k, v, _ in out[8]] == [("secret", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"), ("secret", "abcdefghijk123456789")]
    places = {r["doc_id"]: [(s["start"], s["end"], s["value"]) for s in r["spans"]] for r in pii.with_spans(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[i][a:b] == v for i, own in places.items() for a, b, v in own)


def test_redaction(docs_of):
    text = "Write é to a.b@c.de or +49 (30) 1234567, card 4111 1111 1111 1111."
    docs = docs_of([(1, text), (2, "none"), (3, None)])
    out = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert out[1]["text"] == "Write é to [email] or [phone], card [card]." and out[2]["text"] == "none" and out[3]["text"] is None
    assert [text[s["start"] : s["end"]] for s in out[1]["spans"]] == ["a.b@c.de", "4111 1111 1111 1111", "+49 (30) 1234567"]


def test_odd_rows_and_long_runs(spark, odd, docs_of):
    docs = odd.selectExpr("*", "1 as spans", "2 as score", "3 as _email")
    rows = pii.with_spans(docs).collect()
    assert {r["_email"] for r in rows} == {3} and len(rows) == odd.count() and all(r["spans"] == [] for r in rows)
    long = [(1, "7" * 200_000), (2, "a" * 200_000 + "@"), (3, "+" + "1 " * 100_000), (4, "1." * 20_000), (5, "4111-1111-1111-1111 " * 3000), (6, "x@y." + "z." * 50_000)]
    got = dict(base_of(pii.with_spans(docs_of(long)).collect()))
    wide = "1." + "0" * 69 + "7.1." + "0" * 70 + "2"
    assert base_of(pii.with_spans(docs_of([(1, f"{wide}.4"), (2, f"x {wide[:-72]}255.255")])).collect()) == [(1, brute(f"{wide}.4")), (2, brute(f"x {wide[:-72]}255.255"))]
    assert [k for k, _, _ in brute(f"{wide}.4")] == ["ip"]
    assert got == {k: brute(t) if k > 2 else [] for k, t in long}  # the plain patterns take a square of the time on 1 and 2
    assert pii.with_spans(docs_of([])).count() == 0 and pii.redacted(odd).count() == odd.count()


def test_all_in_the_jvm(spark, sf):
    plan = pii.op8_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert spark.range(1).select(pii.luhn(F.lit("4111111111111111"))).first()[0]
