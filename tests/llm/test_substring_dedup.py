import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from casegrain.llm import substring_dedup as sub


def brute(docs, unit="line", min_words=0):
    """docs: (doc_id, text). Spans to remove by plain dictionaries."""
    spark = SparkSession.getActiveSession()
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(t,) for _, t in docs], "t string").select("t", F.xxhash64("t")).collect()}
    ranked = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, hashes[d[1]]))
    first, out = {}, []
    for n, (i, text) in enumerate(ranked):
        for place, (_, _, _, norm) in enumerate(sub.units_of(text, unit)):
            first.setdefault(norm, (n, place))
    for n, (i, text) in enumerate(ranked):
        run = []
        for place, (a, b, words, norm) in enumerate([*sub.units_of(text, unit), (0, 0, 0, None)]):
            if norm is not None and first[norm] != (n, place):
                run.append((a, b, words, first[norm][0]))
                continue
            if run and sum(r[2] for r in run) >= min_words:
                kept = sorted({ranked[r[3]][0] for r in run if ranked[r[3]][0] is not None})
                out.append((i, run[0][0], run[-1][1], sum(r[2] for r in run), len(run), tuple(kept)))
            run = []
    return sorted(out, key=str)


def ids(value):
    return tuple(int(x) for x in value.split(",")) if isinstance(value, str) else tuple(value)


def plain(rows):
    assert all(r["kept_doc_id"] in ids(r["kept_doc_ids"]) or r["kept_doc_id"] is None for r in rows)
    return sorted(((r["doc_id"], r["start"], r["end"], r["n_words"], r["n_units"], ids(r["kept_doc_ids"])) for r in rows), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sub.op10_substring_dedup(spark, sf).collect()
    assert plain(rows) == brute(docs, "piece", 20) and rows


def test_every_later_line_goes(docs_of):
    line = "This work is under the licence of its author."
    docs = docs_of([(1, f"One start.\n{line}\nOne end."), (2, f"Two start.\n  {line.upper()}\nTwo end.\n{line}"), (3, "Clean text.")])
    (a, b) = sorted(sub.removals(docs).collect(), key=lambda r: r["start"])
    assert (a["doc_id"], a["n_words"], a["kept_doc_id"], b["doc_id"], b["n_units"]) == (2, 9, 1, 2, 1)
    out = {r["doc_id"]: r for r in sub.deduplicated(docs).collect()}
    assert out[2]["text"] == "Two start.\n  \nTwo end.\n" and out[1]["removed"] == out[3]["removed"] == []
    assert sub.removals(docs, min_words=10).count() == 0


def test_paragraphs(docs_of):
    part = "A first line\nand a second one"
    docs = docs_of([(1, f"Start\n\n{part}\n \t\nend of it"), (2, f"{part}\n\nand a second one"), (3, "and a second one")])
    got = {(r["doc_id"], r["start"], r["end"]) for r in sub.removals(docs, "paragraph").collect()}
    assert got == {(2, 0, len(part)), (3, 0, 16)}


def test_of_equal_rows_the_first_stays(spark, docs_of):
    text = "A text of some words that stands twice under one id, and that's that."
    docs = docs_of([(7, text), (7, text), (7, text), (8, "another")])
    rows = sub.removals(docs).collect()
    assert [(r["doc_id"], r["repeat"], r["start"], r["end"], r["kept_doc_id"]) for r in rows] == [(7, True, 0, len(text), 7)] * 2
    out = docs.withColumn("extra", F.monotonically_increasing_id())
    for table in (docs, out):
        texts = sorted((r["doc_id"], r["text"]) for r in sub.deduplicated(table).collect())
        assert texts == [(7, ""), (7, ""), (7, text), (8, "another")]
    assert len({r["extra"] for r in sub.deduplicated(out).collect()}) == 4


@pytest.mark.parametrize("dotted", [True, False])
def test_passages_that_begin_and_end_inside_sentences(docs_of, dotted):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "mi", "so", "ren", "lu", "pak"]) for _ in range(rng.randint(2, 5)))
    some = lambda n: [word() + ("." if dotted and rng.random() < 0.1 else "") for _ in range(n)]
    rows, share = [], []
    for k in range(60):
        passage = some(rng.randint(50, 70))
        for n in (2 * k, 2 * k + 1):
            before = some(rng.randint(20, 60))
            rows.append((n, " ".join([*before, *passage, *some(30)])))
        a = len(" ".join(before)) + 1
        share.append((2 * k + 1, a, a + len(" ".join(passage))))
    spans = {}
    for r in sub.removals(docs_of(rows), "piece", sub.QUERY_WORDS).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    covered = [sum(max(0, min(z, y) - max(a, x)) for x, y in spans.get(i, [])) / (z - a) for i, a, z in share]
    assert sum(c > 0 for c in covered) >= 0.9 * len(share) and sum(covered) / len(covered) > 0.6
    assert set(spans) <= {i for i, _, _ in share}


def test_shared_passage_goes_and_the_rest_stays(docs_of):
    passage = " ".join(f"Word{k} stands in the shared passage number {k}." for k in range(8))
    docs = docs_of([(1, f"Own start here {passage} and own end."), (2, f"Other text é before it. {passage.upper()}  More of it"), (3, "Yes. No. Clean text of its own. Yes. No."), (4, "Yes. No.")])
    out = {r["doc_id"]: r for r in sub.deduplicated(docs, "piece", 20).collect()}
    assert out[1]["removed"] == [] and out[3]["removed"] == [] and out[4]["text"] == "Yes. No."
    (span,) = out[2]["removed"]
    old = f"Other text é before it. {passage.upper()}  More of it"
    assert out[2]["text"] == old[: span["start"]] + old[span["end"] :]
    assert old[span["start"] : span["end"]].count("STANDS") == 7  # the first sentence is joined to other words in document 1


def test_units_are_whole_and_in_place():
    text = " a b. C?! d\n\n e.f  g...\r\nh "
    assert [(text[a:b], n) for a, b, _, n in sub.units_of(text, "piece")] == [("a b.", "a b."), ("C?!", "c?!"), ("d", "d"), ("e.f  g...", "e.f g..."), ("h", "h")]
    assert [n for *_, n in sub.units_of(text)] == ["a b. c?! d", "e.f g...", "h"]
    long = " ".join(f"word{k}" for k in range(100))
    parts = list(sub.units_of(long, "piece"))
    assert len(parts) > 4 and " ".join(n for *_, n in parts) == long and all(long[a:b] == n and n.count(" ") + 1 == w for a, b, w, n in parts)


def test_odd_rows(spark, odd, docs_of):
    for unit in sub.BREAKS:
        assert plain(sub.removals(odd, unit).collect()) == brute([(d["doc_id"], d["text"]) for d in odd.collect()], unit)
    clash = odd.selectExpr("*", "1 as start", "2 as removed", "3 as words", "4 as row")
    out = sub.deduplicated(clash)
    assert out.count() == odd.count() and sorted(out.columns) == sorted(clash.columns)
    assert sub.removals(docs_of([])).count() == 0 == sub.deduplicated(docs_of([])).count()
