import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrain.llm import warc


def want(pages):
    first = {}
    for p in pages:
        body = (p["html"] or "").encode()
        if len(body) >= 100 and p["page_id"] is not None:
            first[body] = min(first.get(body, p["page_id"]), p["page_id"])
    out = []
    for p in pages:
        body = (p["html"] or "").encode()
        old = first.get(body)
        again = old is not None and p["page_id"] is not None and old != p["page_id"]
        out.append((p["page_id"], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", old if again else None))
    return sorted(out, key=str)


def test_query_is_an_exact_round_trip(spark, sf):
    rows = warc.op3_warc(spark, sf)
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, rows.collect()), key=str) == want(spark.read.parquet(f"{sf}/pages.parquet").collect())


def test_odd_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 2000)  # several files for a task
    long, same = "é" * 3_000_000, "<p>same</p>" * 30
    pages = [(1, "u", None), (2, None, ""), (3, "a b\r\nX: y", long), (9, "u", same), (4, "u", same), (4, "u", same), (None, "u", same), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "x" * 100), (8, "u", "x" * 100), (10, "u" * 3_000_000, "long url")]
    table = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, payload int")
    files = warc.write_archives(warc.planned(table), str(tmp_path))
    got = warc.read_archives(spark, files, keep=True).collect()
    assert files.count() > 1 and sum(f["records"] for f in files.collect()) == len(pages)
    as_tuple = sorted(((int(r["page_id"]) if r["page_id"] else None, r["payload_bytes"], r["payload_digest"], r["record_type"], int(r["refers_to"]) if r["refers_to"] else None) for r in got), key=str)
    assert as_tuple == want([dict(zip(("page_id", "url", "html"), p, strict=True)) for p in pages])
    assert {bytes(r["payload"]) for r in got if r["page_id"] == "3"} == {long.encode()}
    assert {r["page_id"]: r["url"] for r in got}["10"] is None and {r["page_id"]: r["url"] for r in got}["3"] == "a%20b%0D%0AX:%20y"
    none = warc.write_archives(warc.planned(table.limit(0)), str(tmp_path))
    assert warc.read_archives(spark, none).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.binary(max_size=500)), max_size=6), st.integers(1, 700))
def test_reader_takes_any_chunks(pages, chunk):
    line = b"".join(gzip.compress(warc.record(str(i), "http://a/", body, hashlib.sha256(body).hexdigest(), "response", None)) for i, body in pages)
    got = list(warc.records((line[k : k + chunk] for k in range(0, len(line), chunk)), keep=True))
    assert [(int(r["page_id"]), r["payload"]) for r in got] == pages


def test_faults_are_found(spark, tmp_path):
    body = b"payload" * 40
    good = warc.record("1", None, body, hashlib.sha256(body).hexdigest(), "response", None)
    for bad in (good.replace(b"payloadpay", b"payl0adpay"), good[:-2], good + b"x", good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: ", b"Content-Length: -")):
        with pytest.raises(warc.Broken):
            list(warc.records([gzip.compress(bad)]))
    with pytest.raises(warc.Broken):
        list(warc.records([gzip.compress(good)[:-9]]))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good) + b"junk")
    rows = warc.read_archives(spark, spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")).collect()
    assert [r["page_id"] for r in rows] == ["1", None] and "gzip" in rows[1]["error"]


def test_payloads_are_not_shuffled_for_few_repeats(spark, sf):
    plan = warc.planned(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
