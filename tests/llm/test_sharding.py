import hashlib
import zlib

import numpy as np
import pytest

from casegrain.llm import sharding


def check(rows, docs, shards, slack=0.0):
    want = sorted((d["doc_id"] is None, d["doc_id"] or 0, len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(shards):
        assert abs(sum(s for _, s in by.get(k, [])) - total / shards) <= most + slack * total / shards


def test_query(spark, sf):
    rows = sharding.op7_shard(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(rows, docs, 40, 0.02)
    texts = {}
    for d, r in zip(sorted(docs), sorted(rows), strict=True):
        texts.setdefault(d["text"], set()).add(r["shard"])
    assert max(map(len, texts.values())) <= 2
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert sorted(rows) == sorted(sharding.op7_shard(spark, sf).collect())


def test_hot_text_is_cut_and_others_stay_together(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)  # poor splitters: ranges are subdivided
    docs = docs_of([(k, "hot " * 30 if k % 3 == 0 else f"text {k // 20} " * 2) for k in range(1800)])
    rows = sharding.sharded(docs, 4).collect()
    check(rows, docs.collect(), 4, 0.02)
    groups = {}
    for r in rows:
        groups.setdefault(r["text"], set()).add(r["shard"])
    assert len(groups["hot " * 30]) > 1
    assert len(groups) == 91 and sum(len(s) > 1 for t, s in groups.items() if t[0] != "h") == 0


def brute(docs, shards):
    """Shards by plain sums along the line."""
    key = lambda x: int(hashlib.sha256(x.encode()).hexdigest()[:15], 16)
    rows = sorted((key(t or ""), key(str(i)), i, t or "") for i, t in docs)
    size = lambda r: len(r[3].encode()) + 16
    total, at, out, groups, places = sum(map(size, rows)), 0, [], {}, {}
    for r in rows:
        groups.setdefault(r[3], [at, 0])[1] += size(r)
        at += size(r)
    at = 0
    for r in rows:
        start, whole = groups[r[3]]
        mid = start + whole // 2 if whole * shards * sharding.WHOLE_PART <= total else at + size(r) // 2
        shard = min(shards * mid // total, shards - 1)
        at += size(r)
        out.append((r[2], shard, places.setdefault(shard, 0)))
        places[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("per_range", [10, 300, 1_000_000])
def test_placement_does_not_depend_on_ranges(docs_of, monkeypatch, per_range):
    """A third of the rows are copies of one text, some groups are as large as a shard may keep whole."""
    docs = [(k, "hot " * 30 if k % 3 == 0 else f"group {k % 7} " * 9 if k % 5 == 0 else f"text {k // 20} " * 2) for k in range(3571)]
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", per_range)
    monkeypatch.setattr(sharding, "WHOLE_PART", 2)
    want = brute(docs, 4)
    for made in (sharding.sharded, sharding.assigned):
        assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in made(docs_of(docs), 4).collect()) == want


def test_rows_without_ids_are_cut_too(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 20)
    docs = docs_of([(None, "same text") if k % 3 else (k, f"other {k}") for k in range(900)])
    slim = sharding.keyed(docs, sharding.F.monotonically_increasing_id()).select("doc_id", "size", *sharding.KEYS)
    parts, total = sharding.sampled_parts(slim, 2)
    assert parts.by_salt and max(r["b"] for r in sharding._summed(slim, parts, "_shard_h").collect()) < total / 10
    check(sharding.assigned(docs, 2).collect(), docs.collect(), 2, 0.02)


def test_odd_rows(odd, docs_of):
    clash = odd.selectExpr("*", "'x' as shard", "1 as _n", "2 as extra", "3 as _key")
    out = sharding.sharded(clash, 3)
    rows = out.collect()
    assert {"extra", "lang"} <= set(out.columns) and {(r["_n"], r["_key"], r["extra"]) for r in rows} == {(1, 3, 2)}
    assert len(rows) == odd.count() and {r["shard"] for r in rows} <= {0, 1, 2}
    assert sharding.sharded(docs_of([]), 5).count() == 0


def test_binary_search(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 100):
        line = sorted({int(x) for x in rng.integers(-50, 50, n)})
        keys = spark.range(-60, 60)
        for r in keys.select("id", sharding._fold(line, keys.id).alias("at")).collect():
            assert r["at"] == sum(x <= r["id"] for x in line)
