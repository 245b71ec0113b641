import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrain.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """prints: (id or None, fingerprint) rows -> least id reachable, for each row."""
    own = np.array([p for _, p in prints], np.uint64)
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in np.flatnonzero(np.bitwise_count(own ^ own[a]) <= 3).tolist():
            x, y = label[a], label[b]
            if x != y:
                label = [min(x, y) if c in (x, y) else c for c in label]
    least = {}
    for (i, _), c in zip(prints, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return [least[c] for c in label]


def test_query_equals_brute_force(spark, sf):
    docs = [(d["doc_id"], brute_print(d["text"])) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(docs, brute_classes(docs), strict=True)}
    rows = simhash.op9_simhash(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    assert any(c != i for i, (_, c) in want.items())


def test_fingerprint_equals_spark_hash(spark):
    got = spark.sql("select xxhash64('ab cd é')").first()[0]
    assert xxhash.xxh64_intdigest("ab cd é".encode(), 42) == got % 2**64


@pytest.mark.parametrize("hot", [simhash.HOT, 5])
def test_planted_neighbours(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(7)
    rows = []
    for c in range(60):  # chains whose ends are far apart, and dense balls
        at = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(12):
            rows.append((len(rows), at))
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                at ^= 1 << int(b)
    rows += [(len(rows) + k, int(rng.integers(0, 2**63))) for k in range(1500)]
    rows += [(len(rows) + k, int(rng.integers(0, 2**20)) << 30) for k in range(300)]  # many share their lowest bits
    rows += [(len(rows), 0), (len(rows) + 1, 7), (len(rows) + 2, 15), (None, 0)]
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in rows]
    prints = simhash.written(spark.createDataFrame(signed, "doc_id long, fp long"), "t")
    got = {(r["doc_id"], r["fp"] % 2**64): r["component_id"] for r in simhash.classed(prints).collect()}
    assert got == dict(zip(rows, brute_classes(rows), strict=True))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.integers(2, 60))
def test_forest_connects_like_all_links(seed, n):
    rng = np.random.default_rng(seed)
    own = np.unique(rng.integers(0, 2**12, n).astype(np.uint64))
    old, simhash.DENSE = simhash.DENSE, 8
    try:
        edges = simhash.forest(own, 3)
    finally:
        simhash.DENSE = old
    label = list(range(len(own)))
    for a, b in edges:
        assert int(np.bitwise_count(own[a] ^ own[b])) <= 3
        label = [label[a] if c == label[b] else c for c in label]
    assert len(edges) < max(1, len(own))
    want = brute_classes(list(enumerate(own.tolist())))
    assert len(set(label)) == len(set(want))


def test_thresholds_cover_every_linked_pair():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 500).astype(np.uint64)
    prints[:250] &= np.uint64(0xFFFFFFFF00000003)  # one half says little
    parts = simhash.grouped_bits(prints)
    assert sorted(parts[0] + parts[1]) == list(range(64))
    shares = []
    for bits in parts:
        for j in (0, 16):
            v = simhash.packed(prints, bits[j : j + 16]).astype(np.int64)
            shares.append(simhash.near_counts(np.bincount(v, minlength=1 << 16) / len(v), 3))
    limits = simhash.allocated(prints, parts, shares, 10**9, 3)
    assert (limits.sum(axis=1) == 2).all() and limits.min() >= -1
    assert len({tuple(x) for x in limits.tolist()}) > 1  # unequal where counts differ


def test_odd_rows(odd, docs_of):
    rows = simhash.near_duplicates(odd.selectExpr("*", "1 as fp", "2 as component_id")).collect()
    assert len(rows) == odd.count()
    want = [(d["doc_id"], brute_print(d["text"])) for d in odd.collect()]
    assert sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows))) == sorted(map(str, ((i, f"{p:016x}", c) for (i, p), c in zip(want, brute_classes(want), strict=True))))
    kept = simhash.deduplicated(odd.selectExpr("*", "1 as fp", "2 as component_id")).collect()
    assert len(kept) == len({r["component_id"] for r in rows}) and len(kept[0]) == 7
    assert simhash.near_duplicates(docs_of([])).count() == 0 == simhash.deduplicated(docs_of([])).count()


def test_forests_do_not_depend_on_batches():
    rng = np.random.default_rng(9)
    bucket = np.sort(rng.integers(0, 12, 400))
    prints = rng.permutation(4096)[:400].astype(np.int64)
    table = [pa.array(bucket), pa.array(prints), pa.array(np.ones(400, bool))]
    whole = {r for b in simhash._forests(3)(iter([pa.RecordBatch.from_arrays(table, names=["bucket", "fp", "home"])])) for r in zip(*b.to_pydict().values(), strict=True)}
    for size in (1, 7, 64):
        parts = [pa.RecordBatch.from_arrays([c.slice(k, size) for c in table], names=["bucket", "fp", "home"]) for k in range(0, 400, size)]
        assert {r for b in simhash._forests(3)(iter(parts)) for r in zip(*b.to_pydict().values(), strict=True)} == whole and whole
