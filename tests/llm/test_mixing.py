import re

from casegrain.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes):
    """Targets by handing on the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    return target


def check(rows, docs):
    sizes, want = {}, {}
    for d in docs:
        n = len(WORD.findall(d["text"] or ""))
        want[d["doc_id"]] = n
        sizes[d["source"]] = sizes.get(d["source"], 0) + n
    target = level(sizes)
    taken = {}
    for r in rows:
        assert r["size"] == want[r["doc_id"]] or r["doc_id"] is None
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate + 1e-9) <= r["copies"] + (abs(rate - round(rate)) < 1e-9) and r["copies"] <= int(rate) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    return target, taken


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = mixing.op1_mix_sources(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    target, taken = check(rows, docs)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.1 * sum(target.values())
    for s in target:  # within five standard deviations of one Bernoulli draw a document
        own = [r for r in rows if r["source"] == s]
        frac = (target[s] / own[0]["source_size"]) % 1 if own[0]["source_size"] else 0
        assert abs(taken[s] - target[s]) <= 5 * (frac * (1 - frac) * sum(r["size"] ** 2 for r in own)) ** 0.5 + 1e-6
    assert sorted(rows, key=str) == sorted(mixing.op1_mix_sources(spark, sf).collect(), key=str)


def test_odd_rows(odd):
    sizes = mixing.written(mixing.sized(odd).select("doc_id", "source", "size"), "t")
    rows = mixing.with_copies(sizes, mixing.repetition_rates(sizes)).collect()
    assert len(rows) == odd.count()
    check(rows, odd.collect())


def test_mixed_keeps_clashing_columns_and_repeats_rows(odd):
    docs = odd.selectExpr("*", "1 as size", "'t' as target", "2 as copies")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(v for k, v in counts.items() if k not in (5, None)) <= 3


def test_empty(docs_of):
    assert mixing.mixed(docs_of([])).count() == 0
    assert mixing.source_targets(mixing.sized(docs_of([(1, None), (2, "")]))).collect()[0]["target"] == 0


def test_copies_average_the_rate(docs_of, spark):
    sizes = spark.range(3000).selectExpr("id as doc_id", "concat('s', id) as source", "10L as size")
    for rate in (0.75, 1.875, 0.1):
        rates = sizes.selectExpr("source", "size as source_size", f"{rate} * 10D as target", f"{rate}D as rate")
        copies = [r["copies"] for r in mixing.with_copies(sizes, rates).collect()]
        frac = rate % 1
        assert abs(sum(copies) / 3000 - rate) < 3 * (frac * (1 - frac) / 3000) ** 0.5
        assert set(copies) == {int(rate), int(rate) + 1}
    other = [r["copies"] for r in mixing.with_copies(sizes, rates, "another").collect()]
    assert other != copies
