import collections
import math
import re

import xxhash

from casegrain.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {x for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for x in range(k, k + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def hashed(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def buckets(text):
    own = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    n = rules.GRAM_BUCKETS
    return [signed(h) % n for h in own] + [signed(hashed(p)) % n for p in zip(own, own[1:])]


def brute(docs, trusted):
    raw, target = collections.Counter(), collections.Counter()
    for t in docs:
        raw.update(buckets(t))
    for t in trusted:
        target.update(buckets(t))
    rate = sum(target.values()) / max(1, sum(raw.values()))

    def score(text):
        own = buckets(text)
        if not own or not rate:
            return 0.0
        return sum(math.log((target[b] + rules.SHRINK * rate) / (raw[b] + rules.SHRINK) / rate) for b in own) / len(own)

    return [(*base(t), not base(t)[5] and score(t) >= rules.THRESHOLD, score(t)) for t in docs]


def test_query_equals_brute_force(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect())
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1}
    want = brute([d["text"] for d in docs], [d["text"] for d in docs if d["doc_id"] in good])
    rows = sorted(rules.op6_quality_rules(spark, sf).collect())
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    for r, w in zip(rows, want, strict=True):
        assert tuple(r)[1:7] == w[:6]
        assert abs(r["score"] - w[7]) < 1e-9
        assert r["kept"] == w[6]
    assert {r["kept"] for r in rows} == {True, False}


def test_windows(spark, docs_of):
    texts = ["a b c d e a b c d e", "a a a a a a", "a a a a a", "a b c d e f a b c d e", "x y\nx y\n \n \nz", "a\x1cb c d e", "#*$%&|<> <", None, "", "one\r\none\r\none", " ".join("abcdefg" * 3)]
    rows = sorted(rules.based(docs_of(list(enumerate(texts)))).collect())
    for r, t in zip(rows, texts, strict=True):
        assert tuple(r[c] for c in rules.BASE) == base(t), t


def test_odd_rows(spark, odd, docs_of):
    docs = odd.selectExpr("*", "1 as score", "2 as n_words", "3 as bucket")
    rows = rules.verdicts(docs, docs.limit(0)).collect()
    assert len(rows) == odd.count() and {r["score"] for r in rows} == {0.0}
    assert sorted(map(str, (tuple(r[c] for c in rules.BASE) for r in rows))) == sorted(map(str, (base(d["text"]) for d in odd.collect())))
    kept = rules.filtered(docs, docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d["doc_id"]) for d in odd.collect() if not base(d["text"])[5])
    empty = docs_of([])
    assert rules.verdicts(empty, empty).count() == 0


def test_all_in_the_jvm(spark, sf):
    plan = rules.op6_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_verdicts_stay_when_the_corpus_grows(docs_of, monkeypatch):
    monkeypatch.setattr(rules, "GRAM_BUCKETS", 256)
    good = [(k, " ".join(f"good{(k * 7 + j * j) % 97}" for j in range(60))) for k in range(40)]
    bad = [(100 + k, " ".join(f"bad{(k * 5 + j * j) % 89}" for j in range(60))) for k in range(40)]
    more = [(1000 + k, " ".join(f"n{k}x{j}" for j in range(300))) for k in range(400)]

    def rated(rows):
        docs = docs_of(rows)
        return {r["doc_id"]: r for r in rules.verdicts(docs, docs.where("doc_id < 40 or doc_id >= 1000 and doc_id % 2 = 0")).collect() if r["doc_id"] < 1000}

    small, large = rated(good + bad), rated(good + bad + more)
    kept = {i: r["kept"] for i, r in small.items()}
    assert {r["base_failed"] for r in small.values()} == {False} and {i for i, k in kept.items() if k} == set(range(40))
    assert {i: r["kept"] for i, r in large.items()} == kept
    monkeypatch.setattr(rules, "MOST_BROADCAST", 0)  # by a shuffle
    again = rated(good + bad + more)
    assert all(abs(again[i]["score"] - large[i]["score"]) < 1e-9 for i in large)


def test_ratios_lie_side_by_side_and_tasks_count_much(docs_of, monkeypatch):
    """A broadcast row has the ratios of many buckets, and what tasks send on is summed over many partitions of the input."""
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 31}" for j in range(40))) for k in range(200)]
    docs = docs_of(rows)
    ratios = rules.gram_ratios(docs, docs.where("doc_id < 50"), rules.GRAM_BUCKETS)
    grams = set().union(*(buckets(t) for _, t in rows))
    got = {r["block"]: r["ratios"] for r in ratios.collect()}
    assert set(got) == {b // rules.SLOTS for b in grams} and {len(x) for x in got.values()} == {rules.SLOTS}
    assert {b * rules.SLOTS + k for b, x in got.items() for k, v in enumerate(x) if v is not None} == grams
    tasks = []
    real = rules.exploded
    monkeypatch.setattr(rules, "exploded", lambda df, *a: tasks.append(df.rdd.getNumPartitions()) or real(df, *a))
    rules.gram_ratios(docs.repartition(100), docs.limit(0), rules.GRAM_BUCKETS)
    assert tasks == [docs.sparkSession.sparkContext.defaultParallelism]


def test_windows_are_hashed_where_four_words_repeat(docs_of):
    """Of texts in which no four words come twice, no five-word window is hashed and sorted; others give what brute force gives."""
    texts = ["a b c d x a b c d y", "a b c d x y a b c d", "a a a", "a a a a", "a a", "a b a b", "a b c a b c", "p q a b c d e r s a b c d e", "a b c d e f a b c d x a b c d e", " ".join("abcab" * 7)]
    docs = rules.based(docs_of(list(enumerate(texts))))
    for r, t in zip(sorted(docs.collect()), texts, strict=True):
        assert tuple(r[c] for c in rules.BASE) == base(t), t
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1  # pairs of words


def test_a_row_for_each_word_looks_up_the_word_and_its_pair(docs_of):
    """Words are cut by splitting at single white spaces; a word and the pair it begins are looked up in one row."""
    texts = ["a  b", " a b", "a b ", "\ta\x0b\x0cb\r\n c \n", "a\x1cb c é\U0001f600 d", "one", " ", "\n\n", "", None, " ".join(f"w{k * k % 17}" for k in range(60))]
    docs = docs_of(list(enumerate(texts)))
    rows = rules.exploded(rules.parted(docs), rules.GRAM_BUCKETS, "doc_id").collect()
    for k, t in enumerate(texts):
        assert collections.Counter(r["bucket"] for r in rows if r["doc_id"] == k) == collections.Counter(buckets(t)), t
    assert [tuple(r[c] for c in rules.BASE) for r in sorted(rules.based(docs).collect())] == [base(t) for t in texts]
    got = sorted(rules.verdicts(docs, docs.where("doc_id < 4")).collect())
    assert all(abs(r["score"] - w[7]) < 1e-9 for r, w in zip(got, brute(texts, texts[:4]), strict=True))
    plan = rules.rated(docs, rules.gram_ratios(docs, docs, 256), 256)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(") == plan.count("Generate ") == 1 and rules.ONE_SPACE in plan


def test_windows_of_few_different_words(docs_of):
    """Texts full of repetition, of every length about that of a window; words and fours are hashed in one step, without pairs."""
    texts = [" ".join(f"w{(k * 7919 + j * j * (k % 5 + 1) + j // 3) % (2 + k % 5)}" for j in range(k % 29)) for k in range(400)]
    docs = rules.based(docs_of(list(enumerate(texts))))
    assert [tuple(r[c] for c in rules.BASE) for r in sorted(docs.collect())] == [base(t) for t in texts]
    assert "_pairs" not in docs._jdf.queryExecution().optimizedPlan().toString()
