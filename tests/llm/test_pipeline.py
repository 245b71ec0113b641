import os
import re

import corpus_pipeline
from casegrain.llm import decontamination, sharding, simhash, toxicity
from tests.llm.test_decontamination import WORD

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def similar(rows):
    """Least id of each class of pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, label = [], list(range(len(rows)))
    for _, text in rows:
        words = SPACED.findall(lower(text))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    order = sorted(range(len(rows)), key=lambda k: len(sets[k]))
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if 0.8 * len(sets[b]) > len(sets[a]):
                break
            if label[a] != label[b]:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    label = [label[b] if c == label[a] else c for c in label]
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    return sorted(least.values())


def windows_of(items):
    out = {}
    for _, text in items:
        words = WORD.findall(lower(text))
        m = min(10, len(words))
        for k in range(len(words) - m + 1) if words else ():
            out.setdefault(m, set()).add(tuple(words[k : k + m]))
    return out


def leaks(text, windows):
    """Number of words, number of those hit, runs of hit words in characters."""
    at = list(WORD.finditer(lower(text)))
    words, hit = [m[0] for m in at], set()
    for m, known in windows.items():
        for k in range(len(words) - m + 1):
            if tuple(words[k : k + m]) in known:
                hit |= set(range(k, k + m))
    starts, ends = [k for k in sorted(hit) if k - 1 not in hit], [k for k in sorted(hit) if k + 1 not in hit]
    return len(words), len(hit), [(at[a].start(), at[b].end()) for a, b in zip(starts, ends, strict=True)]


def cut_out(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


def test_stages_against_brute_force(spark, sf, tmp_path):
    d = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], d)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert out.columns == names and out.dtypes == docs.dtypes
    clean, unique, cut, mixed, shards = seen[1:]

    model = toxicity.learned(docs, spark.read.parquet(f"{d}/labels.parquet"), toxicity.F.lit(True))
    want = {r["doc_id"] for r in toxicity.scored(docs, model).select("row.doc_id", "score").collect() if r["score"] < 0.5}
    assert {r["doc_id"] for r in clean.collect()} == want and len(want) < docs.count()

    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert sorted(r["doc_id"] for r in unique.collect()) == similar(rows) and unique.count() < len(rows)

    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    windows = windows_of(items)
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    after = {r["doc_id"]: r for r in cut.collect()}
    for i, text in texts.items():
        n_words, n_hit, spans = leaks(text, windows)
        if not spans:
            assert after[i]["text"] == text
        elif n_hit >= decontamination.MAX_COVERAGE * n_words:
            assert i not in after
        else:
            assert after[i]["text"] == cut_out(text, spans) and after[i]["n_chars"] == len(after[i]["text"])
    assert any(i in after and after[i]["text"] != texts[i] for i in texts)

    ids = [r["doc_id"] for r in mixed.collect()]
    assert set(ids) <= set(after) and max(map(ids.count, set(ids))) <= 3
    assert sorted(r["doc_id"] for r in shards.collect()) == sorted(ids)
    by = {}
    for r in shards.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(by) < sharding.SHARDS


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
    assert simhash.TAU == 3


def test_stages_take_odd_rows_and_empty_tables(spark, sf, odd, docs_of):
    for docs in (odd, docs_of([])):
        seen = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, seen, sf)
            rows = out.collect()
            assert len(rows) <= 3 * docs.count(), name
            if name != "sharding":
                assert out.columns == docs.columns
                seen = spark.createDataFrame(rows, out.schema)
        assert bool(rows) == bool(docs.count())
