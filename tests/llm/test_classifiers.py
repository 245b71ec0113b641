import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrain.llm import quality, toxicity


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    return float(np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]))


def held_out(rows, labels, label, mod, at):
    known = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == at)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    own = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    return [s for s, _ in own], [y for _, y in own]


def test_quality_on_held_out_rows(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = quality.op4_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    scores, labels = held_out(rows, spark.read.parquet(f"{d}/labels.parquet"), "quality", 3, 1)
    assert auc(scores, labels) > 0.97
    assert np.mean([(s >= 0.5) == y for s, y in zip(scores, labels, strict=True)]) > 0.93
    assert sorted(rows) == sorted(quality.op4_quality(spark, d).collect())


def test_toxicity_on_held_out_rows(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    rows = toxicity.op5_toxicity(spark, d).collect()
    scores, labels = held_out(rows, spark.read.parquet(f"{d}/labels.parquet"), "toxic", 5, 0)
    assert auc(scores, labels) > 0.93
    hit = [y for s, y in zip(scores, labels, strict=True) if s >= 0.5]
    assert np.mean(hit) > 0.9 and sum(hit) > 0.85 * sum(labels)


def test_planted_words_are_found(docs_of, spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "mi", "so", "ren", "lu", "pak"]) for _ in range(rng.randint(1, 4)))
    bad = ["zgrumpf", "vlakkor", "xibbet"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = [rng.choice(bad) if toxic and rng.random() < 0.08 else word() for _ in range(120)]
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame([(i, y) for i, y in labels if i < 300], "doc_id long, toxic int")
    model = toxicity.learned(docs_of(rows), table, F.lit(True))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.scored(docs_of(rows), model).select("row.doc_id", "score").collect()}
    assert np.mean([got[i] == bool(y) for i, y in labels if i >= 300]) > 0.95
    kept = toxicity.detoxified(docs_of(rows).selectExpr("*", "1 as score", "2 as row"), table)
    assert kept.columns[-2:] == ["score", "row"] and kept.count() < 330


def test_context_sums_do_not_depend_on_batches():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "B,", "c!!", "d"]) for _ in range(rng.randint(0, 60))).encode() for _ in range(50)]
    index, tokens = quality.index_vectors(), quality.Tokens()
    want = np.zeros((quality.BUCKETS, quality.DIM + 1), np.int64)
    for t in texts:
        own = tokens(t).tolist()
        for k, b in enumerate(own):
            want[b, : quality.DIM] += sum(index[own[j]].astype(int) for j in range(max(0, k - 2), min(len(own), k + 3)) if j != k)
            want[b, quality.DIM] += 1
    for chunk in (7, 1 << 16):
        old, quality.CHUNK = quality.CHUNK, chunk
        try:
            assert (quality.summed(iter(texts)) == want).all()
        finally:
            quality.CHUNK = old


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd, docs_of, module, label):
    one = F.lit(True)
    few = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (8, None), (99, 0), (2, 0)], f"doc_id long, {label} int")
    clash = odd.selectExpr("*", "1 as row", "'x' as score", "2 as y")
    for labels in (few, few.limit(0), few.where("doc_id = 4")):
        out = module.scored(clash, module.learned(clash, labels, one)).select("row.*", F.col("score").alias("s")).collect()
        assert len(out) == odd.count() and all(0 <= r["s"] <= 1 for r in out)
    empty = docs_of([])
    assert module.scored(empty, module.learned(empty, few, one)).count() == 0


def flipped(spark, sf, tmp_path, label, mod, at):
    """The tables with all labels of held-out rows turned round."""
    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "labels":
            out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == at
            rows = rows.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_quality_query_equals_plain_code(spark, sf, tmp_path):
    """Word vectors, pooling and network once more, without numpy's help where it can be left out."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    net = quality.learned(spark.read.parquet(f"{sf}/documents.parquet"), labels, learn)["net"]
    index = quality.index_vectors()
    number = lambda t: zlib.crc32(t) % (quality.BUCKETS - 1) + 1
    lines = {i: [number(t) for t in quality.TOKEN.findall(text)] for i, text in docs.items()}
    sums, counts = {}, {}
    for line in lines.values():
        for k, b in enumerate(line):
            near = [line[j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(line)]
            sums[b] = sums.get(b, 0) + sum((index[c].astype(float) for c in near), np.zeros(quality.DIM))
            counts[b] = counts.get(b, 0) + 1
    middle = sum(sums.values()) / sum(counts.values())
    vectors = {b: s / counts[b] - middle for b, s in sums.items()}
    vectors = {b: v / max(np.sqrt((v * v).sum()), 1e-9) for b, v in vectors.items()}
    got = {r["doc_id"]: r["score"] for r in quality.op4_quality(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, line in lines.items():
        x = np.zeros(quality.FEATURES)
        if line:
            rows = [vectors[b] for b in line]
            mean = sum(rows) / len(rows)
            spread = np.sqrt(sum((r - mean) ** 2 for r in rows) / len(rows))
            pairs = sum((a * b for a, b in zip(rows, rows[1:], strict=False)), np.zeros(quality.DIM)) / max(1, len(rows) - 1)
            x[:] = [*mean, *spread, *pairs, np.sqrt((mean * mean).sum()), np.log(1 + len(rows))]
        a, b, c, d = net["layers"]
        hidden = [max(0.0, sum(z * w for z, w in zip((x - net["shift"]) / net["scale"], a[:, h], strict=True)) + b[h]) for h in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, c, strict=True)) + d[0]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(logit / net["temperature"] + net["offset"], -30, 30)))) < 1e-3
    # Held-out labels have no part in it.
    turned = quality.op4_quality(spark, flipped(spark, sf, tmp_path, "quality", 3, 1)).collect()
    assert {r["doc_id"]: r["score"] for r in turned} == got


def test_toxicity_query_equals_plain_code(spark, sf, tmp_path):
    """Every window compressed anew with both dictionaries, counts and weights put together by hand."""
    import zstandard

    d = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.learned(docs, spark.read.parquet(f"{d}/labels.parquet"), learn)

    def coder(content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=64, dict_size=len(content), write_checksum=0, write_content_size=0, write_dict_id=0)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    plain, toxic = coder(model["ordinary"]), coder(model["toxic"] + model["ordinary"])
    got = {r["doc_id"]: r["score"] for r in toxicity.op5_toxicity(spark, d).collect()}
    rows = docs.orderBy("doc_id").collect()
    assert set(got) == {r["doc_id"] for r in rows}
    for r in rows[::10]:
        far = []
        for w in (r["text"] or "").encode().translate(toxicity.FOLD).split():
            own = b"<^" + w + b">$<^" + w + b">$<^"
            far.append(len(plain.compress(own)) - len(toxic.compress(own)))
        over = sum(max(0, x - model["thresholds"][0] + 1) for x in far)
        x = [1.0, *(np.log(1 + sum(f >= t for f in far)) for t in model["thresholds"]), np.sqrt(over / (len(far) + 20)), np.log(1 + over)]
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-sum(a * b for a, b in zip(x, model["weights"], strict=True))))) < 1e-6
    turned = toxicity.op5_toxicity(spark, flipped(spark, d, tmp_path, "toxic", 5, 0)).collect()
    assert {r["doc_id"]: r["score"] for r in turned} == got
    assert sorted(model["thresholds"]) == list(model["thresholds"]) and len(set(model["thresholds"])) == toxicity.N_THRESHOLDS


def test_long_texts_pool_like_short_ones(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(50, quality.DIM)).astype(np.float32)
    tokens = rng.integers(0, 50, 1000).astype(np.uint16)
    whole = quality.pooled(vectors, tokens)
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert np.allclose(quality.pooled(vectors, tokens), whole, atol=1e-5)
