"""Quality by random indexing and a two-layer network.

Tokens are runs of letters and digits (case kept) and runs of other visible characters, hashed to BUCKETS. Each bucket
has a fixed sparse ternary index vector; over all documents, a bucket's context vector sums the index vectors
of the tokens up to REACH places away. Sums are integers, so they don't depend on the order of work. The word
vectors (context vectors centred, scaled to length 1) are pooled per document: mean, spread, and the product of each
token's vector with the next one's. A network of two layers, in numpy, turns that into a logit, and a temperature
fitted on documents that the network did not see makes it a probability.

Word vectors grow out of the whole corpus; their table has a fixed size (BUCKETS rows of DIM numbers, 4 MB), and is what
is broadcast. The network is fitted on the driver on at most LEARN_ROWS labelled rows of each class.

Defined results: null and empty texts pool to zeros and are scored; without labels of both classes every score is
the share of label 1 (0.5 without any); repeated rows are each scored; an empty table gives an empty result; of
extra columns all stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.common import crc_of_id, learning_rows

BUCKETS, DIM, NONZERO, REACH = 1 << 15, 32, 4, 2
LEARN_ROWS = 6000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-3
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")
#: Tokens that are summed at a time, and tokens whose bucket a worker remembers.
CHUNK, MEMO = 1 << 16, 300_000
FEATURES = 3 * DIM + 2


class Tokens:
    """Buckets of a text's tokens; bucket 0 is kept for the gaps between texts."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        memo, out = self.memo, []
        for t in TOKEN.findall(text or b""):
            b = memo.get(t)
            if b is None:
                b = zlib.crc32(t) % (BUCKETS - 1) + 1
                if len(memo) >= MEMO:
                    memo.clear()
                if len(t) <= 64:
                    memo[t] = b
            out.append(b)
        return np.array(out, np.uint16)


def index_vectors() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(17))
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += 1 if k % 2 else -1
    out[0] = 0
    return out


def add_contexts(sums: np.ndarray, index: np.ndarray, tokens: np.ndarray, first: int, last: int) -> None:
    """Adds to ``sums`` [bucket, DIM and a count] what is around tokens ``first`` to ``last`` - 1 of a line of texts."""
    at = index[tokens]
    around = np.zeros_like(at)
    for d in range(1, REACH + 1):
        around[d:] += at[:-d]
        around[:-d] += at[d:]
    order = np.argsort(tokens[first:last], kind="stable")
    own, around = tokens[first:last][order], around[first:last][order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sums[own[starts], :DIM] += np.add.reduceat(around, starts, axis=0).astype(np.int64)
    sums[own[starts], DIM] += np.diff(np.append(starts, len(own)))


def summed(texts: Iterator[bytes | None]) -> np.ndarray:
    sums, index, tokens, gap = np.zeros((BUCKETS, DIM + 1), np.int64), index_vectors(), Tokens(), np.zeros(REACH, np.uint16)
    held, size = [gap], 0

    def add() -> None:
        line = np.concatenate(held)
        for k in range(0, len(line), CHUNK):  # pieces see a little beyond their ends
            a, b = max(0, k - REACH), min(len(line), k + CHUNK + REACH)
            add_contexts(sums, index, line[a:b], k - a, min(len(line), k + CHUNK) - a)

    for text in texts:
        held += [tokens(text), gap]
        size += len(held[-2])
        if size >= CHUNK:
            add()
            held, size = [gap], 0
    add()
    sums[0] = 0
    return sums


def context_sums(docs: DataFrame) -> np.ndarray:
    """[bucket, DIM + 1]: context vectors and counts over all documents."""
    names = [f"c{k}" for k in range(DIM + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(t.as_py() for batch in batches for t in batch.column(0).cast(pa.binary()))
        used = np.flatnonzero(sums[:, DIM])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, k]) for k in range(DIM + 1))], names=["bucket", *names])

    parts = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
    out = np.zeros((BUCKETS, DIM + 1))
    for row in parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).collect():  # BUCKETS rows at most
        out[row[0]] = row[1:]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Mean contexts, centred by the mean over all tokens, of length 1; zeros for buckets without tokens."""
    counts = sums[:, DIM:]
    mean = sums[:, :DIM] / np.maximum(counts, 1)
    mean = np.where(counts > 0, mean - sums[:, :DIM].sum(axis=0) / max(1, counts.sum()), 0)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    n = len(tokens)
    if n:
        total, squares, pairs = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
        for k in range(0, n, CHUNK):  # a piece and the token after it
            at = vectors[tokens[k : k + CHUNK + 1]]
            own = at[:CHUNK]
            total += own.sum(axis=0, dtype=np.float64)
            squares += np.square(own).sum(axis=0, dtype=np.float64)
            pairs += (at[1:] * at[:-1]).sum(axis=0, dtype=np.float64)
        mean = total / n
        out[:DIM], out[DIM : 2 * DIM], out[2 * DIM : 3 * DIM] = mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), pairs / max(1, n - 1)
        out[-2], out[-1] = np.linalg.norm(mean), np.log1p(n)
    return out


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """A network of two layers by Adam, and its temperature from a fifth of the rows that it does not see."""
    rest = np.arange(len(x)) % 5 == 4
    if not (y[~rest].min() < y[~rest].max() and rest.any()):
        rest[:] = False
    shift, scale = x[~rest].mean(axis=0), x[~rest].std(axis=0) + 1e-3
    z, t = (x[~rest] - shift) / scale, y[~rest].astype(np.float64)
    rng = np.random.Generator(np.random.PCG64(29))
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for k in range(0, len(z), 128):
            at = order[k : k + 128]
            hidden = np.maximum(z[at] @ p[0] + p[1], 0)
            off = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - t[at]) / len(at)
            back = np.outer(off, p[2]) * (hidden > 0)
            grads = [z[at].T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ off + DECAY * p[2], off.sum(keepdims=True)]
            step += 1
            for a, g, mean, var in zip(p, grads, m, v, strict=True):
                mean += 0.1 * (g - mean)
                var += 0.001 * (g * g - var)
                a -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    net = {"shift": shift, "scale": scale, "layers": p, "temperature": 1.0, "offset": 0.0}
    if rest.any():
        logit = logits(net, x[rest])
        loss = lambda s: np.logaddexp(0, np.where(y[rest] > 0, -logit, logit) / s).mean()
        net["temperature"] = float(min(np.geomspace(0.25, 16, 97), key=loss))
    return net


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    a, b, c, d = net["layers"]
    return np.maximum((x - net["shift"]) / net["scale"] @ a + b, 0) @ c + d


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    if "share" in net:
        return np.full(len(x), net["share"])
    return 1 / (1 + np.exp(-np.clip(logits(net, x) / net["temperature"] + net["offset"], -30, 30)))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> dict:
    """Word vectors of all documents, and the network of the labelled rows that ``learn`` (a condition on labels) admits."""
    vectors = word_vectors(context_sums(docs))
    rows = learning_rows(labels, label, learn, LEARN_ROWS)
    slim = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # 2 * LEARN_ROWS ids
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            x = [pooled(shared.value, tokens(t.as_py())).tobytes() for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["h", "y", "x"])

    seen = sorted((r["h"], r["y"], bytes(r["x"])) for r in slim.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInArrow(run, "h long, y int, x binary").collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in seen]).reshape(-1, FEATURES)
    y = np.array([r[1] for r in seen], np.int64)
    counts = {int(r[0]): r[1] for r in labels.where(F.col(label).isin(0, 1) & learn).groupBy(label).count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(set(y.tolist())) < 2:
        return {"vectors": vectors, "net": {"share": share}}
    net = train(x, y)
    own = y.mean()  # the classes were drawn apart
    net["offset"] = float(np.log(share / (1 - share)) - np.log(own / (1 - own))) if 0 < share < 1 else 0.0
    return {"vectors": vectors, "net": net}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = Tokens(), shared.value
        for batch in batches:
            x = np.array([pooled(held["vectors"], tokens(t.as_py())) for t in batch.column(1).cast(pa.binary())]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(held["net"], x), pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, rows.drop("text").withColumn("score", F.lit(0.0)).schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_of_id() % 3 == 1
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    out = scored(docs, model).select("row.doc_id", "score")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
