"""Toxicity by compression distance between two zstandard dictionaries.

Texts are normalised to lower-case words of letters. A window is one word with marks at its ends, WINDOW_REPEATS
times over, so that a whole word found in a dictionary outweighs the fixed cost of a compressed block. One dictionary is trained on windows of
ordinary texts, one on windows of toxic texts: those with letter sequences that toxic texts have far more
often than ordinary ones. A window's distance is the bytes it takes with the ordinary dictionary less those it
takes with the toxic dictionary in front of it: what the toxic text knows and the ordinary doesn't. Windows count
by the thresholds they reach; which thresholds, and how counts and bytes make a probability, is calibrated on labelled texts
that no dictionary saw. The README says what running-text windows and unfiltered dictionaries give, and why these are used.

Bounds of the fit (it runs on the driver): LEARN_ROWS labelled rows of each class and LEARN_BYTES of their
text; of an ordinary text, ORDINARY_WORDS words, evenly spread, go to the ordinary dictionary's samples. Scoring covers every whole text; a worker holds both dictionaries and a bounded memo of windows.

Defined results: null and empty texts have no windows and get the score of a text without counted windows; without
labels of both classes every score is the share of toxic labels (0 without any); repeated rows are each
scored; an empty table gives an empty result; of extra columns all stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.common import crc_of_id, learning_rows

LEARN_ROWS, LEARN_BYTES = 4000, 12 << 20
WINDOW_REPEATS, LEVEL = 2, 19
TOXIC_BYTES, ORDINARY_BYTES = 16 << 10, 32 << 10
#: Letter sequences (bytes), toxic texts that must have one, how often a text's count at most, how many times more often toxic texts have it.
GRAM, LEAST_TEXTS, MOST_TIMES, ODDS = 6, 4, 10, 10.0
#: Words of an ordinary text that its dictionary is trained on, to 2 * this.
ORDINARY_WORDS = 40
#: Bytes of distance from which on a window may count, and how many such thresholds are chosen of them.
LEAST_BYTES, MOST_BYTES, N_THRESHOLDS = 1, 8, 3
MEMO = 300_000
#: Lower-cases A-Z, makes a space of every other ASCII byte that isn't a letter; bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def window(word: bytes) -> bytes:
    return b"<^" + (word + b">$<^") * WINDOW_REPEATS


def _grams(text: bytes) -> np.ndarray:
    own = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(own) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = out << np.uint64(8) | own[k : k + n]
    return out


def _contrast(texts: list[list[bytes]], toxic: np.ndarray) -> np.ndarray:
    """Letter sequences (word ends count as letters) that toxic texts have far more often, for their length."""
    lines = [b" " + b" ".join(t) + b" " for t in texts]
    length = {y: 1 + sum(max(0, len(t) - GRAM + 1) for t, label in zip(lines, toxic, strict=True) if label == y) for y in (True, False)}
    own = [np.unique(_grams(t), return_counts=True) for t, label in zip(lines, toxic, strict=True) if label]
    seq, at, texts_with = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True, return_counts=True)
    times = np.bincount(at, weights=np.minimum(np.concatenate([n for _, n in own]), MOST_TIMES), minlength=len(seq))
    seq, times = seq[texts_with >= LEAST_TEXTS], times[texts_with >= LEAST_TEXTS]
    if not len(seq):
        return seq
    ordinary = np.zeros(len(seq))
    for t, label in zip(lines, toxic, strict=True):
        if not label:
            grams = _grams(t)
            at = np.minimum(np.searchsorted(seq, grams), len(seq) - 1)
            ordinary += np.minimum(np.bincount(at[seq[at] == grams], minlength=len(seq)), MOST_TIMES)
    return seq[times / length[True] / ((ordinary + 0.5) / length[False]) > ODDS]


def _dictionary(words: list[bytes], size: int) -> bytes:
    """Trained on the words' windows; of too few to train on, the windows themselves, the most frequent last."""
    try:
        return zstandard.train_dictionary(size, [window(w) for w in words], k=48, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(window(w) for w, _ in Counter(words).most_common(size // 64)[::-1])[-size:]


class Distance:
    """Bytes saved by the toxic dictionary on a word's window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.memo: dict[bytes, int] = {}
        self.coders = []
        for content in (ordinary, toxic + ordinary):
            # Raw content, so that only matches tell the two apart.
            if len(content) < 8:
                content += b" " * 8
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_checksum=0, write_content_size=0, write_dict_id=0)
            held.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, (plain, toxic) = self.memo, self.coders
        out = []
        for w in words:
            d = memo.get(w)
            if d is None:
                own = window(w)
                d = len(plain(own)) - len(toxic(own))
                if len(memo) >= MEMO:
                    memo.clear()
                if len(w) <= 64:
                    memo[w] = d
            out.append(d)
        return np.array(out, np.int32)


def _features(distances: np.ndarray, thresholds: tuple[int, ...]) -> list[float]:
    over = float(np.maximum(distances - thresholds[0] + 1, 0).sum())
    return [1.0, *(np.log1p((distances >= t).sum()) for t in thresholds), np.sqrt(over / (len(distances) + 20)), np.log1p(over)]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method with a slight ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), grad)
    return w


def _calibrated(distances: list[np.ndarray], y: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
    """The thresholds of least logistic loss, and the weights that go with them."""

    def fit(thresholds: tuple[int, ...]) -> tuple[float, np.ndarray]:
        x = np.array([_features(d, thresholds) for d in distances])
        w = _logistic(x, y)
        return float(np.logaddexp(0, np.where(y > 0, -(x @ w), x @ w)).mean()), w

    # One threshold after the other, each the best beside those before it.
    chosen: tuple[int, ...] = ()
    for _ in range(N_THRESHOLDS):
        tried = [tuple(sorted((*chosen, t))) for t in range(LEAST_BYTES, MOST_BYTES + 1) if t not in chosen]
        chosen = min(tried, key=lambda t: (fit(t)[0], t))
    return chosen, fit(chosen)[1]


def fitted(texts: list[bytes], toxic: list[int], share: float | None = None) -> dict:
    """The model: both dictionaries, and the weights of a text's counts.

    ``share`` is the toxic share of all labelled rows, where the sample's is another.
    """
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        return {"toxic": b"", "ordinary": b"", "weights": None, "share": float(y.mean()) if len(y) else 0.0}
    words = [words_of(t) for t in texts]
    rest = np.arange(len(words)) % 3 == 2  # for calibration
    if not (y[rest].any() and y[~rest].any() and (~y[rest]).any() and (~y[~rest]).any()):
        rest[:] = False
    held = rest if rest.any() else ~rest
    marked = _contrast([w for w, r in zip(words, rest, strict=True) if not r], y[~rest])
    known: dict[bytes, bool] = {}

    def is_marked(w: bytes) -> bool:
        if w not in known:
            known[w] = bool(np.isin(_grams(b" " + w + b" "), marked).any())
        return known[w]

    samples = {True: [], False: []}
    for own, label in zip((w for w, r in zip(words, rest, strict=True) if not r), y[~rest], strict=True):
        samples[bool(label)] += [w for w in own if is_marked(w)] if label else own[:: max(1, len(own) // ORDINARY_WORDS)]
    model = {"toxic": _dictionary(samples[True], TOXIC_BYTES), "ordinary": _dictionary(samples[False], ORDINARY_BYTES)}
    distance = Distance(model["toxic"], model["ordinary"])
    thresholds, weights = _calibrated([distance(w) for w, h in zip(words, held, strict=True) if h], y[held].astype(float))
    own = y[held].mean()
    if share and 0 < share < 1:
        weights[0] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return model | {"weights": weights, "thresholds": thresholds, "share": float(y.mean())}


@lru_cache(4)
def _distance(toxic: bytes, ordinary: bytes) -> Distance:
    return Distance(toxic, ordinary)


def scores(model: dict, texts: list[bytes | None]) -> np.ndarray:
    if model["weights"] is None:
        return np.full(len(texts), model["share"])
    distance = _distance(model["toxic"], model["ordinary"])
    x = np.array([_features(distance(words_of(t)), model["thresholds"]) for t in texts]).reshape(-1, 3 + N_THRESHOLDS)
    return 1 / (1 + np.exp(-np.clip(x @ model["weights"], -30, 30)))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> dict:
    """The model of the labelled rows that ``learn`` (a condition on labels) admits."""
    spark = docs.sparkSession
    rows = learning_rows(labels, label, learn, LEARN_ROWS)
    slim = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # 2 * LEARN_ROWS ids
    lengths = sorted(slim.select(F.xxhash64("doc_id"), "doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect())
    room, ids = {0: LEARN_BYTES * 2 // 3, 1: LEARN_BYTES // 3}, []
    for _, i, y, n in lengths:
        if n <= room[y]:
            room[y] -= n
            ids.append((i,))
    if not ids:
        return fitted([], [])
    chosen = spark.createDataFrame(ids, rows.select("doc_id").schema).distinct()
    texts = sorted((r["h"], r["doc_id"], r["text"] or "", r["y"]) for r in slim.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "y").collect())
    counts = {bool(r[0]): r[1] for r in labels.where(F.col(label).isin(0, 1) & learn).groupBy(label).count().collect()}
    return fitted([t.encode() for _, _, t, _ in texts], [y for *_, y in texts], counts.get(True, 0) / max(1, sum(counts.values())))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(shared.value, batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, rows.drop("text").withColumn("score", F.lit(0.0)).schema)


def detoxified(docs: DataFrame, labels: DataFrame, learn: Column | None = None, limit: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``limit`` or more."""
    model = learned(docs, labels, F.lit(True) if learn is None else learn)
    return scored(docs, model).where(F.col("score") < limit).select("row.*")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_of_id() % 5 == 0
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    rows = docs.select("doc_id", "text")
    out = scored(rows, model).select("row.doc_id", "score")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
