"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items, lower-cased (A-Z) and cut into words, go into one automaton per block of at most
BLOCK_WORDS words. The words of each document run through it; the length of the longest match that ends at a
word says whether the last ``window`` words are a window of some item, or the whole of a shorter item. All words inside any
occurrence are hit. Runs of hit words are the spans to remove; a document of which at least
``max_coverage`` is hit goes altogether.

Memory: a Python worker holds one automaton of a block and one Arrow batch. A larger benchmark takes
more blocks; then one pass over all texts looks up the hashes of their windows first (8 bytes a window of the benchmark, in each
worker), and only texts that have one go through the blocks' automata, in narrow passes. Nothing is shuffled.

Defined results: null and empty texts have no words; an item without words (or null) has no window; items
sharing an id count as one; an item whose id is null marks words but has no id to list; repeated rows are
each reported; empty tables give an empty result, or no hits; of extra columns all stay, except those
named like the added ones, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.llm.common import written


WINDOW, BLOCK_WORDS, MAX_COVERAGE = 10, 200_000, 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lower-cases A-Z and makes a space of every byte that is in no word; bytes from 0x80 are inside words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ADDED = ("n_words", "spans", "item_ids")
SPAN = "array<struct<first:int,last:int,start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """States are right-equivalence classes of the items' word sequences; ``items`` are (id or None, words)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for i, words in items if words]
        self.shortest = min((min(len(w), window) for _, w in coded), default=window)
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.ids: list[set] = [set() for _ in self.next]  # of items with this state's window
        self.whole: list[list[tuple[int, str | None]]] = [[] for _ in self.next]  # short items that end here
        for i, words in coded:
            at = 0
            for k, w in enumerate(words):
                at = self.next[at][w]
                if k + 1 >= window:
                    self.ids[self.state_of_window(at)].add(i)
            if len(words) < window and (len(words), i) not in self.whole[at]:
                self.whole[at].append((len(words), i))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.up = [-1] * len(self.next)  # nearest state on the suffix path, itself included, where short items end
        self.anchor = [-1] * len(self.next)
        for v in order:
            self.up[v] = v if self.whole[v] else (self.up[self.link[v]] if v else -1)
            if self.length[v] >= window:
                self.anchor[v] = v if self.length[self.link[v]] < window else self.anchor[self.link[v]]

    def state_of_window(self, v: int) -> int:
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # another item began so
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        v, p = self._add(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[v] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return v

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Occurrences as (first word, word after the last), and the ids of the items they are from."""
        get, n = self.vocab.get, len(words)
        if n < self.shortest:
            return [], set()
        codes = np.fromiter((get(w, -1) for w in words), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False]))))
        found, ids = [], set()
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin < self.shortest:  # matches have words of the items only
                continue
            v = length = 0
            for k, w in enumerate(codes[begin:end].tolist(), begin + 1):
                while v and w not in self.next[v]:
                    v = self.link[v]
                    length = self.length[v]
                if w in self.next[v]:
                    v, length = self.next[v][w], length + 1
                if length >= self.window:
                    found.append((k - self.window, k))
                    ids |= self.ids[self.anchor[v]]
                u = self.up[v]
                while u >= 0:
                    for m, i in self.whole[u]:
                        if m <= length:
                            found.append((k - m, k))
                            ids.add(i)
                    u = self.up[self.link[u]] if u else -1
        return found, ids


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(2)
def _automaton(block: tuple, window: int) -> Automaton:
    """One for each Python worker and block."""
    return Automaton([(i, list(words)) for i, words in block], window)


def _blocks(items: DataFrame) -> list[tuple]:
    """The items in blocks of at most BLOCK_WORDS words; an item goes whole into one.

    The benchmark is the stated set of queries; it streams through the driver a partition at a time.
    """
    out, size = [[]], 0
    for i, text in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = tuple(words_of(text.encode() if text else b""))
        if out[-1] and size + len(words) > BLOCK_WORDS:
            out.append([])
            size = 0
        if words:
            out[-1].append((i, words))
            size += len(words)
    return [tuple(b) for b in out]


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, spans (words first to last - 1, code points start to end - 1) and item_ids."""
    spark = docs.sparkSession
    base = docs.drop(*ADDED)
    blocks = _blocks(items)
    if len(blocks) > 1:
        flagged = _flagged(base, spark.sparkContext.broadcast(_windows(blocks, window)))
        some = written(flagged.where(F.col(NEAR)).drop(NEAR), "near")
        none = flagged.where(~F.col(NEAR)).drop(NEAR)
        empty = {"spans": F.array().cast(SPAN), "item_ids": F.array().cast("array<string>")}
        return _scanned(some, blocks, window).unionByName(none.withColumns(empty))
    return _scanned(base, blocks, window)


#: Marks texts that have the hash of a window.
NEAR = "_near_benchmark"


def _hashes(words: list[bytes], m: int) -> np.ndarray:
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, len(words) - m + 1
    return np.fromiter((digest(join(words[k : k + m])) for k in range(n)), np.uint64, n) if n > 0 else np.zeros(0, np.uint64)


def _windows(blocks: list[tuple], window: int) -> dict[int, np.ndarray]:
    """Sorted hashes of all windows of the items, by their number of words."""
    out: dict[int, list[np.ndarray]] = {}
    for block in blocks:
        for _, words in block:
            m = min(len(words), window)
            out.setdefault(m, []).append(_hashes(list(words), m))
    return {m: np.unique(np.concatenate(own)) for m, own in out.items()}


def _flagged(rows: DataFrame, shared) -> DataFrame:
    """``rows`` with n_words and NEAR."""
    schema = rows.withColumns({"n_words": F.lit(0).cast("long"), NEAR: F.lit(True)}).schema
    at_text = schema.names.index("text")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            counts, near = [], []
            for text in batch.column(at_text).cast(pa.binary()):
                words = words_of(text.as_py())
                counts.append(len(words))
                near.append(any(bool(np.isin(_hashes(words, m), own).any()) for m, own in known.items()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(near, pa.bool_())], names=schema.names)

    return rows.mapInArrow(flag, schema)


def _scanned(base: DataFrame, blocks: list[tuple], window: int) -> DataFrame:
    """A narrow pass for each block, which carries the spans found so far."""
    spark = base.sparkSession
    out = base.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPAN), "item_ids": F.lit(None).cast("array<string>")})
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_scanner(shared, window, out.schema), out.schema)
    return out


def _scanner(shared, window: int, schema: T.StructType):
    names = schema.names
    at_text = names.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared.value, window)
        for batch in batches:
            texts = batch.column(at_text).cast(pa.binary()).to_pylist()
            counts, spans, ids = [], [], []
            for text, had, known in zip(texts, batch.column(names.index("spans")).to_pylist(), batch.column(names.index("item_ids")).to_pylist(), strict=True):
                words = words_of(text)
                counts.append(len(words))
                found, items = machine.scan(words)
                found += [(s["first"], s["last"]) for s in had or ()]
                spans.append(_located(text, merged(found)) if found else [])
                ids.append(sorted({i for i in items if i is not None} | set(known or ())))
            columns = list(batch.columns)
            columns[names.index("n_words")] = pa.array(counts, pa.int64())
            columns[names.index("spans")] = pa.array(spans, batch.schema.field("spans").type)
            columns[names.index("item_ids")] = pa.array(ids, batch.schema.field("item_ids").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return scan


def _located(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words with their code points; the text is decoded once, a piece at a time."""
    ends = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, byte, point = [], 0, 0
    for a, b in spans:
        places = []
        for at in (ends[a][0], ends[b - 1][1]):
            point += len(text[byte:at].decode("utf-8", "replace"))
            byte = at
            places.append(point)
        out.append({"first": a, "last": b, "start": places[0], "end": places[1]})
    return out


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without the spans that occur in the benchmark, and without documents hit on ``max_coverage`` of their words.

    The text is cut at the spans, and ``n_chars``, if there, is counted anew.
    """
    names = docs.columns
    rows = docs.select(F.struct("*").alias("_row"), "text")
    found = matched(rows, items, window)
    kept = found.where((F.size("spans") == 0) | (hit_words() < max_coverage * F.col("n_words")))
    # What lies before each span, and after the last one.
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    text = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    kept = kept.select("_row", text.alias("_text"), (F.size("spans") > 0).alias("_cut"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_cut"), F.length("_text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in names else None}
    return kept.select(*[new[c].alias(c) if new.get(c) is not None else F.col("_row")[c].alias(c) for c in names])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
