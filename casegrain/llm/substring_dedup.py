"""Substring deduplication by hashing units of text.

Units are lines, paragraphs (parted by lines without a word), or pieces of lines: lines cut at the ends of sentences, and sentences of more than
LONG words also after each word whose SHA-256 begins with 0 or 1, so that passages that begin and end inside of a long
sentence share units too. Units are normalised (lower case, single spaces) and digested; of each digest the earliest
occurrence by (doc_id, null last; hash of the text; row; place) is kept. Every later one is removed, with its offsets in
the original text; removed units next to each other are one span. ``min_words`` leaves alone spans that are shorter.

Digests are counted before the shuffle brings them together, so a line that all documents have is a number per
task; the join that marks occurrences is one whose skewed partitions Spark divides.

Defined results: null and empty texts have no units; of rows equal in id and text the first keeps its units like
any other row, the others (``repeat``) lose all; repetition within a document counts like any other; an empty table
gives an empty result; white space is ASCII's; of extra columns ``deduplicated`` keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrain.llm.common import written

#: Least words of a span for the query: single lines that many documents have by chance stay there.
QUERY_WORDS = 20
#: Words of a sentence from which on it is cut inside; words whose cut is remembered.
LONG, MEMO = 24, 300_000
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\x0b-\r]*(?:\n[ \t\x0b-\r]*)+"), "piece": re.compile(r"[.!?]+(?=\s)|\n", re.ASCII)}
WORD = re.compile(r"[^ \t-\r]+")
SPAN = "array<struct<start:int,end:int>>"
_cuts: dict[str, bool] = {}


def _cut_after(word: str) -> bool:
    cut = _cuts.get(word)
    if cut is None:
        if len(_cuts) >= MEMO:
            _cuts.clear()
        cut = _cuts[word] = sha256(word.encode("utf-8", "replace")).digest()[0] < 32
    return cut


def units_of(text: str | None, unit: str = "line") -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of each unit, in code points, without the spaces around it."""
    at = 0
    for end in [m.end() for m in BREAKS[unit].finditer(text)] + [len(text)] if text else ():
        words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text, at, end)]
        at = end
        cuts = [k for k, w in enumerate(words[:-1], 1) if _cut_after(w[2])] if unit == "piece" and len(words) > LONG else []
        for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True):
            if a < b:
                yield words[a][0], words[b - 1][1], b - a, " ".join(w for _, _, w in words[a:b])


def occurrences(docs: DataFrame, unit: str = "line") -> DataFrame:
    """(doc_id, text_hash, row, place, start, length, words, high, low): a row for each unit, its digest in 96 bits.

    ``row`` numbers the rows of ``docs`` as long as this table is not computed again, so it must be written.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "row", "place", "start", "length", "words", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for k, text in enumerate(batch.column(3)):
                before = len(out)
                for place, (a, b, words, norm) in enumerate(units_of(text.as_py(), unit)):
                    d = xxhash.xxh3_128_intdigest(norm.encode("utf-8", "replace"))
                    out.append((place, a, b - a, words, d >> 64, d & 0xFFFFFFFF))
                counts.append(len(out) - before)
                if len(out) >= 50_000 or k == batch.num_rows - 1:
                    at = pa.array(np.repeat(np.arange(k + 1 - len(counts), k + 1), counts), pa.int64())
                    cols = list(zip(*out, strict=True)) if out else [()] * 6
                    high, low = np.array(cols[4], np.uint64).view(np.int64), np.array(cols[5], np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(high), pa.array(low)], names=names)
                    counts, out = [], []

    return rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, row long, place int, start int, length int, words int, high long, low int")


def removals(docs: DataFrame, unit: str = "line", min_words: int = 0) -> DataFrame:
    """A row for each span to remove: doc_id, text_hash, repeat, start, end, n_words, n_units, kept_doc_ids (the documents that
    keep its units) and kept_doc_id (that which keeps most of its words, the least on ties, null last).
    """
    units = written(occurrences(docs, unit), "units")
    # What has units, and which rows are equal to an earlier one.
    rows = units.where("place = 0").select("row", "doc_id", "text_hash")
    alike = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.min("row").alias("_row"), F.count("*").alias("_n")).where("_n > 1")
    alike = written(alike, "alike")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row", "place")
    # Each task sends a row for a digest. A table of its own, so that the join's both sides come from exchanges and hot digests can be divided.
    firsts = units.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("high").alias("_high"), F.col("low").alias("_low"), F.col("first.row").alias("_row"), F.col("first.place").alias("_place"), F.col("first.doc_id").alias("kept"))
    firsts = written(firsts, "firsts")
    slim = units.select("row", "place", "start", "length", "words", "high", "low")
    later = slim.join(firsts, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low"))).where((F.col("row") != F.col("_row")) | (F.col("place") != F.col("_place")))
    own = Window.partitionBy("row").orderBy("place")
    runs = later.select("row", "place", "start", "length", "words", "kept").withColumn("run", F.col("place") - F.row_number().over(own))
    parts = runs.groupBy("row", "run", "kept").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.sum("words").alias("words"), F.count("*").alias("units"))
    # Most words first, then the least id, null last.
    by = F.struct((-F.col("words")).alias("w"), F.col("kept").isNull().alias("none"), "kept")
    spans = parts.groupBy("row", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").alias("n_words"),
        F.sum("units").alias("n_units"),
        F.min(by)["kept"].alias("kept_doc_id"),
        F.sort_array(F.collect_set("kept")).alias("kept_doc_ids"),
    )
    spans = spans.where(F.col("n_words") >= min_words).drop("run").join(rows, "row")
    if alike.isEmpty():
        return spans.withColumn("repeat", F.lit(False)).drop("row")
    spans = spans.join(alike, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return spans.withColumn("repeat", F.coalesce(F.col("row") != F.col("_row"), F.lit(False))).drop("row", "_row", "_id", "_hash", "_n")


def deduplicated(docs: DataFrame, unit: str = "line", min_words: int = 0) -> DataFrame:
    """``docs`` with the removed spans cut out of ``text``, and ``removed``: the spans, with offsets in the old text."""
    spans = written(removals(docs, unit, min_words).select("doc_id", "text_hash", "repeat", "start", "end").distinct(), "spans")
    spans = spans.groupBy("doc_id", "text_hash", "repeat").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "repeat": "_repeat"})
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_h"))
    same = (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    alike = rows.where(F.col("text").isNotNull()).groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash")).agg(F.count("*").alias("_n")).where("_n > 1")
    alike = written(alike, "alike")
    first = rows.withColumn("_again", F.lit(False))
    if not alike.isEmpty():  # rows equal in id and text, counted by all they hold: one of the least is the first
        kinds = rows.join(alike, same).groupBy("doc_id", "_h", F.xxhash64(F.to_json("_row")).alias("_k")).agg(F.first("_row").alias("_row"), F.first("text").alias("text"), F.count("*").alias("_n"))
        kinds = written(kinds, "kinds")
        least = kinds.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash")).agg(F.min("_k").alias("_least"))
        each = kinds.join(least, same).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        each = each.select("_row", "doc_id", "text", "_h", ((F.col("_k") != F.col("_least")) | (F.col("_i") > 1)).alias("_again"))
        first = first.join(alike, same, "left_anti").unionByName(each)
    out = first.join(spans, same & (F.col("_again") == F.col("_repeat")), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["end"]))
    ends = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length("text")))
    cut = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)
    names = docs.columns
    return out.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names if c != "removed"], F.coalesce(F.col("_spans").cast(SPAN), F.array().cast(SPAN)).alias("removed"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = F.array_join(F.transform("kept_doc_ids", lambda i: i.cast("string")), ",")
    return removals(docs, "piece", QUERY_WORDS).select("doc_id", "start", "end", "n_words", "n_units", "kept_doc_id", ids.alias("kept_doc_ids"))
