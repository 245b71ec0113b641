"""Quantisation tables: quality, composite fingerprints, attribution to known encoders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The example tables of the JPEG standard (ITU-T T.81, annex K), in natural order.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
# Weights of the signals (luminance, chrominance, segments, subsampling, Huffman, frame), limits.
WEIGHTS = (0.45, 0.15, 0.15, 0.10, 0.10, 0.05)
SIMILAR, MARGIN, STEEPNESS, UNKNOWN = 0.75, 0.02, 1.5, 0.5
#: Corpus entries that go along at a time.
BLOCK_ENTRIES = 10_000
CORPUS_SCHEMA = "entry_id string, device_model string, encoder_software string, processing_chain string, category string, subsampling string, dqt_luminance array<int>, dqt_chrominance array<int>, segment_prefix array<string>, dht_type string, sof_type string, known_collisions array<string>, confidence string"


def base_table(chroma: bool = False) -> list[int]:
    return list(CHROMINANCE if chroma else LUMINANCE)


def scaled_table(quality: int, chroma: bool = False) -> list[int]:
    """The standard's table at a quality from 1 to 100, by the scaling that encoders commonly use."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [max(1, min(255, (x * scale + 50) // 100)) for x in base_table(chroma)]


def estimated_quality(values: Column, chroma: Column) -> Column:
    """Quality of a table from the mean ratio of entries 1 to 32 to the standard's; 50 for short or empty tables."""
    line = lambda c: F.array(*[F.lit(x) for x in base_table(c)[1:33]])
    base = F.when(chroma, line(True)).otherwise(line(False))
    ratios = F.filter(F.zip_with(F.slice(values, 2, 32), base, lambda v, b: F.when(v > 0, v / b)), lambda r: r.isNotNull())
    mean = F.aggregate(ratios, F.lit(0.0), lambda s, r: s + r) / F.size(ratios)
    quality = F.round(F.when(mean > 1.0, 50.0 / mean).otherwise(100.0 - 50.0 * mean), 0).cast("int")
    return F.when((F.size(values) < 64) | (F.size(ratios) == 0), 50).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), quality)))


def composite_hash(form: Column, dqt: Column, dht: Column, subsampling: Column, segments: Column, restart: Column) -> Column:
    """Hash of a canonical line; ``dqt`` and ``dht`` are arrays of struct(key, hash), put in order of the key."""
    joined = lambda tables: F.array_join(F.transform(F.array_sort(tables), lambda t: t["hash"]), ",")
    parts = (("FMT:", form), ("|DQT:", joined(dqt)), ("|DHT:", joined(dht)), ("|SUB:", F.coalesce(subsampling, F.lit("None"))), ("|SEG:", F.array_join(segments, ",")), ("|DRI:", F.coalesce(restart.cast("string"), F.lit("0"))))
    return F.sha2(F.concat(*[x for name, value in parts for x in (F.lit(name), value)]), 256)


def table_similarity(a: Column, b: Column) -> Column:
    """1 for equal tables, else exp(-1.5 * mean distance of logarithms); 0 for short ones."""
    logs = lambda t: F.transform(F.slice(t, 1, 64), lambda v: F.log(F.greatest(F.lit(1), v).cast("double")))
    mean = F.aggregate(F.zip_with(logs(a), logs(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 64.0
    return F.when((F.size(a) < 64) | (F.size(b) < 64), 0.0).when(F.slice(a, 1, 64) == F.slice(b, 1, 64), 1.0).otherwise(F.exp(-STEEPNESS * mean))


def segment_score(file: Column, prefix: Column) -> Column:
    """The share of the shorter list that agrees from its start."""
    n = F.least(F.size(file), F.size(prefix))
    same = F.zip_with(F.slice(file, F.lit(1), n), F.slice(prefix, F.lit(1), n), lambda a, b: a == b)
    first = F.array_position(same, False)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, UNKNOWN).otherwise(F.when(first == 0, n).otherwise(first - 1) / n)


def candidates(prints: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each fingerprint's score against each corpus entry, in order: the corpus is the stated set of answers.

    ``prints`` has print_id, lum, chrom, segments, subsampling, optimized (Huffman tables), sof. Entries are counted, and
    go along in blocks of at most about BLOCK_ENTRIES (a few hundred bytes each), one array a block.
    """
    blocks = -(-corpus.count() // BLOCK_ENTRIES)
    number = F.pmod(F.xxhash64("entry_id"), F.lit(max(1, blocks)))
    parts = [_scored(prints, corpus.where(number == k)) for k in range(max(1, blocks))]
    return reduce(DataFrame.unionByName, parts)


def _scored(prints: DataFrame, corpus: DataFrame) -> DataFrame:
    every = corpus.agg(F.collect_list(F.struct(*corpus.columns)).alias("_all"))  # one row of a block's size
    rows = prints.join(F.broadcast(every)).select(*prints.columns, F.explode("_all").alias("e"))
    e = F.col("e")
    same = lambda a, b: F.when(a.isNull() | b.isNull(), UNKNOWN).when(a == b, 1.0).otherwise(0.0)
    parts = (
        table_similarity(F.col("lum"), e["dqt_luminance"]),
        F.when(F.coalesce(F.size("chrom"), F.lit(0)) <= 0, UNKNOWN).when(F.coalesce(F.size(e["dqt_chrominance"]), F.lit(0)) <= 0, UNKNOWN).otherwise(table_similarity(F.col("chrom"), e["dqt_chrominance"])),
        segment_score(F.col("segments"), e["segment_prefix"]),
        same(F.col("subsampling"), e["subsampling"]),
        same(F.col("optimized"), e["dht_type"] == "optimized"),
        same(F.col("sof"), e["sof_type"]),
    )
    score = sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:], strict=True)), WEIGHTS[0] * parts[0])
    return rows.select("print_id", e["entry_id"].alias("entry_id"), e["category"].alias("category"), e["device_model"].alias("device_model"), score.alias("score"))


def attribution(scored: DataFrame) -> DataFrame:
    """(print_id, outcome, entry_id, category, score, n_candidates, categories): the best entry, others within the margin."""
    best = Window.partitionBy("print_id")
    rows = scored.withColumn("_best", F.max("score").over(best))
    near = (F.col("score") >= F.col("_best") - MARGIN) & (F.col("score") >= SIMILAR)
    out = rows.groupBy("print_id").agg(
        F.max("_best").alias("_s"),
        F.min_by(F.struct("entry_id", "category"), F.struct(-F.col("score"), F.col("entry_id"))).alias("_e"),
        F.sum(F.when(near, 1).otherwise(0)).alias("n_candidates"),
        F.array_sort(F.collect_set(F.when(near, F.col("category")))).alias("categories"),
    )
    outcome = F.when(F.col("_s") < SIMILAR, "INSUFFICIENT").when(F.col("n_candidates") > 1, "AMBIGUOUS").otherwise("INDICATIVE")
    return out.select("print_id", outcome.alias("outcome"), "_e.entry_id", "_e.category", F.round("_s", 3).alias("score"), "n_candidates", "categories")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a corpus in JSON; those without 64 luminance values from 1 to 255 and the required names are left out."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    signal = lambda c: F.get_json_object(F.to_json(get("disambiguation_signals")), f"$.{c}") if "disambiguation_signals" in rows.columns else F.lit(None).cast("string")
    out = rows.select(
        get("id").alias("entry_id"), *[get(c).alias(c) for c in ("device_model", "encoder_software", "processing_chain", "category", "subsampling")],
        get("dqt_luminance_sample").cast("array<int>").alias("dqt_luminance"), get("dqt_chrominance_sample").cast("array<int>").alias("dqt_chrominance"),
        get("segment_prefix").cast("array<string>").alias("segment_prefix"), signal("dht_type").alias("dht_type"), signal("sof_type").alias("sof_type"),
        get("known_collisions").cast("array<string>").alias("known_collisions"), get("confidence").alias("confidence"),
    )
    sound = (F.size("dqt_luminance") == 64) & F.forall("dqt_luminance", lambda v: v.between(1, 255))
    return out.where(sound & F.col("entry_id").isNotNull() & F.col("device_model").isNotNull() & F.col("category").isNotNull())


def learned(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """The corpus with new entries in place of those that share their ids; of a new entry's segments the first six count."""
    own = new.withColumn("segment_prefix", F.slice("segment_prefix", 1, 6))
    return corpus.join(own.select("entry_id").distinct(), "entry_id", "left_anti").unionByName(own)


def entry(corpus: DataFrame, entry_id: str) -> DataFrame:
    return corpus.where(F.col("entry_id") == entry_id)


def entries_of(corpus: DataFrame, category: str) -> DataFrame:
    """Entries of a category, by id."""
    return corpus.where(F.col("category") == category).orderBy("entry_id")
