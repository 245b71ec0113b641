"""Quality rules, in DataFrame operations only.

Fixed rules look at a text's length and repetition. For the others, hashed n-grams (words and pairs of words, in GRAM_BUCKETS
buckets, or in the next power of two that keeps about MOST_LOAD different n-grams or fewer to a bucket) are counted over a trusted target and over the raw corpus. A text's score is the log-likelihood ratio
of the two multinomials, summed over its n-grams and divided by their number; it is kept at THRESHOLD or
more. The ratio of a bucket is shrunk towards 1 as if SHRINK more of its n-grams had been seen at the usual rate, so that
rare n-grams say little. Counts cover every text; a task counts so many of them (ONE_COUNT) that frequent n-grams are summed before
the shuffle. The table of ratios is broadcast up to MOST_BROADCAST buckets, SLOTS to a row; beyond, n-grams are counted for each text
and joined by a shuffle.

Repeated five-word windows are told by 64-bit hashes of hashed words; all else is exact.

Defined results: null and empty texts have no words and fail the fixed rules; with no trusted text, every ratio is
1 and the fixed rules alone decide; rows equal in id and text get the same verdict; an empty table gives an empty
result; of extra columns ``filtered`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.common import broadcast_if_small, table, written

GRAM_BUCKETS = 1 << 17
#: Different n-grams to a bucket at most (sf0.1 has 21); different n-grams are estimated from one hash in SAMPLE.
MOST_LOAD, SAMPLE = 24, 64
#: Buckets side by side in a row of ratios (about 11 bytes a bucket in memory, a row for each takes 45), buckets that are broadcast.
SLOTS, MOST_BROADCAST = 16, 1 << 23
#: Bytes of text that a task counts.
ONE_COUNT = 1 << 26
#: One white space. A list of single characters is matched by a table.
ONE_SPACE = r"[\x20\x09\x0A\x0B\x0C\x0D]"
SHRINK, THRESHOLD = 20.0, -0.15
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

#: Hashes of words, and of four words (the last three of fewer), which are read faster from an array that isn't a column yet; hashes of windows;
#: windows sorted by hash; places of those equal to a neighbour; the words they cover.
_FOUR = "xxhash64(w, get(wh, i + 1), get(wh, i + 2), get(wh, i + 3))"
_HASHES = f"get(transform(array(transform(_words, w -> xxhash64(w))), wh -> struct(wh as wh, transform(wh, (w, i) -> {_FOUR}) as fours)), 0)"
_WINDOWS = "zip_with(slice(_fours, 1, size(_wh) - 4), slice(_wh, 5, size(_wh) - 4), (f, w) -> xxhash64(f, w))"
_SORTED = "sort_array(transform(_windows, (h, i) -> struct(h, i)))"
_AGAIN = "transform(filter(_sorted, (x, j) -> x.h = get(_sorted, j - 1).h or x.h = get(_sorted, j + 1).h), x -> x.i)"
_COVERED = "aggregate(sort_array(_again), named_struct('n', 0L, 'last', -5), (a, p) -> named_struct('n', a.n + least(5, p - a.last), 'last', p), a -> a.n)"


def parted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_parts``, what lies between any two white spaces of a text, and its words ``_words``, which are those that aren't empty."""
    out = docs.withColumn("_parts", F.split(F.coalesce("text", F.lit("")), ONE_SPACE, -1))
    return out.withColumn("_words", F.when(F.array_contains("_parts", ""), F.array_remove("_parts", "")).otherwise(F.col("_parts")))


def based(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_wh``, the hashes of its words in order, and the columns of BASE."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter("_lines", lambda line: F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = parted(docs).withColumns({
        "word_chars": (F.length(text) - F.size("_parts") + 1).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "_lines": F.split(text, "\n", -1),
    })
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_hashes": F.expr(_HASHES), "_lines": lines})
    out = out.withColumns({"_wh": F.col("_hashes.wh"), "_fours": F.col("_hashes.fours")})
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # A window that comes again has four words that come again at two places.
    out = out.withColumn("_windows", F.expr(f"if(size(_wh) < 6 or size(array_distinct(_fours)) > size(_fours) - 2, null, {_WINDOWS})"))
    out = out.withColumn("_sorted", F.expr(f"if(_windows is null or size(array_distinct(_windows)) = size(_windows), null, {_SORTED})"))
    out = out.withColumn("_again", F.expr(f"if(_sorted is null, null, {_AGAIN})"))
    out = out.withColumn("n_repeat_words", F.expr(f"if(_again is null, 0L, {_COVERED})"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_parts", "_words", "_lines", "_hashes", "_fours", "_windows", "_sorted", "_again")


def gram_hashes(rows: DataFrame, elements: str, *columns: str) -> DataFrame:
    """``columns``, ``_word`` and ``_pair``: a row for each of ``elements``, which are words or hashes of words, with its hash and that of it and the next one.

    ``_pair`` of the last one is null. A row without elements has one row, with nulls.
    """
    hashed = (lambda e: e) if dict(rows.dtypes)[elements] == "array<bigint>" else F.xxhash64
    each = rows.select(*columns, elements, F.posexplode_outer(elements).alias("_at", "_own"))
    own, after = F.col("_own"), F.get(elements, F.col("_at") + 1)
    each = each.select(*columns, own, after.alias("_next"))
    word, pair = hashed(own), F.xxhash64(hashed(own), hashed(F.col("_next")))
    return each.select(*columns, F.when(own.isNotNull(), word).alias("_word"), F.when(F.col("_next").isNotNull(), pair).alias("_pair"))


def bucket_count(docs: DataFrame) -> int:
    """GRAM_BUCKETS, or as many more as the different n-grams of ``docs`` ask for."""
    each = gram_hashes(parted(docs.select("text")), "_words")
    own = each.select(F.explode(F.array("_word", "_pair")).alias("h")).where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(SAMPLE)) == 0)
    different = SAMPLE * own.agg(F.approx_count_distinct("h", 0.02).alias("n")).first()["n"]
    n = GRAM_BUCKETS
    while n * MOST_LOAD < different:
        n *= 2
    return n


def bucket_of(h: str, buckets: int) -> Column:
    return F.pmod(F.col(h), F.lit(buckets)).cast("int")


def exploded(rows: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """``columns`` with the bucket of each word and each pair of words of ``parted`` rows."""
    each = gram_hashes(rows, "_words", *columns)
    return each.select(*columns, F.explode(F.array(bucket_of("_word", buckets), bucket_of("_pair", buckets))).alias("bucket")).where("bucket is not null")


def flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, trusted): whether a row's id is among the ids of ``trusted``."""
    ids = written(trusted.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct(), "trusted_ids")
    out = docs.select("doc_id", "text").join(broadcast_if_small(ids), F.col("doc_id") == F.col("_id"), "left")
    return out.select("text", F.col("_id").isNotNull().cast("int").alias("trusted"))


def gram_ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """(block, ratios): logarithms of target over raw probabilities, those of SLOTS buckets side by side; null for a bucket without n-grams.

    One pass counts both corpora.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = flagged(docs, trusted).coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, size // ONE_COUNT))
    each = exploded(parted(few), buckets, "trusted")
    both = written(each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")), "grams")
    seen = both.agg(F.coalesce(F.sum("target") / F.sum("raw"), F.lit(0.0)).alias("rate")).first()["rate"]
    shrunk = (F.col("target") + SHRINK * seen) / (F.col("raw") + SHRINK) / (seen or 1.0)
    ratios = both.select(block_of("bucket").alias("block"), slot_of("bucket").alias("slot"), (F.log(shrunk) if seen else F.lit(0.0)).alias("ratio"))
    slots = [F.max(F.when(F.col("slot") == k, F.col("ratio"))).alias(f"r{k}") for k in range(SLOTS)]
    rows = ratios.repartition("block").groupBy("block").agg(*slots)
    return written(rows.select("block", F.array(*[f"r{k}" for k in range(SLOTS)]).alias("ratios")), "ratios")


def block_of(bucket: str) -> Column:
    return F.expr(f"cast({bucket} div {SLOTS} as int)")


def slot_of(bucket: str) -> Column:
    return F.pmod(F.col(bucket), F.lit(SLOTS))


def rated(docs: DataFrame, ratios: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text_hash, the columns of BASE, score) for each row of ``docs``.

    The n-grams of a row are looked up and summed in the task that made them, and a row for each text is shuffled; with
    more than MOST_BROADCAST buckets, a row for each bucket of a text.
    """
    rows = based(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")).withColumn("_row", F.monotonically_increasing_id())
    own = ["doc_id", "text_hash", *BASE]
    if buckets > MOST_BROADCAST:
        slim = parted(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["doc_id", "text_hash"]))
        grams = exploded(slim, buckets, "doc_id", "text_hash").groupBy("doc_id", "text_hash", "bucket").agg(F.count("*").alias("n"))
        each = ratios.select("block", F.posexplode("ratios").alias("_slot", "ratio")).select((F.col("block") * SLOTS + F.col("_slot")).alias("bucket"), "ratio")
        sums = grams.join(each, "bucket").groupBy("doc_id", "text_hash").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))
        sums = written(sums.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "scores")
        out = rows.select(*own).join(sums, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        return out.select(*own, F.coalesce("score", F.lit(0.0)).alias("score"))
    each = gram_hashes(rows, "_wh", "_row", *own)
    for gram in ("_word", "_pair"):
        blocks = F.broadcast(ratios.select(F.col("block").alias(f"{gram}_block"), F.col("ratios").alias(f"{gram}_ratios")))
        each = each.withColumn(f"{gram}_bucket", bucket_of(gram, buckets)).join(blocks, block_of(f"{gram}_bucket") == F.col(f"{gram}_block"), "left")
        each = each.withColumn(f"{gram}_ratio", F.get(f"{gram}_ratios", slot_of(f"{gram}_bucket")))
    both = F.coalesce("_word_ratio", F.lit(0.0)) + F.coalesce("_pair_ratio", F.lit(0.0))
    sums = each.groupBy("_row").agg(*[F.max(c).alias(c) for c in own], F.sum(both).alias("_sum"))
    return sums.select(*own, F.when(F.col("n_words") > 0, F.col("_sum") / (2 * F.col("n_words") - 1)).otherwise(0.0).alias("score"))


def verdicts(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rated`` with ``kept``; the trusted target is the documents whose doc_id ``trusted`` has."""
    buckets = bucket_count(docs)
    out = rated(docs, gram_ratios(docs, trusted, buckets), buckets)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def filtered(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    kept = verdicts(docs, trusted, threshold).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("_h"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_semi").select("_row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = verdicts(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return out.select("doc_id", *BASE, "kept", (F.round("score", 10) + 0.0).alias("score"))
