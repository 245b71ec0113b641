"""Mixing sources to target weights.

Sizes are summed per source, targets and repetition rates follow from weights, and every document is
emitted ``floor(rate)`` times plus one Bernoulli copy whose probability is the fraction of the rate.

The Bernoulli draw is a uniform of 52 bits out of a SHA-256 of the seed and the document id: one draw a document,
the same in each run. A source's taken words are its target on average; a source of few documents
may miss it by what such draws scatter.

Defined results: a null or empty text has size 0 and is kept (it takes no words); a null source is a source
of its own, ordered last; rows with one id (null ids too) share their draw; an empty table gives an
empty result; of extra columns, ``mixed`` keeps all whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.llm.common import SPACED, id_text, written

#: Weights in order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
CAP = 3
SEED = "mix"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words parted by ASCII white space."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0)).cast("long"))


def _uniform(seed: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text("doc_id")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    With the level L that solves sum(min(cap * size, weight * L)) = sum(size), a target is
    min(cap * size, weight * L): what handing on the excess again and again converges to.
    One row per source; the windows without a key see that table only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = per.withColumn("weight", weight).withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    shares = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level_here", left / shares).withColumn("n", F.row_number().over(order))
    level = F.min_by("level_here", F.when(F.col("level_here") <= F.col("ratio"), F.col("n"))).over(every)
    target = F.least(F.col("most"), F.col("weight") * F.coalesce(level, F.col("ratio")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def repetition_rates(sizes: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """``source_targets`` as a written table."""
    return written(source_targets(sizes, weights, cap), "rates")


def with_copies(sizes: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """Each row of (doc_id, source, size, ...) with its source's figures, ``copies`` and ``taken`` = copies * size.

    ``rates`` is a written table of a row per source: Spark broadcasts it while its size on disk is under
    the threshold, else it sorts and merges, dividing the partitions of hot sources at run time.
    """
    other = rates.withColumnRenamed("source", "_source")
    both = sizes.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    copies = (whole + F.when(_uniform(seed) < F.col("rate") - whole, 1).otherwise(0)).cast("long")
    return both.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights=WEIGHTS, cap=CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn."""
    sizes = written(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"), "sizes")
    rates = repetition_rates(sizes, weights, cap)
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", F.lit(0).cast("long").alias("size"))
    drawn = with_copies(rows, rates, seed).where("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = written(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"), "sizes")
    return with_copies(sizes, repetition_rates(sizes)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
