"""Sharding by sampled splitters, in DataFrame operations only.

Records are laid out on a line: by 60 bits of the SHA-256 of the text, so equal texts are neighbours, then by as many bits
of the id's, then by the id. A sample weighted by size gives splitters of the line at its quantiles; records fall into the
ranges between them; ranges that turn out overfull are subdivided by samples of their own, until those left hold
one text each. These are cut evenly by the id's hash, and what is one text and one id by a hash of the row. Exact bytes and
rows of each part, summed along the line, place every part, a window inside each part places every record, and the line
is cut into shards of equal bytes. Splitters and parts decide how the work is spread, never the result.

Law: ``bytes``. A group of equal texts goes as one where the middle of its bytes falls, if it has at most a WHOLE_PARTth
of a shard's bytes, over all its parts; records of larger groups go each where their own middle falls. So shards
differ by no more than a group or a record of that size, and a large group is spread over neighbouring shards.

Defined results: a null text has 0 bytes (size 16, CRC of nothing); null ids hash as empty text; rows equal
in id and text may change places among themselves; rows of ``sharded`` that are equal in all columns stay in one part; an
empty table gives an empty result; of extra columns all stay, except those named like the added ones (shard, slot, size,
text_crc32), which are replaced. Names that begin with _shard_ are the operator's own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.llm.common import id_text, written

SHARDS = 40
#: Bytes that a record has besides its text.
OVERHEAD = 16
#: Ranges for each shard at least, and rows in a range at most on average.
RANGES_PER_SHARD, ROWS_PER_RANGE = 16, 1_000_000
#: Sampled keys for each range; a range with more than OVERFULL times its share is subdivided.
SAMPLES_PER_RANGE, OVERFULL = 8, 4
#: A group stays whole up to a WHOLE_PARTth of a shard.
WHOLE_PART = 50
#: Bits of a part's number for the piece of a text, and for the piece of an id.
PIECE = 20
ADDED = ("size", "text_crc32", "shard", "slot")
KEYS = ("_shard_h", "_shard_i", "_shard_salt")


class Parts(NamedTuple):
    """Splitters of the line by the text's hash; pieces of ranges that hold one text; pieces of those that hold one id."""

    splitters: list[int]
    by_id: dict[int, int]
    by_salt: dict[int, int]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _hash60(col: Column) -> Column:
    return F.conv(F.substring(F.sha2(col, 256), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, salt: Column) -> DataFrame:
    """``docs`` with ``size`` and the KEYS; ``salt`` is a long that parts rows equal in id and text."""
    keys = (_hash60(_text()), _hash60(id_text("doc_id")), F.shiftrightunsigned(F.xxhash64(salt), 4))
    return docs.withColumns({"size": F.octet_length(_text()).cast("long") + OVERHEAD, **dict(zip(KEYS, keys, strict=True))})


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _fold(splitters: list[int], key: Column) -> Column:
    """How many splitters are at or below ``key``: a binary search as a fold over powers of two."""
    if not splitters:
        return F.lit(0)
    line = _longs(splitters)
    steps = F.array(*[F.lit(1 << b) for b in range(len(splitters).bit_length() - 1, -1, -1)])

    def step(at: Column, by: Column) -> Column:
        fits = at + by <= len(splitters)
        return F.when(fits & (F.element_at(line, F.least(at + by, F.lit(len(splitters)))) <= key), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _quantiles(sample: list[int], pieces: int) -> set[int]:
    """Keys that cut a sorted sample into equal pieces; one that several quantiles fall on gets a range of its own."""
    chosen = Counter(sample[len(sample) * i // pieces] for i in range(1, pieces)) if sample else {}
    return set(chosen) | {x + 1 for x, n in chosen.items() if n > 1}


def _sampled(slim: DataFrame, keys_per_byte: float, seed: int) -> list[int]:
    """Keys, each drawn with a chance in proportion to its bytes."""
    draw = F.xxhash64(*KEYS, F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    return sorted(r[0] for r in slim.where(draw < F.col("size") * F.lit(keys_per_byte)).select("_shard_h").collect())


def _piece(key: str, pieces: Column) -> Column:
    """Which of ``pieces`` equal pieces of 60 bits a key is in."""
    return F.shiftright(F.shiftright(key, 30) * pieces, 30)


def _pieces(by: dict[int, int], part: Column) -> Column:
    """The pieces of a part, 1 for those that aren't cut; ``by`` has at most an entry for each OVERFULL ranges."""
    names = sorted(by)
    at = F.greatest(_fold(names, part), F.lit(1))
    return F.when(F.element_at(_longs(names), at) == part, F.element_at(_longs([by[n] for n in names]), at)).otherwise(F.lit(1))


def parted(df: DataFrame, parts: Parts) -> DataFrame:
    """``df`` with ``_shard_part``, which grows along the line."""
    out = df.withColumn("_shard_part", F.shiftleft(_fold(parts.splitters, F.col("_shard_h")).cast("long"), 2 * PIECE))
    if parts.by_id:
        out = out.withColumn("_shard_part", F.col("_shard_part") + F.shiftleft(_piece("_shard_i", _pieces(parts.by_id, F.col("_shard_part"))), PIECE))
    if parts.by_salt:
        out = out.withColumn("_shard_part", F.col("_shard_part") + _piece("_shard_salt", _pieces(parts.by_salt, F.col("_shard_part"))))
    return out


def _summed(slim: DataFrame, parts: Parts, key: str) -> DataFrame:
    return parted(slim, parts).groupBy("_shard_part").agg(F.sum("size").alias("b"), F.min(key).alias("low"), F.max(key).alias("high"))


def sampled_parts(slim: DataFrame, shards: int) -> tuple[Parts, int]:
    """Splitters at the quantiles of a sample, with overfull ranges subdivided; and all bytes.

    The samples come to the driver: SAMPLES_PER_RANGE keys for each range on average, a few MB at 100 TB.
    """
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-rows // ROWS_PER_RANGE))
    density, most = SAMPLES_PER_RANGE * ranges / max(total, 1), OVERFULL * total / ranges
    parts = Parts(sorted(_quantiles(_sampled(slim, density, 7), ranges)), {}, {})
    pieces = lambda bytes_: min(int(bytes_ * ranges / total) + 1, (1 << PIECE) - 1)
    while full := _summed(slim, parts, "_shard_h").where((F.col("b") > most) & (F.col("low") < F.col("high"))).collect():
        density *= 4
        among = parted(slim, parts).where(F.col("_shard_part").isin([r["_shard_part"] for r in full]))
        sample, new = _sampled(among, density, 7 + len(parts.splitters)), set()
        for r in full:
            own = _quantiles(sample[bisect_left(sample, r["low"]) : bisect_right(sample, r["high"])], pieces(r["b"]))
            new |= {x for x in own if r["low"] < x <= r["high"]} or {r["high"]}  # a new splitter each round, so this ends
        parts = parts._replace(splitters=sorted({*parts.splitters, *new}))
    one_text = _summed(slim, parts, "_shard_h").where(F.col("b") > most).collect()
    parts = parts._replace(by_id={r["_shard_part"]: pieces(r["b"]) for r in one_text})
    if one_text:
        one_id = _summed(slim, parts, "_shard_i").where((F.col("b") > most) & (F.col("low") == F.col("high"))).collect()
        parts = parts._replace(by_salt={r["_shard_part"]: pieces(r["b"]) for r in one_id})
    return parts, int(total)


def _laid(slim: DataFrame, parts: Parts, total: int, shards: int):
    """A function that adds ``shard`` and ``_shard_at`` (the place on the line) to rows with the KEYS."""
    # A row for each part; the windows without a key see these rows only.
    sums = parted(slim, parts).groupBy("_shard_part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    line = Window.orderBy("_shard_part").rowsBetween(Window.unboundedPreceding, -1)
    range_ = F.shiftright("_shard_part", 2 * PIECE)
    starts = sums.select((F.col("_shard_part") + 1).alias("_shard_next"), range_.alias("_shard_range"), "b", *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(f"_shard_{c}0") for c in ("b", "n")])
    own = Window.partitionBy("_shard_range")
    cut = F.count("*").over(own) > 1  # a range in several parts is one group
    starts = starts.withColumns({"_shard_whole": F.when(cut, F.sum("b").over(own)), "_shard_from": F.when(cut, F.min("_shard_b0").over(own))})
    starts = written(starts.drop("b", "_shard_range"), "starts")
    inside = Window.partitionBy("_shard_part").orderBy("_shard_h", "_shard_i", "doc_id", "_shard_salt")
    group = Window.partitionBy("_shard_part", "_shard_h")

    def on_line(df: DataFrame) -> DataFrame:
        out = parted(df, parts).withColumns({"_shard_b": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "_shard_n": F.row_number().over(inside) - 1})
        out = out.withColumns({"_shard_g": F.min("_shard_b").over(group), "_shard_gs": F.sum("size").over(group)})
        # An expression, not a column, on the left: no filters are inferred from it for the other side.
        out = out.join(starts, F.col("_shard_part") + 1 == F.col("_shard_next"))
        size, start = F.coalesce("_shard_whole", "_shard_gs"), F.coalesce("_shard_from", F.col("_shard_b0") + F.col("_shard_g"))
        alone = F.col("_shard_b0") + F.col("_shard_b") + F.floor(F.col("size") / 2)
        out = out.withColumn("_shard_mid", F.when(size * (shards * WHOLE_PART) <= total, start + F.floor(size / 2)).otherwise(alone))
        shard = F.least(F.expr(f"{shards} * _shard_mid div {max(total, 1)}"), F.lit(shards - 1)).cast("int")
        return out.withColumns({"shard": shard, "_shard_at": F.col("_shard_n0") + F.col("_shard_n")})

    return on_line


def _slotted(placed: DataFrame, line: DataFrame) -> DataFrame:
    """``placed`` with ``slot``: places on the line less the first place of the shard, from a row for each shard of ``line``."""
    first = written(line.groupBy(F.col("shard").alias("_shard_s")).agg(F.min("_shard_at").alias("_shard_first")), "first")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard_s")).withColumn("slot", F.col("_shard_at") - F.col("_shard_first"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... in its shard)."""
    own = docs.drop(*ADDED)
    rows = keyed(own, F.xxhash64(*[f"`{c}`" for c in own.columns]))
    slim = written(rows.select("doc_id", "size", *KEYS), "keys")
    parts, total = sampled_parts(slim, shards)
    on_line = _laid(slim, parts, total, shards)
    rows = rows.withColumn("text_crc32", F.crc32(F.encode(_text(), "UTF-8")))
    return _slotted(on_line(rows), on_line(slim)).select(*own.columns, *ADDED)


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): the same shards without the texts, which are read once."""
    slim = keyed(docs.select("doc_id", "text"), F.monotonically_increasing_id())
    slim = written(slim.select("doc_id", "size", F.crc32(F.encode(_text(), "UTF-8")).alias("text_crc32"), *KEYS), "keys")
    parts, total = sampled_parts(slim, shards)
    placed = written(_laid(slim, parts, total, shards)(slim).select("doc_id", "size", "text_crc32", "shard", "_shard_at"), "placed")
    return _slotted(placed, placed).select("doc_id", *ADDED)


def op7_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assigned(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
