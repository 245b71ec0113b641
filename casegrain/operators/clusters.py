"""Groups of records: by camera, quantisation tables, place, look."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions import bits, geo

STRIPPED = "Unknown / Stripped Camera"
OUTLIER_LEAST, RADIUS_KM, LOOK_BITS = 3, 5.0, 5


def camera_key(make: Column, model: Column, serial: Column, dqt: Column) -> Column:
    named = F.trim(F.concat(F.coalesce(make, F.lit("")), F.lit(" "), F.coalesce(model, F.lit(""))))
    nothing = lambda c: c.isNull() | (c == "")
    return F.concat_ws(
        " | ",
        F.when(nothing(make) & nothing(model), STRIPPED).otherwise(named),
        F.when(~nothing(serial), F.concat(F.lit("SN:"), serial)),
        F.when(~nothing(dqt) & (dqt != "no_dqt"), F.concat(F.lit("DQT:"), dqt)),
    )


def grouped(items: DataFrame, key: Column, prefix: str) -> DataFrame:
    """(cluster_id, cluster_label, item_count, first_ordinal), numbered by first appearance.

    The numbering sorts one row per cluster.
    """
    groups = items.groupBy(key.alias("cluster_label")).agg(F.count("*").alias("item_count"), F.min("ordinal").alias("first_ordinal"))
    place = F.row_number().over(Window.orderBy("first_ordinal"))
    return groups.select(F.concat(F.lit(prefix), place.cast("string")).alias("cluster_id"), "cluster_label", "item_count", "first_ordinal")


def outliers(clusters: DataFrame) -> DataFrame:
    """Clusters of one item, where there are several clusters and the largest has three items or more."""
    every = Window.partitionBy()  # over one row per cluster
    out = clusters.withColumns({"_most": F.max("item_count").over(every), "_n": F.count("*").over(every)})
    return out.where(f"item_count = 1 and _most >= {OUTLIER_LEAST} and _n > 1").drop("_most", "_n")


def _leaders(items: DataFrame, columns: list[str], near: Callable[[np.ndarray, np.ndarray], np.ndarray], prefix: str) -> DataFrame:
    """Assigns each item, in its case's order, to the first item that is near and leads a cluster, or lets it lead one.

    The order decides, so a case is worked through by one task; cases are spread. Leaders are compared with all later
    items at a time, in numpy.
    """
    fields = [*items.select("case_id", "ordinal").schema.fields, T.StructField("cluster_id", T.StringType()), T.StructField("leader", T.LongType())]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", kind="stable")
        values = pdf[columns].to_numpy()
        known = pdf[columns].notna().all(axis=1).to_numpy()
        cluster, leader, n = np.full(len(pdf), 0), np.full(len(pdf), -1, np.int64), 0
        ordinals = pdf["ordinal"].to_numpy()
        for i in range(len(pdf)):
            if cluster[i] or not known[i]:
                continue
            n += 1
            free = (cluster == 0) & known
            free[: i + 1] = False
            rows = np.flatnonzero(free)
            hit = rows[near(values[i], values[rows])] if len(rows) else rows
            cluster[i], leader[i] = n, ordinals[i]
            cluster[hit], leader[hit] = n, ordinals[i]
        ids = [f"{prefix}{c}" if c else f"{prefix}NONE" for c in cluster]
        return pd.DataFrame({"case_id": pdf["case_id"], "ordinal": ordinals, "cluster_id": ids, "leader": pd.array([x if x >= 0 else None for x in leader.tolist()], "Int64")})

    return items.groupBy("case_id").applyInPandas(assign, T.StructType(fields))


def by_place(items: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """(case_id, ordinal, cluster_id, leader): around leaders in input order; items without a usable place in GEO_NONE."""
    own = items.select("case_id", "ordinal", *[F.when(geo.usable(F.col("lat"), F.col("lon")), F.col(c)).alias(c) for c in ("lat", "lon")])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (y, x), ys, xs = np.radians(a.astype(float)), np.radians(b[:, 0].astype(float)), np.radians(b[:, 1].astype(float))
        h = np.sin((ys - y) / 2) ** 2 + np.cos(y) * np.cos(ys) * np.sin((xs - x) / 2) ** 2
        return 2 * geo.RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) <= radius_km

    return _leaders(own, ["lat", "lon"], near, "GEO_")


def by_look(items: DataFrame, bits_apart: int = LOOK_BITS) -> DataFrame:
    """(case_id, ordinal, cluster_id, leader) from 64-bit hashes; an item without one is alone."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(b[:, 0].astype(np.int64).view(np.uint64) ^ a.astype(np.int64).view(np.uint64)[0]) <= bits_apart

    return _leaders(items.select("case_id", "ordinal", "hash"), ["hash"], near, "VIS_")


def alike_hashes(hashes: DataFrame, bits_apart: int = LOOK_BITS, width: int = 64) -> DataFrame:
    """(ha, hb, distance), ha < hb: distinct hashes (column hash) that differ in ``bits_apart`` bits at most.

    Of BLOCKS blocks of bits, one differs in no more than bits_apart // BLOCKS bits. The one side looks into all values that near
    of each block, the other waits at its own; a pair counts in the first block where it meets, so none comes twice.
    Blocks have 16 to 21 bits, so what meets by chance is a small part of a percent of all pairs.
    """
    blocks = 2 if width <= 32 else 3
    cuts, radius = [width * k // blocks for k in range(blocks + 1)], bits_apart // blocks
    part = lambda h, k: F.shiftrightunsigned(h, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long"))
    flips = [[sum(1 << b for b in own) for r in range(radius + 1) for own in combinations(range(cuts[k + 1] - cuts[k]), r)] for k in range(blocks)]
    own = hashes.where("hash is not null").select("hash").distinct()

    def looks_of(k: int) -> Column:
        masks = F.split(F.lit(",".join(map(str, flips[k]))), ",").cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("k"), part("hash", k).bitwiseXOR(m).alias("v")))

    looks = F.concat(*map(looks_of, range(blocks)))
    waits = F.array(*[F.struct(F.lit(k).alias("k"), part("hash", k).alias("v")) for k in range(blocks)])
    left = own.select(F.col("hash").alias("ha"), F.explode(looks).alias("_l"))
    right = own.select(F.col("hash").alias("hb"), F.explode(waits).alias("_r"))
    both = left.join(right, (F.col("_l.k") == F.col("_r.k")) & (F.col("_l.v") == F.col("_r.v")) & (F.col("ha") < F.col("hb")))
    apart = F.col("ha").bitwiseXOR(F.col("hb"))
    earlier = reduce(lambda a, b: a | b, [(F.col("_l.k") > k) & (F.bit_count(part(apart, k)) <= radius) for k in range(blocks - 1)])
    far = bits.hamming(F.col("ha"), F.col("hb"))
    return both.where(~earlier & (far <= bits_apart)).select("ha", "hb", far.alias("distance"))


def alike_pairs(items: DataFrame, bits_apart: int = LOOK_BITS, width: int = 64) -> DataFrame:
    """(a, b, distance): pairs of items (id, hash) whose hashes differ in ``bits_apart`` bits at most; see ``alike_links`` for large groups."""
    near = alike_hashes(items, bits_apart, width)
    one, two = items.select(F.col("id").alias("x"), F.col("hash").alias("ha")), items.select(F.col("id").alias("y"), F.col("hash").alias("hb"))
    other = near.join(one, "ha").join(two, "hb").select("x", "y", "distance")
    same = one.join(two, (F.col("ha") == F.col("hb")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(0).alias("distance"))
    return other.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def alike_links(items: DataFrame, bits_apart: int = LOOK_BITS, width: int = 64) -> DataFrame:
    """(id, hash, same, links): how many other items have an item's hash, and how many are alike (these among them).

    Counted over distinct hashes; pairs of items are never made.
    """
    counts = items.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"))
    near = alike_hashes(counts, bits_apart, width)
    ways = near.select(F.col("ha").alias("hash"), F.col("hb").alias("_other")).union(near.select("hb", "ha"))
    more = ways.join(counts.withColumnRenamed("hash", "_other"), "_other").groupBy("hash").agg(F.sum("n").alias("_more"))
    every = counts.join(more, "hash", "left").select("hash", (F.col("n") - 1).alias("same"), (F.col("n") - 1 + F.coalesce("_more", F.lit(0))).alias("links"))
    return items.join(every, "hash").select("id", "hash", "same", "links")
