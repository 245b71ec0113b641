"""Searches over places and hashes: the same answers as by comparing everything, and how many pairs they meet."""

import math
import random

import pytest
from pyspark.sql import functions as F

from casegrain.functions import geo
from casegrain.operators import clusters, places


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.PLACE_RADIUS_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def by_windows(point, known):
    """The search as it is defined: boxes in turn, until one has a place near enough."""
    best = None
    for w in places.WINDOWS:
        own = [(km(*point, y, x), i) for i, y, x in known if abs(y - point[0]) <= w and abs(x - point[1]) <= w]
        best = min([*own, *([best] if best else [])], default=None)
        if best and best[0] <= places.NEAR_KM:
            return best
    return best


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    rows = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(150)] + [(150, 89.9, 10.0), (151, -89.9, 179.9), (152, 0.0, -179.99)]
    return rows, spark.createDataFrame(rows, "point_id long, lat double, lon double").cache()


@pytest.mark.parametrize("n", [30, 3000])
def test_nearest_place_equals_windows_in_turn(spark, points, n):
    rows, table = points
    rng = random.Random(n)
    known = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(n)]
    got = {r["point_id"]: r for r in places.nearest_place(table, spark.createDataFrame(known, "place_id long, lat double, lon double")).collect()}
    for i, lat, lon in rows:
        want = by_windows((lat, lon), known)
        if want is None:
            assert i not in got
        else:
            assert got[i]["place_id"] == want[1] and abs(got[i]["distance_km"] - want[0]) < 2e-3 and got[i]["approximate"] == (want[0] > places.NEAR_KM)


def test_pairs_of_a_point_stay_bounded_as_places_grow(spark, points):
    table = points[1].where("abs(lat) < 70")  # nearer to the poles boxes are narrow, and searches go on for longer

    def pairs(n):
        rng = random.Random(5)
        known = spark.createDataFrame([(k, rng.uniform(-80, 80), rng.uniform(-180, 180)) for k in range(n)], "place_id long, lat double, lon double")
        none = F.lit(None).cast("struct<km:double,place_id:bigint>")
        rows, met = table.withColumn("found", none), 0
        for degrees in places.STEPS:
            y, x = F.floor(F.col("lat") / degrees), F.floor(F.col("lon") / degrees)
            open_ = rows.where("found is null").select(y.alias("y"), x.alias("x"))
            cells = known.select(y.alias("py"), x.alias("px"))
            met += open_.join(cells, (F.abs(F.col("y") - F.col("py")) <= 1) & (F.abs(F.col("x") - F.col("px")) <= 1)).count()
            rows = spark.createDataFrame(places._step(rows, known, degrees).collect(), rows.schema)
        return met / table.count()

    few, many = pairs(3000), pairs(30_000)
    assert many < 2 * few and max(few, many) < 200  # comparing with all would be ten times as many


def test_facilities_round_the_globe(spark, points):
    rows, table = points
    rng = random.Random(2)
    known = [(k, "airport" if k % 2 else "port", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(2000)] + [(2000, "port", 0.1, 179.9), (2001, "airport", 89.5, -120.0)]
    limits = {"airport": 300.0, "port": 500.0}
    got = {(r["point_id"], r["kind"]): (r["place_id"], r["distance_km"]) for r in places.nearest_facility(table, spark.createDataFrame(known, "place_id long, kind string, lat double, lon double"), limits).collect()}
    want = {}
    for i, lat, lon in rows:
        for kind, most in limits.items():
            best = min(((km(lat, lon, y, x), k) for k, c, y, x in known if c == kind), default=None)
            if best and best[0] <= most:
                want[i, kind] = best[1]
    assert {k: v[0] for k, v in got.items()} == want and (152, "port") in want and (150, "airport") in want


def test_alike_hashes(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        at = rng.getrandbits(64)
        for flips in (0, 0, 1, 3, 5, 6):
            own = at
            for b in rng.sample(range(64), flips):
                own ^= 1 << b
            rows.append((len(rows), own - (own >> 63 << 64)))
    items = spark.createDataFrame(rows, "id long, hash long")
    want = {(a, b): bin((x ^ y) & (1 << 64) - 1).count("1") for a, x in rows for b, y in rows[a + 1 : a + 8] if bin((x ^ y) & (1 << 64) - 1).count("1") <= 5}
    pairs = clusters.alike_pairs(items)
    got = {(r["a"], r["b"]): r["distance"] for r in pairs.collect()}
    assert got == want and pairs.count() == len(got)
    links = {r["id"]: r["links"] for r in clusters.alike_links(items).collect()}
    assert links == {i: sum(i in p for p in want) for i, _ in rows}


def test_candidates_of_hashes_do_not_grow_with_the_square(spark):
    """What meets by chance is a few parts in a hundred thousand of all pairs."""
    n = 4000
    rows = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("hash"))
    near = clusters.alike_hashes(rows, 64)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    blocks, met = 3, 0
    values = [r["hash"] % 2**64 for r in rows.collect()]
    for k in range(blocks):
        a, b = 64 * k // blocks, 64 * (k + 1) // blocks
        homes = {}
        for v in values:
            homes[v >> a & (1 << b - a) - 1] = homes.get(v >> a & (1 << b - a) - 1, 0) + 1
        met += sum(homes.get(h ^ m, 0) * n_ for h, n_ in homes.items() for m in [0, *(1 << i for i in range(b - a))])
    assert met - blocks * n < 1e-4 * n * n
