import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from casegrain.operators import timeline


def test_previous_across_slices(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        case = 1 if k % 3 else rng.choice([None, 2, 3])  # one case holds most rows
        ts = None if k % 50 == 0 else datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 40), hours=rng.choice([0, 5, 23]))
        rows.append((case, k, ts, None if k % 7 == 0 else rng.uniform(-80, 80), rng.uniform(-170, 170)))
    df = spark.createDataFrame(rows, "case_id long, ordinal long, ts timestamp, lat double, lon double")
    got = {r["ordinal"]: r["_previous"]["ordinal"] if r["_previous"] else None for r in timeline.with_previous(df, timeline.by_day(F.col("ts")), ["ts", "ordinal"], ["lat"]).collect()}
    want, last = {}, {}
    for case, k, ts, *_ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or datetime(1, 1, 1), r[1])):
        want[k] = last.get(case)
        last[case] = k
    assert got == want and len(got) == len(rows)


def test_speeds_need_a_second_and_two_usable_fixes(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 48.0, 2.0), (1, 2, "2024-01-01 00:00:00.5", 10.0, 2.0), (1, 3, "2024-01-01 01:00:00", 48.0, 2.0), (1, 4, "2024-01-02 02:00:00", 0.0, 0.0), (1, 5, "2024-01-05 03:00:00", 49.0, 2.0), (1, 6, "2024-01-05 03:30:00", -49.0, 2.0)]
    df = spark.createDataFrame(rows, "case_id long, ordinal long, ts string, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    out = {r["ordinal"]: (r["speed_kmh"] is not None, r["kinematic_anomaly"]) for r in timeline.kinematics(df).collect()}
    assert out == {1: (False, False), 2: (False, False), 3: (True, True), 4: (False, False), 5: (False, False), 6: (True, True)}
    assert [r["to_ordinal"] for r in timeline.steps(df).orderBy("ordinal").collect()] == [2, 3, 5, 6]
    assert timeline.kinematics(df.limit(0)).count() == 0
