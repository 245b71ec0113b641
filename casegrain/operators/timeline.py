"""Timelines and trajectories of records.

Events have case_id, ordinal, ts and, where known, lat and lon. A case is ordered by time, its ordinal breaking ties;
a collection needs no order over all of it. Slices of a case are the unit of parallel work: a case that holds a third of
all events is sorted in as many tasks as it has slices, and the last event of each slice is handed to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import geo

SPEED_LIMIT_KMH, DRIFT_LIMIT_S = 1000.0, 300.0


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


#: Rows without a time or an ordinal come first; their slice lies before all others.
BEFORE_ALL = -(1 << 40)
#: Characters of a name that its slice is named by.
PREFIX = 8


def with_previous(rows: DataFrame, slice_: Column, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``_previous``, a struct of ``order`` and ``columns`` of the row before in the case, null for the first.

    ``slice_`` must not fall along ``order``. Within slices that is a window; across them, one row per slice goes into a
    window of its own and is joined back.
    """
    packed = F.struct(*order, *columns)
    sliced = rows.withColumn("_slice", slice_)
    ends = sliced.groupBy("case_id", "_slice").agg(F.max(packed).alias("_last"))
    handed = ends.select(F.col("case_id").alias("_case"), F.col("_slice").alias("_s"), F.lag("_last").over(Window.partitionBy("case_id").orderBy("_slice")).alias("_handed"))
    inner = sliced.withColumn("_inner", F.lag(packed).over(Window.partitionBy("case_id", "_slice").orderBy(*order)))
    both = inner.join(handed, F.col("case_id").eqNullSafe(F.col("_case")) & F.col("_slice").eqNullSafe(F.col("_s")))
    return both.withColumn("_previous", F.coalesce("_inner", "_handed")).drop("_slice", "_s", "_case", "_inner", "_handed")


def by_day(ts: Column) -> Column:
    return F.coalesce(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("long"), F.lit(BEFORE_ALL))


def by_run(ordinal: Column, rows: int = 1_000_000) -> Column:
    return F.coalesce(F.floor(ordinal / rows).cast("long"), F.lit(BEFORE_ALL))


def kinematics(events: DataFrame) -> DataFrame:
    """Each event with the time, distance and speed since the event before it in its case."""
    out = with_previous(events, by_day(F.col("ts")), ["ts", "ordinal"], ["lat", "lon"])
    out = out.withColumns({f"_{c}": F.col("_previous")[c] for c in ("ts", "lat", "lon")}).drop("_previous")
    delta = seconds_between(F.col("ts"), F.col("_ts"))
    both = geo.usable(F.col("_lat"), F.col("_lon")) & geo.usable(F.col("lat"), F.col("lon"))
    km = F.when(both & (F.abs(delta) >= 1.0), geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    speed = km / F.abs(delta) * 3600.0
    return out.withColumns({
        "delta_seconds": delta,
        "distance_km": F.round(km, 3),
        "speed_kmh": F.round(speed, 1),
        "kinematic_anomaly": F.coalesce(speed > SPEED_LIMIT_KMH, F.lit(False)),
    }).drop("_ts", "_lat", "_lon")


def inversions(events: DataFrame, name: str) -> DataFrame:
    """Events that are older than the event whose name comes before theirs; slices are names that begin alike."""
    out = with_previous(events, F.substring(name, 1, PREFIX), [name], ["ts"])
    out = out.withColumns({"previous_name": F.col("_previous")[name], "_ts": F.col("_previous.ts")}).drop("_previous")
    return out.where(F.col("ts") < F.col("_ts")).withColumn("delta_seconds", seconds_between(F.col("ts"), F.col("_ts"))).drop("_ts")


def drift(camera: Column, gps: Column) -> Column:
    """Seconds that a camera's clock is ahead of satellite time, and whether that is an anomaly."""
    d = F.round(seconds_between(camera, gps), 2)
    return F.struct(d.alias("drift_seconds"), F.coalesce(F.abs(d) > DRIFT_LIMIT_S, F.lit(False)).alias("drift_anomaly"))


def summary(events: DataFrame, *by: str) -> DataFrame:
    span = seconds_between(F.max("ts"), F.min("ts"))
    return events.groupBy(*by).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), span.alias("duration_seconds"))


def steps(points: DataFrame) -> DataFrame:
    """From each usable point to the next in input order: distance, bearing, time, speed."""
    own = points.where(geo.usable(F.col("lat"), F.col("lon"))).select("case_id", "ordinal", "ts", "lat", "lon")
    rows = with_previous(own, by_run(F.col("ordinal")), ["ordinal"], ["ts", "lat", "lon"]).where("_previous is not null")
    a = {c: F.col("_previous")[c] for c in ("ordinal", "ts", "lat", "lon")}
    km = geo.haversine(a["lat"], a["lon"], F.col("lat"), F.col("lon"))
    course = geo.bearing(a["lat"], a["lon"], F.col("lat"), F.col("lon"))
    seconds = F.abs(seconds_between(F.col("ts"), a["ts"]))
    speed = F.when(seconds > 0, km / seconds * 3600.0)
    return rows.select("case_id", a["ordinal"].alias("ordinal"), F.col("ordinal").alias("to_ordinal"), F.round(km, 3).alias("distance_km"), F.round(course, 2).alias("bearing"), geo.cardinal(course).alias("cardinal"), seconds.alias("seconds"), F.round(speed, 1).alias("speed_kmh"), F.coalesce(speed > SPEED_LIMIT_KMH, F.lit(False)).alias("anomaly"))
