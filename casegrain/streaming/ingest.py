"""Streams of files and events (an addition: the batch operators on micro-batches)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casegrain.functions import geo
from casegrain.operators.timeline import SPEED_LIMIT_KMH
from casegrain.sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"
FIXES = "case_id long, ordinal long, ts timestamp, lat double, lon double"
STEPS = "case_id long, ordinal long, ts timestamp, delta_seconds double, distance_km double, speed_kmh double, anomaly boolean"


def new_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Files as they arrive in a folder, identified."""
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.identified(rows.withColumnRenamed("modificationTime", "mtime"))


def into_tables(stream: DataFrame, folder: str, checkpoint: str):
    """Walks and parses arriving files into Parquet tables of units, blocks, fields and diagnostics. A batch that runs again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        def once(table: DataFrame, name: str) -> DataFrame:
            path = f"{folder}/{name}/batch={number}"
            table.write.mode("overwrite").parquet(path)
            return table.sparkSession.read.schema(table.schema).parquet(path)

        once(batch.drop("content"), "evidence")
        walked = once(files.events(batch), "events")  # the files are walked once, their blocks parsed once
        blocks = once(files.blocks(walked), "blocks")
        parsed = once(files.parsed(blocks), "parsed")
        for name, table in {"units": files.units(walked), "fields": files.fields(parsed), "diagnostics": files.diagnostics(walked, parsed)}.items():
            once(table, name)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def speeds(fixes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Speed from each fix to the next of its case, across batches; the last fix of a case is its state.

    Fixes older than a case's last one are left out: a stream can't go back.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for pdf in batches:
            for r in pdf.sort_values(["ts", "ordinal"]).itertuples():
                now = (int(r.ts.value // 1000), float(r.lat) if pd.notna(r.lat) else None, float(r.lon) if pd.notna(r.lon) else None)
                delta = km = speed = None
                if last is not None:
                    delta = (now[0] - last[0]) / 1e6
                    if delta < 0:
                        continue
                    if delta >= 1 and _usable(last) and _usable(now):
                        km = _km(last, now)
                        speed = km / delta * 3600
                rows.append((key[0], r.ordinal, r.ts, delta, km, speed, bool(speed and speed > SPEED_LIMIT_KMH)))
                last = now
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])

    keyed = fixes.withWatermark("ts", late).groupBy("case_id")
    return keyed.applyInPandasWithState(step, STEPS, "micros long, lat double, lon double", "append", GroupStateTimeout.NoTimeout)


def _usable(fix: tuple) -> bool:
    _, lat, lon = fix
    return lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180 and not (abs(lat) < geo.NEAR_ZERO and abs(lon) < geo.NEAR_ZERO)


def _km(a: tuple, b: tuple) -> float:
    from math import atan2, cos, radians, sin, sqrt

    h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
    return 2 * geo.RADIUS_KM * atan2(sqrt(h), sqrt(1 - h))


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of event time; late ones are taken until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
