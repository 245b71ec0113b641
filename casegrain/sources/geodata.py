"""Geographic inputs: well-known binary points, GeoJSON features, answers of address services, zones."""

from __future__ import annotations

import sqlite3
import struct
import tempfile
from collections.abc import Callable, Iterator
from contextlib import closing
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.operators import places

OFFSET_SLACK_H = 0.6
RINGS = "array<array<array<double>>>"


def point_of(wkb: bytes | None) -> tuple[float, float] | None:
    """(lat, lon) of a 2D point in well-known binary, of either byte order."""
    if wkb is None or len(wkb) < 21 or wkb[0] > 1:
        return None
    order = "<" if wkb[0] else ">"
    if struct.unpack(order + "I", wkb[1:5])[0] != 1:
        return None
    lon, lat = struct.unpack(order + "dd", wkb[5:21])
    return lat, lon


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def wkb_point(column: pd.Series) -> pd.DataFrame:
    rows = [point_of(bytes(v)) if v is not None else None for v in column]
    return pd.DataFrame([r or (None, None) for r in rows], columns=["lat", "lon"], dtype="float64")


def fences(spark: SparkSession, text: str) -> DataFrame:
    """(fence_id, name, rings) of a GeoJSON text: a collection, a feature or a bare geometry; each polygon of a multi-polygon is a row."""
    geometry = "struct<type:string,coordinates:string>"
    feature = f"struct<type:string,properties:map<string,string>,geometry:{geometry}>"
    doc = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", f"struct<type:string,coordinates:string,properties:map<string,string>,geometry:{geometry},features:array<{feature}>>").alias("d"))
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("map<string,string>").alias("properties"), F.struct("d.type", "d.coordinates").alias("geometry"))
    own = F.struct("d.type", "d.properties", "d.geometry")
    rows = doc.select(F.posexplode(F.when(F.col("d.features").isNotNull(), F.col("d.features")).when(F.col("d.type") == "Feature", F.array(own)).otherwise(F.array(bare))).alias("n", "f"))
    many = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", RINGS))).when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{RINGS}>"))
    return rows.select("n", F.element_at("f.properties", "name").alias("name"), F.posexplode(many).alias("k", "rings")).select((F.col("n") * 1000 + F.col("k")).cast("int").alias("fence_id"), "name", "rings")


def address_info(text: Column) -> Column:
    """An address service's answer in JSON under one set of names; null if it failed or has no usable place."""
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(text, f"$.{n}"), F.lit("")) for n in names])
    lat, lon = get("lat", "latitude").try_cast("double"), get("lon", "longitude").try_cast("double")
    good = F.coalesce(get("status") != "fail", F.lit(True)) & lat.between(-90, 90) & lon.between(-180, 180)
    info = F.struct(
        F.coalesce(get("query", "ip"), F.lit("Unknown")).alias("ip"), get("country").alias("country"), F.upper(F.coalesce(get("countryCode", "country_code"), F.lit(""))).alias("country_code"),
        get("region").alias("region"), get("regionName", "region_name").alias("region_name"), get("city").alias("city"), get("zip", "postal_code", "postcode").alias("postal_code"),
        lat.alias("lat"), lon.alias("lon"), get("timezone").alias("timezone"), get("isp").alias("isp"), get("org", "organization").alias("organization"), get("as", "asn").alias("autonomous_system"),
    )
    return F.when(good, info)


def zone_offsets(zone: str) -> list[float]:
    """A zone's offsets in hours at noon of the first day of each month of 2024 and 2025; none if it is unknown."""
    try:
        info = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return []
    return sorted({round(datetime(2024 + m // 12, m % 12 + 1, 1, 12, tzinfo=info).utcoffset().total_seconds() / 3600, 2) for m in range(24)})


@F.pandas_udf(T.BooleanType())
def offset_fits(zones: pd.Series, hours: pd.Series) -> pd.Series:
    """Whether a claimed offset is one of a zone's; unknown zones admit any."""
    known = {z: zone_offsets(z) if z else [] for z in zones.unique()}
    return pd.Series([not known[z] or any(abs(h - o) < OFFSET_SLACK_H for o in known[z]) for z, h in zip(zones, hours, strict=True)])


def capture_utc(local: Column, offset: Column, zone: Column) -> Column:
    """Local time to UTC by its own offset, else by the place's zone, else as it is."""
    from casegrain.functions.timeparse import shifted

    return F.when(offset.isNotNull(), shifted(local, offset)).when(zone.isNotNull(), F.to_utc_timestamp(local, zone)).otherwise(local)


def geonames(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Places out of JSON files that hold them in a list named ``places``; those without a name or place are left out."""
    text = spark.read.text(paths, wholetext=True)
    lines = text.select(F.explode(F.from_json("value", "struct<places:array<string>>")["places"]).alias("value"))
    return places.parse_places(lines)


# Layers of the Natural Earth database and their columns.
LAYERS = {
    "place": ("ne_10m_populated_places", ["name", "adm0name", "iso_a2", "adm1name", "latitude", "longitude", "timezone", "pop_max", "featurecla"]),
    "airport": ("ne_10m_airports", ["name", "name_en", "iata_code", "gps_code", "type", "GEOMETRY"]),
    "port": ("ne_10m_ports", ["name", "featurecla", "website", "GEOMETRY"]),
}
PLACE_ROWS = "name string, country string, country_code string, admin1 string, lat double, lon double, timezone string, population long, feature string"
FACILITY_ROWS = "kind string, name string, code string, category string, lat double, lon double"
UNKNOWN_CODE = "-99"


def _layer(spark: SparkSession, path: str, kind: str, row: Callable[[dict], tuple | None], schema: str) -> DataFrame:
    """Rows of a layer of a SQLite database; the task that reads it keeps a copy of its own while it does, and sends the rows in batches."""
    table, columns = LAYERS[kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".sqlite") as copy:
                    copy.write(content)
                    copy.flush()
                    with closing(sqlite3.connect(copy.name)) as base:
                        base.row_factory = sqlite3.Row
                        cursor = base.execute(f'SELECT {", ".join(columns)} FROM "{table}"')
                        while rows := cursor.fetchmany(10_000):
                            kept = [r for r in (row(dict(x)) for x in rows) if r is not None]
                            yield pd.DataFrame(kept, columns=names).astype({"population": "Int64"} if "population" in names else {})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def sqlite_places(spark: SparkSession, path: str) -> DataFrame:
    """Populated places of a Natural Earth database; those without coordinates are left out."""

    def row(r: dict) -> tuple | None:
        if r["latitude"] is None or r["longitude"] is None:
            return None
        code = r["iso_a2"] if r["iso_a2"] != UNKNOWN_CODE else None
        return r["name"], r["adm0name"], code, r["adm1name"], r["latitude"], r["longitude"], r["timezone"], r["pop_max"], r["featurecla"]

    return _layer(spark, path, "place", row, PLACE_ROWS)


def sqlite_facilities(spark: SparkSession, path: str) -> DataFrame:
    """Airports and ports of a Natural Earth database under the names that summaries use; without a point, none."""
    known = lambda c: c if c and c != UNKNOWN_CODE else ""

    def airport(r: dict) -> tuple | None:
        at, name = point_of(r["GEOMETRY"]), (r["name_en"] or r["name"] or "").strip()
        name = name if name.lower().endswith("airport") else f"{name} Airport"
        return at and ("airport", name, known(r["iata_code"]) or known(r["gps_code"]), r["type"] or "airport", *at)

    def port(r: dict) -> tuple | None:
        at, name = point_of(r["GEOMETRY"]), (r["name"] or "").strip()
        name = name if name.lower().startswith("port") else f"Port of {name}"
        return at and ("port", name, "", r["featurecla"] or "seaport", *at)

    return _layer(spark, path, "airport", airport, FACILITY_ROWS).unionByName(_layer(spark, path, "port", port, FACILITY_ROWS))

