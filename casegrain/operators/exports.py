"""Rows for other tools: relational tables, STIX objects, timelines, GeoJSON, KML, GPX, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import geo


def upserted(old: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """Old rows without those whose key comes anew, and the new rows: parents are replaced, children with them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def images(records: DataFrame) -> DataFrame:
    cols = ["sha256", "file_name", "file_path", "mime_type", "verdict_label", "confidence_score", "risk_level"]
    return records.select(*cols, F.col("is_authentic").cast("int").alias("is_authentic"))


def metadata_fields(fields: DataFrame) -> DataFrame:
    """Fields as children of images."""
    return fields.select(F.col("sha256").alias("image_sha256"), "standard", "tag_id", F.col("name").alias("tag_name"), F.col("value_str").alias("field_value"), "value_type", F.col("value_offset").alias("offset"))


def finding_rows(findings: DataFrame) -> DataFrame:
    """Findings as children of images."""
    return findings.select(F.col("sha256").alias("image_sha256"), "tier", "name", "confidence", "extractor", F.col("value").alias("value_json"))


def children_upserted(old: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """Old children without those of the ``parents`` (image_sha256) that come anew, and the new ones: a parent without new children loses its old ones."""
    return old.join(parents.select("image_sha256").distinct(), "image_sha256", "left_anti").unionByName(new)


def joined(parents: DataFrame, fields: DataFrame, found: DataFrame, gps: DataFrame) -> DataFrame:
    """(sha256, verdict_label, n_fields, n_findings, top_tier, latitude, longitude): images with what their children say.

    Children are counted before they are joined, so an image with many is one row.
    """
    f = fields.groupBy(F.col("image_sha256").alias("_f")).agg(F.count("*").alias("n_fields"))
    g = found.groupBy(F.col("image_sha256").alias("_g")).agg(F.count("*").alias("n_findings"), F.max("tier").alias("top_tier"))
    out = parents.join(f, F.col("sha256") == F.col("_f"), "left").join(g, F.col("sha256") == F.col("_g"), "left")
    out = out.join(gps.select(F.col("sha256").alias("_p"), "latitude", "longitude"), F.col("sha256") == F.col("_p"), "left")
    none = F.lit(0).cast("long")
    return out.select("sha256", "verdict_label", F.coalesce("n_fields", none).alias("n_fields"), F.coalesce("n_findings", none).alias("n_findings"), "top_tier", "latitude", "longitude")


def gps_locations(findings: DataFrame) -> DataFrame:
    """(sha256, latitude, longitude, altitude_m) from JSON values of GPS findings, the first of each record."""
    own = findings.where(F.col("name").isin("gps_coordinates_claimed", "gps_location_fix")).groupBy("sha256").agg(F.min_by("value", "ordinal").alias("value"))
    get = lambda c: F.get_json_object("value", f"$.{c}").try_cast("double").alias(c)
    return own.select("sha256", get("latitude"), get("longitude"), get("altitude_m")).where("latitude is not null and longitude is not null")


def stix_objects(records: DataFrame) -> DataFrame:
    """(sha256, type, id): a file for each record; an indicator and a relationship for those at risk or with trailing data. Ids follow from the hash."""
    risky = F.col("risk_level").isin("HIGH", "CRITICAL") | F.coalesce("trailing", F.lit(False))
    kinds = F.when(risky, F.array(F.lit("file"), F.lit("indicator"), F.lit("relationship"))).otherwise(F.array(F.lit("file")))
    rows = records.select("sha256", F.explode(kinds).alias("type"))
    return rows.withColumn("id", stix_id("", F.col("sha256"), F.col("type")))


def stix_id(kind: str, sha256, column=None):
    """An id that follows from the hash and the object's type."""
    named = F.lit(kind) if column is None else column
    h = F.sha2(F.concat_ws(":", named, sha256), 256)
    uid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4))], F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat_ws("--", named, uid)


def stix_json(records: DataFrame, created: str) -> DataFrame:
    """(sha256, type, id, object) as STIX 2.1; ``created`` stands in all objects' times, so reruns are equal."""
    rows = stix_objects(records).join(records.select("sha256", "file_name", "mime_type"), "sha256")
    uid = lambda kind: stix_id(kind, F.col("sha256"))
    common = [F.lit("2.1").alias("spec_version"), F.col("id")]
    times = [F.lit(created).alias("created"), F.lit(created).alias("modified")]
    file = F.struct(F.col("type"), *common, F.col("file_name").alias("name"), F.create_map(F.lit("SHA-256"), F.col("sha256")).alias("hashes"), "mime_type")
    pattern = F.concat(F.lit("[file:hashes.'SHA-256' = '"), F.col("sha256"), F.lit("']"))
    indicator = F.struct(F.col("type"), *common, *times, F.concat(F.lit("Forensic anomaly: "), F.col("file_name")).alias("name"), F.array(F.lit("anomalous-activity")).alias("indicator_types"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), F.lit(created).alias("valid_from"))
    relation = F.struct(F.col("type"), *common, *times, F.lit("indicates").alias("relationship_type"), uid("indicator").alias("source_ref"), uid("file").alias("target_ref"))
    text = F.when(F.col("type") == "file", F.to_json(file)).when(F.col("type") == "indicator", F.to_json(indicator)).otherwise(F.to_json(relation))
    return rows.select("sha256", "type", "id", text.alias("object"))


def timeline_rows(events: DataFrame) -> DataFrame:
    """The eight columns of super-timelines (Plaso, Timesketch); events have ts (in a UTC session), source, file_name, message, anomalous."""
    return events.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("datetime"),
        F.col("source").alias("timestamp_desc"),
        F.lit("IMAGE").alias("source"),
        F.lit("Image metadata").alias("source_long"),
        F.col("message"),
        F.lit("timeline").alias("parser"),
        F.col("file_name").alias("display_name"),
        F.when(F.col("anomalous"), "anomaly").otherwise("evidence_capture").alias("tag"),
    )


#: Ordinals that a part of a case's map files covers.
PART_POINTS = 100_000


def part() -> Column:
    return F.coalesce(F.floor(F.col("ordinal") / PART_POINTS).cast("long"), F.lit(0).cast("long"))


def geojson_features(points: DataFrame) -> DataFrame:
    """(case_id, ordinal, geometry, part): usable points, and the line through a case that has more than one (ordinal null).

    A part is what PART_POINTS ordinals number, so no row or document grows with a case. A case's line has a row for each of its
    parts but a first part of one point; the row of a later part begins at the last point before it, so the rows join up.
    """
    own = points.where(geo.usable(F.col("lat"), F.col("lon"))).withColumn("part", part())
    pair = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    dots = own.select("case_id", "ordinal", F.concat(F.lit('{"type":"Point","coordinates":'), pair, F.lit("}")).alias("geometry"), "part")
    places = own.select("case_id", "part", "ordinal", pair.alias("p"))
    lasts = places.groupBy("case_id", "part").agg(F.max(F.struct("ordinal", "p")).alias("last"))
    lasts = lasts.withColumn("next", F.lead("part").over(Window.partitionBy("case_id").orderBy("part"))).where("next is not null")
    joined = places.unionByName(lasts.select("case_id", F.col("next").alias("part"), "last.ordinal", "last.p"))
    lines = joined.groupBy("case_id", "part").agg(F.array_sort(F.collect_list(F.struct("ordinal", "p"))).alias("all")).where(F.size("all") > 1)
    path = F.array_join(F.transform("all", lambda x: x["p"]), ",")
    return dots.unionByName(lines.select("case_id", F.lit(None).cast("long").alias("ordinal"), F.concat(F.lit('{"type":"LineString","coordinates":['), path, F.lit("]}")).alias("geometry"), "part"))


def bounding_box(points: DataFrame, *by: str) -> DataFrame:
    own = points.where(geo.usable(F.col("lat"), F.col("lon")))
    return own.groupBy(*by).agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def _escaped(column: str):
    out = F.col(column)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def kml_placemarks(points: DataFrame) -> DataFrame:
    """(case_id, ordinal, placemark) of usable points (with a name)."""
    own = points.where(geo.usable(F.col("lat"), F.col("lon")))
    return own.select("case_id", "ordinal", F.concat(F.lit("<Placemark><name>"), _escaped("name"), F.lit("</name><Point><coordinates>"), F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.lit("0")), F.lit("</coordinates></Point></Placemark>")).alias("placemark"))


def gpx_waypoints(points: DataFrame) -> DataFrame:
    own = points.where(geo.usable(F.col("lat"), F.col("lon")))
    return own.select("case_id", "ordinal", F.concat(F.lit('<wpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"><time>'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time><name>"), _escaped("name"), F.lit("</name></wpt>")).alias("waypoint"))


def reports(records: DataFrame, findings: DataFrame) -> DataFrame:
    """(sha256, report): a record and its findings in order as a JSON object."""
    own = findings.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tier", "name", "confidence", "value"))).alias("findings"))
    rows = records.join(own, "sha256", "left")
    return rows.select("sha256", F.to_json(F.struct(*[c for c in rows.columns])).alias("report"))
