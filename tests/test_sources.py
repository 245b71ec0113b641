import json
import struct
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import functions as F

from casegrain.operators import encoders, places, reports
from casegrain.sources import geodata, jpegtables, metadata


def test_wkb(spark):
    good = [struct.pack("<BIdd", 1, 1, 2.5, 48.5), struct.pack(">BIdd", 0, 1, 2.5, 48.5)]
    bad = [None, b"", struct.pack("<BIdd", 1, 2, 0, 0), b"\x05" * 30]
    rows = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate(good + bad)], "k int, b binary").select("k", geodata.wkb_point("b").alias("p")).orderBy("k").collect()
    assert [(r["p"]["lat"], r["p"]["lon"]) for r in rows[:2]] == [(48.5, 2.5)] * 2
    assert all(r["p"]["lat"] is None or r["p"]["lat"] != r["p"]["lat"] for r in rows[2:])


def test_geojson_forms(spark):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2]]]
    shifted = [[[10, 0], [12, 0], [12, 2], [10, 2]]]
    poly = {"type": "Polygon", "coordinates": square}
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": poly}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, shifted]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 1]}}]}
    assert geodata.fences(spark, json.dumps(collection)).count() == 3
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 11.0), (3, 9.0, 9.0)], "point_id int, lat double, lon double")
    rows = {r["point_id"]: r["fence_id"] for r in places.in_fences(points, geodata.fences(spark, json.dumps(collection))).collect()}
    assert rows == {1: 0, 2: 1001, 3: None}
    for one in (poly, {"type": "Feature", "properties": {"name": "b"}, "geometry": poly}):
        assert geodata.fences(spark, json.dumps(one)).count() == 1


def test_address_answers(spark):
    rows = [{"query": "1.2.3.4", "lat": 48.8, "lon": 2.3, "countryCode": "fr", "as": "AS1"}, {"ip": "5", "latitude": "1", "longitude": "2", "region_name": "r"}, {"status": "fail", "lat": 1, "lon": 1}, {"lat": 99, "lon": 0}]
    got = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("{",)], "t string").select(geodata.address_info(F.col("t")).alias("i")).collect()
    assert [(r["i"]["ip"], r["i"]["lat"], r["i"]["country_code"]) if r["i"] else None for r in got] == [("1.2.3.4", 48.8, "FR"), ("5", 1.0, ""), None, None, None]


def test_zones(spark):
    assert geodata.zone_offsets("Europe/Paris") == [1.0, 2.0] and geodata.zone_offsets("Asia/Shanghai") == [8.0] and geodata.zone_offsets("No/Where") == []
    rows = spark.createDataFrame([("Europe/Paris", 1.5), ("Europe/Paris", 5.0), ("x", 5.0), (None, 1.0)], "z string, h double").select(geodata.offset_fits("z", "h").alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, True, True]
    times = spark.sql("select timestamp'2024-07-01 12:00:00' as t").select(geodata.capture_utc(F.col("t"), F.lit("+03:00"), F.lit("Europe/Paris")), geodata.capture_utc(F.col("t"), F.lit(None), F.lit("Europe/Paris")), geodata.capture_utc(F.col("t"), F.lit(None), F.lit(None))).first()
    assert [t.hour for t in times] == [9, 10, 12]


def test_maker_notes():
    entry = struct.pack("<HHII", 0x00A7, 4, 1, 777)
    nikon = b"Nikon\0\x02\0\0\0" + b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + entry
    assert [r[1:3] for r in metadata.maker_note(nikon, ">")] == [("MakerNote:NikonShutterCount", "777")]
    canon = struct.pack(">H", 1) + struct.pack(">HHII", 0x0006, 2, 6, 20) + b"\0" * 6 + b"Canon\0"
    assert [r[1:3] for r in metadata.maker_note(canon, ">")] == [("MakerNote:CanonImageType", "Canon")]
    assert list(metadata.maker_note(b"\0\0garbage", "<")) == [] == list(metadata.maker_note(b"", "<"))


def test_tables():
    body = b"\0" + bytes(range(1, 65)) + b"\x11" + struct.pack(">64H", *range(1, 65))
    assert jpegtables.quantisation(body) == [(0, list(range(1, 65))), (1, list(range(1, 65)))] and jpegtables.quantisation(b"\0abc") == []
    counts = bytes(int(x) for x in jpegtables.STANDARD_COUNTS[0, 0].split())
    assert jpegtables.huffman(b"\0" + counts + bytes(range(12)))[0][4] is False
    assert jpegtables.huffman(b"\x10" + bytes([1] + [0] * 15) + b"a")[0][4] is True
    assert jpegtables.sampling(b"\x08\0\x10\0\x10\3\1\x22\0\2\x11\1\3\x11\1") == "4:2:0" and jpegtables.sampling(b"\x08\0\x10\0\x10\1\1\x11\0") == "grayscale"


def test_learning_entries(spark):
    one = lambda i, c: (i, "m", "s", "p", c, "4:2:0", encoders.scaled_table(80), None, ["SOI"] * 9, None, None, [], "indicative")
    seed = spark.createDataFrame([one("a", "x"), one("b", "x")], encoders.CORPUS_SCHEMA)
    out = {r["entry_id"]: (r["category"], len(r["segment_prefix"])) for r in encoders.learned(seed, spark.createDataFrame([one("b", "user"), one("c", "user")], encoders.CORPUS_SCHEMA)).collect()}
    assert out == {"a": ("x", 9), "b": ("user", 6), "c": ("user", 6)}


def test_reports(spark):
    records = spark.createDataFrame([("h1", "<b>.jpg", "X", "LOW", 0.5)], "sha256 string, file_name string, verdict_label string, risk_level string, confidence_score double")
    findings = spark.createDataFrame([("h1", k, 3, f"n{k}", "observed", "v") for k in range(9)], "sha256 string, ordinal long, tier int, name string, confidence string, value string")
    fields = spark.createDataFrame([("h1", k, f"f{k:02d}", "v") for k in range(20)], "sha256 string, ordinal long, name string, value_str string")
    text = reports.text_reports(records, findings, fields).first()["report"]
    assert text.count("  [3]") == 9 and "f14 = v" in text and "f15" not in text
    row = reports.dossier_rows(records, findings).first()["html"]
    assert "&lt;b&gt;.jpg" in row and "n5" in row and "n6" not in row
    page = reports.dossier("<t>", {"a": 1}, [row])
    assert "&lt;t&gt;" in page and "<script" not in page and "http" not in page
    points = spark.createDataFrame([(1, 1, 48.0, 2.0, "a & b"), (1, 2, 49.0, 3.0, "c"), (1, 3, 0.0, 0.0, "no")], "case_id long, ordinal long, lat double, lon double, name string").withColumn("ts", F.current_timestamp())
    doc = json.loads(reports.geojson_documents(points).first()["document"])
    assert [f["geometry"]["type"] for f in doc["features"]] == ["Point", "Point", "LineString"] and doc["bbox"] == [2.0, 48.0, 3.0, 49.0]
    kml = reports.kml_documents(points).first()["document"]
    assert len(ElementTree.fromstring(kml.encode())[0]) == 2
    assert len(ElementTree.fromstring(reports.gpx_documents(points).first()["document"].encode())) == 2
    assert zipfile.ZipFile(BytesIO(reports.kmz(kml))).namelist() == ["doc.kml"]
