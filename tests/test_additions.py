import json
import sqlite3
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from casegrain import __main__ as cli
from casegrain.operators import encoders, exports, places, records, reports, timeline
from casegrain.plans import casework, catalog, oracles
from casegrain.sources import files, geodata
from tests.test_containers import jpeg, png


def test_evidence_lists_before_it_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jpg").write_bytes(jpeg())
    (tmp_path / "in" / "deep" / "b.png").write_bytes(png())
    (tmp_path / "in" / "deep" / "c.txt").write_bytes(b"text")
    (tmp_path / "in" / "large.jpg").write_bytes(jpeg() + b"\0" * 5000)
    monkeypatch.setattr(files, "MOST_BYTES", 4000)
    targets = [str(tmp_path / "in"), str(tmp_path / "in" / "deep"), str(tmp_path / "in" / "deep" / "c.txt"), str(tmp_path / "in" / "*.jpg")]
    rows = files.evidence(spark, targets)
    got = {r["path"].rpartition("/")[2]: r for r in rows.collect()}
    assert sorted(got) == ["a.jpg", "b.png", "c.txt", "large.jpg"] and rows.count() == 4
    assert got["large.jpg"]["content"] is None and "more than" in got["large.jpg"]["error"] and got["a.jpg"]["error"] is None
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert files.events(rows).where("event = 'unit'").select("sha256").distinct().count() == 2
    case = casework.opened(rows)
    assert casework.findings(case, (1, 3, 4, 6)).count() > 0
    case.close()
    assert not case.held
    with pytest.raises(FileNotFoundError):
        files.evidence(spark, [str(tmp_path / "missing")])


def test_events_are_in_order_of_paths(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k:02d}.jpg").write_bytes(jpeg() + str(k).encode())
    rows = casework.events(casework.opened(files.evidence(spark, [str(tmp_path)]))).orderBy("ordinal").collect()
    assert [r["file_name"] for r in rows] == [f"{k:02d}.jpg" for k in range(12)]


def test_inversions_across_slices(spark):
    rows = [("c", f"IMG_{k:08d}", 1000 - k if k % 100 == 0 else 1000 + k) for k in range(25_000, 25_400)] + [("d", None, 5), ("d", "a", 4), ("d", "ab", 3)]
    table = spark.createDataFrame(rows, "case_id string, name string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = timeline.inversions(table, "name").collect()
    assert sorted(r["name"] for r in got) == sorted(["IMG_00025100", "IMG_00025200", "IMG_00025300", "a", "ab"])


def test_places_of_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"places": [{"name": "A", "lat": 1, "lon": 2, "country_code": "xx", "timezone": "Z/A"}, {"name": "", "lat": 1, "lon": 1}]}')
    (row,) = geodata.geonames(spark, str(tmp_path / "g.json")).collect()
    assert (row["name"], row["lat"], row["lon"], row["country_code"], row["timezone"]) == ("A", 1.0, 2.0, "XX", "Z/A")
    base = sqlite3.connect(tmp_path / "n.sqlite")
    base.execute("create table ne_10m_populated_places (name, adm0name, iso_a2, adm1name, latitude, longitude, timezone, pop_max, featurecla)")
    base.executemany("insert into ne_10m_populated_places values (?,?,?,?,?,?,?,?,?)", [("P", "Land", "-99", "R", 1.5, 2.5, "Z/P", 10, "city"), ("Q", "Land", "QQ", None, None, 1.0, None, None, None)])
    point = lambda lat, lon: b"\x01" + struct.pack("<Idd", 1, lon, lat)
    base.execute("create table ne_10m_airports (name, name_en, iata_code, gps_code, type, GEOMETRY)")
    base.executemany("insert into ne_10m_airports values (?,?,?,?,?,?)", [("X", None, "-99", "GXXX", None, point(3, 4)), ("Y Airport", None, "YYY", None, "major", None)])
    base.execute("create table ne_10m_ports (name, featurecla, website, GEOMETRY)")
    base.executemany("insert into ne_10m_ports values (?,?,?,?)", [("Port Z", None, None, point(5, 6)), ("W", "Port", None, point(7, 8))])
    base.commit()
    base.close()
    (place,) = geodata.sqlite_places(spark, str(tmp_path / "n.sqlite")).collect()
    assert (place["name"], place["country_code"], place["lat"], place["population"]) == ("P", None, 1.5, 10)
    rows = sorted(map(tuple, geodata.sqlite_facilities(spark, str(tmp_path / "n.sqlite")).collect()))
    assert rows == [("airport", "X Airport", "GXXX", "airport", 3.0, 4.0), ("port", "Port Z", "", "seaport", 5.0, 6.0), ("port", "Port of W", "", "Port", 7.0, 8.0)]
    ordered = places.in_order(spark.createDataFrame([("b", "r", "n"), ("a", None, "z"), ("a", "q", "y")], "country string, admin1 string, name string")).collect()
    assert [r["name"] for r in ordered] == ["z", "y", "n"]


def test_pages_and_maps(spark, monkeypatch):
    one = spark.createDataFrame([("s", "<b>.jpg", "X", "LOW", 0.5)], "sha256 string, file_name string, verdict_label string, risk_level string, confidence_score double")
    found = spark.createDataFrame([("s", 0, 3, "n<", "derived", "c", "v")], "sha256 string, ordinal long, tier int, name string, confidence string, caveat string, value string")
    fields = spark.createDataFrame([("s", k, "EXIF", f"f{k}", "v", "ASCII", "0x1") for k in range(20)], "sha256 string, ordinal long, standard string, name string, value_str string, value_type string, tag_id string")
    page = reports.html_records(one, found, fields).first()["html"]
    assert "&lt;b&gt;.jpg" in page and "<b>" not in page and page.count("<tr>") == 4 + 2 + 1 + 20 and "http" not in page
    monkeypatch.setattr(exports, "PART_POINTS", 2)
    points = spark.createDataFrame([("c", k, 10.0 + k, 20.0 + k, f"p{k}") for k in range(5)], "case_id string, ordinal long, lat double, lon double, name string").withColumn("ts", F.timestamp_seconds("ordinal"))
    maps = {r["part"]: r["document"] for r in reports.map_documents(points).collect()}
    assert sorted(maps) == [0, 1, 2] and maps[0].count("<circle") == 2 and maps[2].count("<circle") == 1
    for made in (reports.geojson_documents, reports.kml_documents, reports.gpx_documents):
        assert made(points).count() == 3


def test_corpus_in_blocks(spark, monkeypatch):
    corpus = spark.createDataFrame([(f"e{k}", "d", "s", "p", "c" if k % 2 else "x", "4:2:0", encoders.scaled_table(50 + k), encoders.scaled_table(50 + k, True), ["SOI"], "standard", "SOF0", [], "i") for k in range(10)], encoders.CORPUS_SCHEMA)
    prints = spark.createDataFrame([(k, encoders.scaled_table(50 + k), None, ["SOI"], "4:2:0", False, "SOF0") for k in range(3)], "print_id long, lum array<int>, chrom array<int>, segments array<string>, subsampling string, optimized boolean, sof string")
    whole = sorted(map(tuple, encoders.candidates(prints, corpus).collect()))
    monkeypatch.setattr(encoders, "BLOCK_ENTRIES", 3)
    assert sorted(map(tuple, encoders.candidates(prints, corpus).collect())) == whole and len(whole) == 30
    assert [r["entry_id"] for r in encoders.entries_of(corpus, "x").collect()] == ["e0", "e2", "e4", "e6", "e8"] and encoders.entry(corpus, "e3").count() == 1
    assert encoders.candidates(prints, corpus.limit(0)).count() == 0


def test_tables_of_a_segment_and_restart_interval(spark):
    counts = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
    body = b"\x00" + counts + bytes(12) + b"\x11" + bytes([1] + [0] * 15) + b"\x07"
    rows = [("s", 0, "DQT", b"\0" + bytes([9]) * 64), ("s", 1, "DHT", body), ("s", 2, "DRI", b"\x01\x02"), ("t", 0, "DQT", b"\0" + bytes([9]) * 64)]
    units = spark.createDataFrame(rows, "sha256 string, ordinal int, name string, payload binary")
    got = {r["print_id"]: r for r in casework.quant_of({"units": units}).collect()}
    assert got["s"]["restart"] == 258 and [t["key"] for t in got["s"]["dht"]] == [0, 17] and got["s"]["optimized"] and got["t"]["dht"] is None
    marks = {r["sha256"]: r["value"] for r in casework.tier2({"units": units}).collect()}
    assert marks["s"] != marks["t"]


def test_repaired_json(spark):
    texts = ['```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} it is', "{broken", "", "[1]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", records.repaired_json(F.col("t")).alias("j")).orderBy("n").collect()
    assert [r["j"] for r in rows] == ['{"a": 1}', '{"a": {"b": 2}}', '{"raw_response":"{broken"}', '{"raw_response":""}', "[1]"]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(jpeg() + b"\0\0\0\x18ftypmp42" + bytes(40))
    out = str(tmp_path / "out")
    assert cli.main(["motion", str(tmp_path / "in"), "--out", out]) == 0
    assert spark.read.parquet(f"{out}/clips").first()["kind"] == "clip_mp4"
    assert cli.main(["scope", "--case", "C1", "--purpose", "p", "--legal-basis", "l", "--party", "a", "--secret", "k", "--out", out]) == 0
    text = spark.read.parquet(f"{out}/scope").first()["value"]
    (tmp_path / "scope.json").write_text(text)
    assert cli.main(["scope", str(tmp_path / "scope.json"), "--secret", "k", "--out", out]) == 0
    assert cli.main(["scope", str(tmp_path / "scope.json"), "--secret", "wrong", "--out", out]) == cli.EXIT_SCOPE
    (tmp_path / "skills" / "bad").mkdir(parents=True)
    assert cli.main(["skill", str(tmp_path / "skills"), "--out", out]) == 0
    assert spark.read.parquet(f"{out}/skills").first()["error"]
    assert cli.main(["probe", str(tmp_path / "nothing"), "--out", out]) == cli.EXIT_USAGE
    (tmp_path / "log.jsonl").write_text("no JSON\n")
    assert cli.main(["audit", str(tmp_path / "log.jsonl"), "--out", out]) == cli.EXIT_CUSTODY
    assert cli.main(["diff", str(tmp_path / "in"), "--out", out]) == 0
    assert spark.read.parquet(f"{out}/verdict").first()["verdict"] == "EXACT_BITWISE_MATCH"


def test_line_of_a_case_of_many_parts(spark, monkeypatch, tmp_path):
    """A case has one line however its ordinals are parted, and its parts' rows join up."""
    monkeypatch.setattr(exports, "PART_POINTS", 10)
    at = {("a", 1), ("a", 4), ("a", 10), ("a", 30), ("a", 31), ("b", 5), ("b", 15), ("c", 7), ("d", 3), ("d", 2)}
    points = spark.createDataFrame([(c, k, float(k), 100.0 + k) for c, k in at] + [("c", 50, 0.0, 0.0)], "case_id string, ordinal long, lat double, lon double")
    lines = {}
    for r in exports.geojson_features(points).where("ordinal is null").orderBy("case_id", "part").collect():
        lines.setdefault(r["case_id"], []).append([x[1] for x in json.loads(r["geometry"])["coordinates"]])
    assert lines == {"a": [[1, 4], [4, 10], [10, 30, 31]], "b": [[5, 15]], "d": [[2, 3]]}
    events = spark.range(60).selectExpr("id as event_id", "id % 4 as user_id", "timestamp_seconds(id) as ts", "'x' as event_type", "1.0D as value")
    events.union(spark.range(1).selectExpr("200L", "9L", "timestamp_seconds(0)", "'x'", "1.0D")).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.execute(f"select case_id, n_points, n_lines from ({oracles.ORACLES['geojson_features']})").fetchall())
    assert sorted(map(tuple, catalog.QUERIES["geojson_features"](spark, str(tmp_path)).select("case_id", "n_points", "n_lines").collect())) == want and len(want) == 5
