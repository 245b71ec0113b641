"""Files to findings and verdicts, artefacts, cleaning, streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from casegrain.operators import artefacts
from casegrain.plans import casework, derive
from casegrain.sources import files
from casegrain.streaming import ingest
from tests.test_containers import chunk, exif_block, jpeg, png, seg


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("case")
    (out / "a.jpg").write_bytes(jpeg())
    (out / "b.jpg").write_bytes(jpeg(b"PK\x03\x04secret"))
    (out / "c.png").write_bytes(png(chunk(b"tEXt", b"Software\0GIMP"), chunk(b"IDAT", b"xyz")))
    (out / "d.jpg").write_bytes(png())  # by its suffix it should be a JPEG
    (out / "note.txt").write_bytes(b"not listed")
    (out / "cut.jpg").write_bytes(jpeg()[:90])
    return out


@pytest.fixture(scope="module")
def case(spark, folder):
    return casework.opened(files.evidence(spark, [str(folder)]), corpus=derive.corpus(spark))


def test_listing(spark, folder):
    rows = {r["path"].rpartition("/")[2]: r for r in files.evidence(spark, [str(folder)]).drop("content").collect()}
    assert set(rows) == {"a.jpg", "b.jpg", "c.png", "d.jpg", "cut.jpg"}
    assert rows["d.jpg"]["format"] == "PNG" and rows["d.jpg"]["extension_mismatch"] and not rows["a.jpg"]["extension_mismatch"]
    assert files.evidence(spark, [str(folder / "note.txt")]).count() == 1


def test_tables(case):
    names = {r["name"] for r in case["units"].collect()}
    assert {"SOI", "DQT", "TRAILING_DATA", "IHDR"} <= names
    fields = {(r["name"], r["value_str"]) for r in case["fields"].collect()}
    assert ("Make", "Canon") in fields and ("png:Software", "GIMP") in fields
    assert any("cut short" in r["message"] for r in case["diagnostics"].collect())


def test_findings_and_verdicts(case, folder):
    sha = lambda n: hashlib.sha256((folder / n).read_bytes()).hexdigest()
    found = casework.findings(case)
    names = {}
    for r in found.collect():
        names.setdefault(r["sha256"], {})[r["name"]] = r
        assert r["confidence"] == "observed" or r["caveat"]
    a, b = names[sha("a.jpg")], names[sha("b.jpg")]
    assert {"exif_make", "gps_coordinates_claimed", "encoder_composite_fingerprint", "encoder_attribution", "file_sha256", "metadata_status"} <= set(a)
    assert '"latitude":-48.5,"longitude":2.01' in a["gps_coordinates_claimed"]["value"]
    assert "trailing_data_detected" in b and "ZIP_ARCHIVE" in b["trailing_data_detected"]["value"]
    assert a["image_data_stream_sha256"]["value"] == b["image_data_stream_sha256"]["value"]
    labels = {r["sha256"]: r["verdict_label"] for r in casework.verdicts(case, found).collect()}
    assert labels[sha("b.jpg")] == "TAMPERED_TRAILING_PAYLOAD" and labels[sha("a.jpg")] != labels[sha("b.jpg")]
    assert {r["tier"] for r in casework.findings(case, (4,)).collect()} == {4}


def test_registered_analyser_and_invariants(case):
    casework.register("sizes", 3, lambda c: casework.finding(c["files"], 3, "size", "observed", "sizes", F.col("length")))
    try:
        assert casework.findings(case, (3,)).where("name = 'size'").count() == 5
    finally:
        casework.ANALYSERS.clear()
    with pytest.raises(ValueError):
        casework.finding(case["files"], 3, "x", "derived", "x", F.lit(1))
    with pytest.raises(ValueError):
        casework.register("x", 9, lambda c: c["files"])


def test_cleaning():
    dirty = jpeg(b"trail")
    clean = artefacts.cleaned("JPEG", dirty)
    assert b"Canon" not in clean and b"\xff\xdb" in clean and clean.endswith(b"\xff\xd9") and b"\x12\xff\0\x34" in clean
    kept = artefacts.cleaned("PNG", png(chunk(b"tEXt", b"A\0b"), chunk(b"IDAT", b"d")))
    assert b"tEXt" not in kept and b"IHDR" in kept and b"IDAT" in kept
    body = b"VP8X" + (10).to_bytes(4, "little") + b"\x2c" + b"\0" * 9 + b"EXIF" + (4).to_bytes(4, "little") + b"II*\0"
    webp = artefacts.cleaned("WEBP", b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body)
    assert b"EXIF" not in webp and webp[20] == 0 and int.from_bytes(webp[4:8], "little") == len(webp) - 8
    assert artefacts.cleaned("JPEG", dirty[:60]) is None and artefacts.cleaned("GIF", b"GIF89a") is None


def test_extraction(spark, folder):
    clip = jpeg() + b"\0\0\0\x18ftypmp42" + b"movie"
    (folder / "motion.jpg").write_bytes(clip)
    try:
        rows = artefacts.extract(files.evidence(spark, [str(folder / "motion.jpg")])).collect()
    finally:
        (folder / "motion.jpg").unlink()
    found = {r["kind"]: bytes(r["content"]) for r in rows}
    assert found["clip_mp4"].startswith(b"\0\0\0\x18ftyp") and found["block_exif"] == exif_block()
    assert artefacts.clip(b"\0" * 30 + b"ftypqt  ") == (26, "mov")
    names = spark.createDataFrame([("../../etc/pass wd", 255), ("...", 1)], "n string, o long").select(artefacts.carved_name(F.col("n"), F.col("o"), F.lit("ZIP_ARCHIVE")).alias("x")).collect()
    assert [r["x"] for r in names] == ["pass_wd_carved_0xff.zip", "unnamed_carved_0x1.zip"]


def test_custody(spark, folder, tmp_path):
    from casegrain.operators import audit

    rows = files.evidence(spark, [str(folder)])
    stored = files.store(rows, str(tmp_path / "store")).select("sha256", "path")
    assert spark.read.parquet(str(tmp_path / "store")).count() == rows.select("sha256").distinct().count()
    assert audit.custody_faults(stored, rows.select("path", "content")).count() == 0
    (folder / "c.png").write_bytes(png())
    again = spark.read.format("binaryFile").load(str(folder / "*.png")).select("path", "content")
    assert [r["path"].rpartition("/")[2] for r in audit.custody_faults(stored.where("path like '%.png'"), again).collect()] == ["c.png"]
    (folder / "c.png").write_bytes(png(chunk(b"tEXt", b"Software\0GIMP"), chunk(b"IDAT", b"xyz")))


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"\xff\xd8" + seg(0xFE, b"hi") + b"\xff\xd9")
    query = ingest.into_tables(ingest.new_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out/units")).orderBy("ordinal").collect()] == ["SOI", "COM", "EOI"]


def test_speed_stream_equals_batch(spark, tmp_path):
    from casegrain.operators import timeline

    fixes = derive.fixes(spark, "/root/testdata/sf0.001").select("case_id", "ordinal", "ts", "lat", "lon")
    fixes.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ingest.FIXES).parquet(str(tmp_path / "in"))
    query = ingest.speeds(stream).writeStream.format("memory").queryName("speeds").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    want = {r["ordinal"]: (r["speed_kmh"], r["kinematic_anomaly"]) for r in timeline.kinematics(fixes).collect()}
    got = {r["ordinal"]: (r["speed_kmh"], r["anomaly"]) for r in spark.sql("select * from speeds").collect()}
    assert set(got) == set(want)
    for k, (speed, anomaly) in want.items():
        assert got[k][1] == anomaly and (speed is None) == (got[k][0] is None)
        assert speed is None or abs(got[k][0] - speed) < 0.06


def test_event_windows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = ingest.counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert spark.sql("select sum(n) from windows").first()[0] > 900
