"""Rasters, ciphers, audit logs and small functions."""

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrain.functions import bits, cipher, geo, raster
from casegrain.operators import audit, encoders

RNG = np.random.default_rng(3)


def picture(n=64):
    y, x = np.indices((n, n))
    return np.stack([x * 255 // n, y * 255 // n, (x + y) * 127 // n], axis=2).astype(np.uint8)


def test_streams_and_maps_are_undone():
    noise = RNG.integers(0, 256, (13, 9, 4), dtype=np.uint8)
    again = cipher.streamed(cipher.streamed(noise, "key"), "key")
    assert (again == noise).all() and (cipher.streamed(noise, "key")[:, :, 3] == noise[:, :, 3]).all()
    assert cipher.seed_of("seed:0x10") == 16
    scrambled = cipher.cat_map(noise[:, :, :3], 7)
    assert (cipher.cat_map(scrambled, 7, inverse=True, size=(13, 9)) == noise[:, :, :3]).all()
    with pytest.raises(ValueError):
        cipher.cat_map(noise, 1001)


def test_known_values():
    assert cipher.string_hash("a") == [1417665536, 2687711804, 906941787, 3259118439]
    assert cipher.keystream(1, 3).dtype == np.uint8 and len(cipher.keystream(7, 1000)) == 1000


def test_hidden_payloads():
    own = picture()
    hidden = cipher.hide(own, b"hello")
    assert cipher.found_hidden(hidden) == (0, b"hello") and cipher.found_hidden(own) is None
    assert np.abs(hidden.astype(int) - own).max() <= 1
    with pytest.raises(ValueError):
        cipher.hide(own[:4, :4], b"x" * 100)
    assert cipher.after_last_end(b"\xff\xd8..\xff\xd9in\xff\xd9out") == (10, b"out")


def test_containers(spark):
    key = cipher.derived_key("pw", b"s" * 16)
    df = spark.createDataFrame([(bytearray(b"content"),)], "c binary").select(cipher.sealed(F.col("c"), F.lit(key), F.lit(b"s" * 16), F.lit(b"i" * 12)).alias("x"))
    row = df.select(cipher.is_sealed(F.col("x")), cipher.opened(F.col("x"), "pw"), cipher.opened(F.col("x"), "no")).first()
    assert row[0] and bytes(row[1]) == b"content" and row[2] is None


def test_dictionary_recovery(spark):
    noisy = cipher.streamed(picture(), "swordfish")
    words = cipher.candidates([spark.createDataFrame([("alpha", 0), ("beta", 1)], "candidate string, place int"), spark.createDataFrame([("beta", 0), ("swordfish", 1), ("", 2)], "candidate string, place int")])
    assert [r["candidate"] for r in words.orderBy("ordinal").collect()] == ["alpha", "beta", "swordfish"]
    assert [r["candidate"] for r in cipher.recovered(words, noisy).collect()] == ["swordfish"]


def test_hashes_of_pictures():
    own = np.kron(RNG.integers(0, 240, (8, 8, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8))
    brighter = np.clip(own.astype(int) + 9, 0, 255).astype(np.uint8)
    for fn in (raster.average_hash, raster.difference_hash, raster.perceptual_hash):
        assert len(fn(own)) == 16 and bin(int(fn(own), 16) ^ int(fn(brighter), 16)).count("1") <= 8
    assert bin(int(raster.perceptual_hash(own), 16) ^ int(raster.perceptual_hash(RNG.integers(0, 256, (64, 64, 3), dtype=np.uint8)), 16)).count("1") > 12


def test_statistics_of_pictures():
    own, noise = picture(128), RNG.integers(0, 256, (128, 128, 3), dtype=np.uint8)
    assert raster.scrambled(noise)["encrypted"] and not raster.scrambled(own)["encrypted"]
    assert raster.difference(own, own)["identical"] and raster.difference(own, noise)["altered_pct"] > 90
    assert not raster.difference(own, noise[:5])["comparable"]
    grid = own.copy()
    grid[::2, ::2] = 255
    assert raster.spectrum_peak(grid)["ratio"] > raster.spectrum_peak(noise)["ratio"]
    assert raster.last_bits(np.zeros((8, 8, 3), np.uint8))["anomaly"] and not raster.last_bits(noise)["anomaly"]
    even = noise & 0xFE | RNG.integers(0, 2, noise.shape, dtype=np.uint8)
    assert raster.pairs_of_values(np.tile(even, (4, 4, 1)) * 0 + 7)[0]["dof"] == 1
    assert raster.bit_planes(noise)[0][0][1] > 0.99
    assert raster.error_level(own)["max"] >= 0 and raster.ghost(own)["spread"] >= 0 and not raster.ghost(own[:8, :8])["suspected"]
    copied = RNG.integers(0, 256, (256, 256, 3), dtype=np.uint8)
    copied[160:224, 160:224] = copied[16:80, 16:80]
    assert raster.copy_move(copied)[0][:2] == (144, 144) and raster.copy_move(noise) == []
    assert raster.from_image(bytes([1, 2, 3]), 1, 1, 3).tolist() == [[[3, 2, 1]]]
    assert 0 <= raster.mosaic(noise)["energy"] <= 1


def test_quality_of_scaled_tables(spark):
    rows = spark.createDataFrame([(q, encoders.scaled_table(q), encoders.scaled_table(q, True)) for q in (20, 50, 75, 90)], "q int, l array<int>, c array<int>")
    for r in rows.select("q", encoders.estimated_quality(F.col("l"), F.lit(False)).alias("a"), encoders.estimated_quality(F.col("c"), F.lit(True)).alias("b")).collect():
        assert abs(r["a"] - r["q"]) <= 2 and abs(r["b"] - r["q"]) <= 2


def test_corpus_rows_are_checked(spark, tmp_path):
    good = {"id": "a", "device_model": "m", "category": "c", "dqt_luminance_sample": encoders.scaled_table(80), "segment_prefix": ["SOI"], "disambiguation_signals": {"dht_type": "optimized"}}
    (tmp_path / "c.json").write_text(json.dumps({"entries": [good, good | {"id": "b", "dqt_luminance_sample": [1, 2]}, good | {"id": "c", "dqt_luminance_sample": [0] * 64}]}))
    rows = encoders.read_corpus(spark, str(tmp_path / "c.json")).collect()
    assert [(r["entry_id"], r["dht_type"]) for r in rows] == [("a", "optimized")]


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    log = audit.Writer(path)
    threads = [threading.Thread(target=lambda k=k: [log.append("read", n=k) for _ in range(10)]) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    audit.Writer(path).append("last")
    lines = open(path).read().splitlines()
    frame = lambda ls: spark.createDataFrame(list(enumerate(ls)), "ordinal long, value string")
    assert len(lines) == 81 and audit.chain_faults(audit.hashed_entries(frame(lines))).count() == 0
    changed = lines[:2] + [lines[2].replace('"read"', '"write"')] + lines[3:]
    first = audit.chain_faults(audit.hashed_entries(frame(changed))).orderBy("position").first()
    assert (first["position"], first["reason"]) == (2, "content")
    assert audit.chain_faults(audit.hashed_entries(frame(lines[:5] + ["{bad"]))).first()["reason"] == "unreadable"
    assert audit.chain_faults(audit.hashed_entries(frame(lines[:3] + lines[4:]))).orderBy("position").first()["reason"] == "index"
    assert audit.verified("t", b"k", audit.signed("t", b"k")) and not audit.verified("t", b"k2", audit.signed("t", b"k"))


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(geo.dms_text(F.lit(48.83), F.lit(-76.9589))) == "48°49'48.0\"N, 76°57'32.0\"W"
    assert one(geo.nominal_zone(F.lit(-76.0))) == "Etc/GMT-5" and one(geo.pair_text(F.lit(1.5), F.lit(2.0))) == "1.500000, 2.000000"
    assert one(geo.map_urls(F.lit(1.0), F.lit(2.0)))["google_maps"] == "https://www.google.com/maps?q=1.000000,2.000000"
    assert one(bits.hex_hamming(F.lit("ffffffffffffffff"), F.lit("fffffffffffffff0"))) == 4
    assert one(bits.unsigned(F.lit(bytes(range(10))), 0, 4)) == 0x00010203 and one(bits.unsigned(F.lit(bytes(range(10))), 0, 2, little=True)) == 0x0100
    assert one(bits.unsigned(F.lit(b"a"), 0, 2)) is None
    assert [one(bits.severity(F.lit(c))) for c in ("observed", "INCONCLUSIVE", "x")] == [1, 4, 5]


def test_places_from_lines(spark):
    from casegrain.operators import places

    lines = ['{"type":"Feature","properties":{"name":"A","country_code":"fr"},"geometry":{"coordinates":[2.0,48.0]}}', '{"name":"B","lat":"1.5","lng":2}', '{"names":{"primary":"C"},"latitude":3,"longitude":4}', '{"name":"no place"}', "{bad"]
    rows = places.parse_places(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["name"], r["country_code"], r["lat"], r["lon"]) for r in rows] == [("A", "FR", 48.0, 2.0), ("B", None, 1.5, 2.0), ("C", None, 3.0, 4.0)]
