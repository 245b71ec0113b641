import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrain import __main__ as cli
from casegrain.functions import cipher, raster
from casegrain.plans import casework
from casegrain.sources import files, pictures

RNG = np.random.default_rng(9)
OWN = np.kron(RNG.integers(0, 255, (16, 16, 3), dtype=np.uint8), np.ones((4, 4, 1), np.uint8))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("pictures")
    (out / "a.png").write_bytes(pictures.png(OWN))
    (out / "noise.png").write_bytes(pictures.png(RNG.integers(0, 256, (64, 64, 3), dtype=np.uint8)))
    (out / "hidden.png").write_bytes(pictures.png(cipher.hide(OWN, b"secret")))
    return out


def test_round_trip(spark, folder):
    rows = pictures.decoded(spark, [str(folder)])
    got = {r["path"].rpartition("/")[2]: raster.from_image(bytes(r["image"]["data"]), r["image"]["height"], r["image"]["width"], r["image"]["nChannels"]) for r in rows.collect()}
    assert (got["a.png"] == OWN).all() and cipher.found_hidden(got["hidden.png"]) == (0, b"secret")
    seen = rows.where("path like '%a.png'").select(pictures.pixel(F.col("image"), 3, 5).alias("p"), pictures.pixel(F.col("image"), 99, 0).alias("q")).first()
    assert seen["p"] == OWN[3, 5].tolist() and seen["q"] is None


def test_pixel_findings(spark, folder):
    own = files.evidence(spark, [str(folder)])
    images = pictures.decoded(spark, [str(folder)]).join(own.select("path", "sha256"), "path").select("sha256", "image")
    case = casework.opened(own, images=images)
    names = {r["path"].rpartition("/")[2]: r["sha256"] for r in own.select("path", "sha256").collect()}
    found = casework.findings(case, (4, 7))
    values = {(r["sha256"], r["name"]): r["value"] for r in found.collect()}
    assert values[names["a.png"], "image_dimensions"] == "64x64"
    assert raster.perceptual_hash(OWN) in values[names["a.png"], "perceptual_hashes"]
    assert '"encrypted":true' in values[names["noise.png"], "encrypted_or_scrambled_image"]
    labels = {r["sha256"]: r["verdict_label"] for r in casework.verdicts(case, found).collect()}
    assert labels[names["noise.png"]] == "ENCRYPTED_OR_SCRAMBLED_CARRIER" != labels[names["a.png"]]


def test_commands(spark, folder, tmp_path):
    out = str(tmp_path)
    assert cli.main(["encrypt", str(folder), "--password", "pw", "--out", out]) == 0
    assert cli.main(["decrypt", f"{out}/sealed", "--password", "pw", "--out", out]) == 0
    back = {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in spark.read.parquet(f"{out}/opened").collect()}
    assert back["a.png"] == (folder / "a.png").read_bytes()
    assert cli.main(["stego", str(folder), "--out", out]) == 0 and spark.read.parquet(f"{out}/stego").count() == 3
    assert cli.main(["cluster", str(folder), "--strategy", "visual", "--pixels", "--out", out]) == 0
    ids = {r["ordinal"]: r["cluster_id"] for r in spark.read.parquet(f"{out}/clusters").collect()}
    assert ids[1] == ids[2] != ids[3]
    (tmp_path / "p.ndjson").write_text('{"name":"B","lat":1.5,"lng":2}\n{"name":"b ","lat":1.501,"lng":2}\n')
    assert cli.main(["geo", str(tmp_path / "p.ndjson"), "--out", out]) == 0 and spark.read.parquet(f"{out}/places").count() == 1
    assert cli.main(["doctor", "--out", out]) == 0
