import pytest

from casegrain import bus, skills
from casegrain.functions import cipher
from casegrain.operators import audit, records
from casegrain.plans import casework
from casegrain.sources import files
from tests.test_containers import jpeg, png


def test_bus(tmp_path):
    own, seen = bus.Bus(), []
    own.subscribe(bus.Message, lambda m: seen.append(("any", type(m).__name__)), 200)
    own.subscribe(bus.VerdictGiven, lambda m: seen.append(("verdict", m.label)), 10)
    own.subscribe(bus.VerdictGiven, lambda m: 1 / 0, 20)
    own.audit_to(audit.Writer(str(tmp_path / "log")))
    own.publish(bus.VerdictGiven(label="X"))
    own.publish(bus.CaseOpened())
    assert seen == [("verdict", "X"), ("any", "VerdictGiven"), ("any", "CaseOpened")]
    assert len((tmp_path / "log").read_text().splitlines()) == 2


def test_skills(spark, tmp_path):
    code = "from pyspark.sql import functions as F\nfrom casegrain.plans.casework import finding\ndef analyse(case):\n    return finding(case['files'], 6, 'length', 'observed', 'skill', F.col('length'))\n"
    for name, manifest in (("good", "name: good\ntarget_tier: 6\nsupported_formats: [PNG]\n# note\n"), ("bad", "name: bad\nentry_point: ../good/skill.py:analyse\n"), ("broken", "name: broken\ntarget_tier: 9\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "skill.yaml").write_text(manifest)
        (tmp_path / name / "skill.py").write_text(code)
    (tmp_path / "none").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(jpeg())
    (tmp_path / "in" / "b.png").write_bytes(png())
    try:
        loaded, wrong = skills.discover([tmp_path, tmp_path / "missing"])
        assert [m.name for m in loaded] == ["good"] and len(wrong) == 4
        found = casework.findings(casework.opened(files.evidence(spark, [str(tmp_path / "in")])), (6,))
        assert found.where("name = 'length'").count() == 1
    finally:
        casework.ANALYSERS.clear()


def test_repository(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "sha256 string, v int")
    now = records.saved(old, spark.createDataFrame([("b", 2), ("c", 2)], "sha256 string, v int"))
    assert sorted(map(tuple, now.collect())) == [("a", 1), ("b", 2), ("c", 2)] and records.get(now, "b").first()["v"] == 2
    assert records.page(now, 1, 1).first()["sha256"] == "b" and records.without(now, old).count() == 1


def test_candidates_in_order(spark):
    words = cipher.candidates(cipher.usual_sources(spark, "/x/encrypted-cat.png", ["0001", "zed"], spark.createDataFrame([("dog",), ("admin",)], "value string")))
    first = [r["candidate"] for r in words.orderBy("ordinal").collect()]
    assert first[:5] == ["cat", "encrypted-cat.png", "encrypted-cat", "0001", "zed"]
    assert first.index("admin") < first.index("dog") < first.index("0000") and first.count("0001") == 1
    with pytest.raises(ValueError):
        cipher.cat_map(__import__("numpy").zeros((2, 2, 3)), -1)
