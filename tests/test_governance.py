import json
from datetime import UTC, datetime

import pytest

from casegrain import __main__ as cli
from casegrain import governance as gov
from tests.test_containers import jpeg

GOOD = gov.Scope("c", "p", "l", "a", ["x", "b"], ["tier1"], 30, "2099-01-01T00:00:00Z", ["tier7_content"])


def test_scopes():
    text = gov.dump(GOOD, "k")
    assert gov.load(text, "k") == GOOD and gov.load(gov.dump(GOOD)) == GOOD
    data = json.loads(text)
    for bad, secret in ((data | {"purpose": "q"}, None), (data | {"signature": "0"}, "k"), (data, "other"), (data | {"expiry_date": "2001-01-01", "scope_hash": None}, None), (data | {"is_self_audit": True}, None), ({"case_id": "c"}, None)):
        with pytest.raises(gov.ScopeError):
            gov.load(json.dumps(bad), secret)
    with pytest.raises(gov.ScopeError):
        gov.load("{")
    assert GOOD.permits("exif", 1) and not GOOD.permits("exif", 2) and not GOOD.permits("tier7_content", 7)
    assert gov.self_audit().permits("anything", 5) and not GOOD.expired(datetime(2098, 1, 1, tzinfo=UTC))
    with pytest.raises(gov.Refused):
        gov.check_capabilities(["Stalking"])


@pytest.mark.parametrize("command,table", [("probe", "files"), ("timeline", "plaso"), ("locate", "points"), ("cluster", "clusters"), ("diff", "verdict"), ("export", "stix"), ("extract", "artefacts"), ("clean", "cleaned")])
def test_commands(spark, tmp_path, command, table):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(jpeg())
    (tmp_path / "in" / "b.jpg").write_bytes(jpeg(b"tail"))
    assert cli.main([command, str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--tiers", "1,3,6"]) == 0
    rows = spark.read.parquet(str(tmp_path / "out" / table)).collect()
    assert rows
    if command == "diff":
        assert rows[0]["verdict"] == "METADATA_ONLY_MODIFICATION"


def test_a_bad_scope_stops(tmp_path):
    (tmp_path / "s.json").write_text("{}")
    assert cli.main(["probe", str(tmp_path), "--scope", str(tmp_path / "s.json")]) == cli.EXIT_SCOPE
