"""Each query with oracle SQL gives the same rows as DuckDB does; the others are held against plain code."""

import math
import os
import re

import duckdb
import pytest

from casegrain.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, float | int):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(oracles.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str) == want


def leaders(rows, near):
    """The first item that is near and leads takes an item."""
    out, leads = {}, []
    for i, v in rows:
        lead = None if v is None else next((k for k, w in leads if near(w, v)), i)
        if v is not None and lead == i:
            leads.append((i, v))
        out[i] = lead
    return out


def test_cluster_visual(spark):
    from casegrain.plans import derive

    cases = {}
    for r in derive.hashes(spark, SF).orderBy("id").collect():
        cases.setdefault(r["case_id"], []).append((r["id"], r["hash"]))
    want = {i: lead for rows in cases.values() for i, lead in leaders(rows, lambda a, b: bin(a ^ b).count("1") <= 5).items()}
    assert {r["ordinal"]: r["leader"] for r in catalog.QUERIES["cluster_visual"](spark, SF).collect()} == want


def test_cluster_geo(spark):
    from casegrain.plans import derive
    from casegrain.streaming.ingest import _km

    cases = {}
    for r in derive.fixes(spark, SF).orderBy("ordinal").collect():
        ok = r["lat"] is not None and abs(r["lat"]) <= 90 and abs(r["lon"]) <= 180 and (r["lat"], r["lon"]) != (0, 0)
        cases.setdefault(r["case_id"], []).append((r["ordinal"], (0, r["lat"], r["lon"]) if ok else None))
    want = {i: lead for rows in cases.values() for i, lead in leaders(rows, lambda a, b: _km(a, b) <= 2000.0).items()}
    got = catalog.QUERIES["cluster_geo"](spark, SF).collect()
    assert {r["ordinal"]: r["leader"] for r in got} == want
    assert {r["cluster_id"] for r in got if r["leader"] is None} == {"GEO_NONE"}


def test_near_searches_do_not_join_everything(spark):
    for name in ("nearest_place", "facility_context", "geofence_membership", "near_dup_pairs"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Cartesian|NestedLoop", plan), name


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
