"""Each query of the corpus operators with SQL gives the same rows as DuckDB does."""

import duckdb
import pytest

from casegrain.llm import registry
from tests.test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str) == want and want
