"""Every query of the library against its SQL twin in DuckDB, on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
from spendlake.plans import registry  # noqa: E402

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for f in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if hasattr(value, "strftime"):
        return str(value).removesuffix(" 00:00:00")
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, database, name):
    df = registry.QUERIES[name](spark, TABLES)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    result = database.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(rows, df.columns) == comparable(result.fetchall(), names)
