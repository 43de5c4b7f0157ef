"""Every registered query that has SQL gives what the SQL gives; the others run."""

from __future__ import annotations

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "conversations", "lineitem"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.REGISTRY))
def test_query(spark, db, name):
    df = registry.REGISTRY[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name in registry.ORACLE_SQL:
        assert plain(got) == plain(db.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    else:
        assert got


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
