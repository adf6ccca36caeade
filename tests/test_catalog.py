"""Every query with SQL against that SQL, on the smallest tables; the rest must run."""

import duckdb
import pytest

from scopeflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def _cell(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in ("scan_csv", "audit_share")])
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr([_cell(r[c]) for c in names]) for r in df.collect())
    if name in catalog.ORACLES:
        got = db.execute(catalog.ORACLES[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == names
        assert sorted(repr([_cell(dict(zip(columns, r))[c]) for c in names]) for r in got.fetchall()) == rows
