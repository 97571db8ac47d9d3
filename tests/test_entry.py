"""The driver contract on the smallest tables: every query against its SQL."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in catalogue.ORACLE_SQL:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = db.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    else:
        assert got


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if Path(SF).exists():
        assert entry.entry(spark).columns == ["key", "commit_ts", "value"]
