"""Every query with an oracle against DuckDB on the smallest tables, and the driver's entry points."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from quarry.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (float, int)) and not isinstance(value, bool):
        return round(float(value), 5)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in catalog.ORACLES:
        assert got.columns
        return
    out = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    want = sorted(([plain(dict(zip(columns, r))[c]) for c in order] for r in out.fetchall()), key=key)
    have = sorted(([plain(r[c]) for c in order] for r in rows), key=key)
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_b6_reads_whole_texts(spark, tmp_path):
    rows = [(1, "x" * 50 + " blocked", "en"), (2, "x" * 50 + " fixme", "en"), (3, "中" * 50 + " a", "en"), (4, "中" * 50, "en"), (5, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reason for r in catalog.QUERIES["B6_junk_reason"](spark, str(tmp_path)).collect()}
    assert got == {1: "obstacle_osm_note", 2: "osm_fixme_todo", 3: None, 4: "pure_non_latin_Chinese_CJK", 5: None}
