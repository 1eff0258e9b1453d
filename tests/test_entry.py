"""Registered queries run and agree with their SQL on a small table."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tarnfield import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", ["entity_features", "group_relative", "performance_class", "numeric_summary", "proxy_audit", "expand_frontier", "war_preset", "binned", "profile_five_numbers", "raw_audit_warnings", "merged_sketches", "canonical_texts"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        part = f if os.path.isfile(f) else f"{f}/*.parquet"
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{part}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    sql = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert ours == sorted((tuple(plain(x) for x in r) for r in sql), key=repr)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
