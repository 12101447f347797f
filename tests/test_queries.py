"""Every registered query against its SQL, on whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rollcall.plans.queries import ORACLE_SQL, QUERIES

@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want) and got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_keys_lose_no_pair(spark, sf_dir):
    small, large = ({tuple(r) for r in QUERIES[n](spark, sf_dir).collect()} for n in ("m6_rules", "m17_rules_by_keys"))
    assert small == large and small


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
