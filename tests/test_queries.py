"""Every registered query gives the rows of its SQL."""

import os

import duckdb
import pytest

from rangeweave.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(tuple((v is None, str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL[name]})").fetchall()
    assert ordered(tuple(r[c] for c in columns) for r in got.collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
