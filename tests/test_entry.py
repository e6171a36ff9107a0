import os

import duckdb
import pytest

import __spark_entry__ as e
from allelia.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"score_h2", "score_h2_loco", "boundary_count", "loco_grm"}


def against(spark, name):
    """Rows of a query and of its SQL, columns by name."""
    df = e.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    return got, sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in e.oracle_sql() and q not in SLOW])
def test_query_equals_its_sql(spark, name):
    got, expected = against(spark, name)
    assert got == expected


def test_flagship(spark):
    assert e.entry(spark).count() > 0
