import os

import duckdb
import pytest

from chronolith.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = duck.execute(catalog.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())
