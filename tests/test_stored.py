import pytest

from chronolith.plans import stored
from tests.test_catalog import duck, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(n for n, f in stored.QUERIES.items() if f.__module__ == stored.__name__))
def test_query_against_sql(spark, duck, sf_dir, name):  # noqa: F811
    df = stored.QUERIES[name](spark, sf_dir)
    got = duck.execute(stored.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())
