"""Every registered query outside the training-data operators against its SQL on the smallest tables."""

import duckdb
import pytest

from quillstack.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda rs, cols: sorted(repr([plain(r[cols.index(n)]) for n in order]) for r in rs)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), list(want.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
