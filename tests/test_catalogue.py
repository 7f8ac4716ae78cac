"""Every registered query that SQL can express gives SQL's rows on the smallest tables."""

import duckdb
import pytest

from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalogue.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    assert list(a.dtypes) == list(b.dtypes)
    assert (a.astype(object).where(a.notna(), None) == b.astype(object).where(b.notna(), None)).all().all()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
