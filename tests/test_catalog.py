"""Every registered query against its SQL, on the smallest test set."""

import os

import duckdb
import pytest

from textlake.plans.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def listed(df):
    return sorted(str(tuple(None if v is None else v for v in r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert listed(got) == listed(con.sql(SQL[name]).df())
