import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) pairs, with columns that clash with names the operators use."""

    def make(*rows, partitions=3):
        data = [(i, t, "en", "src", 0 if t is None else len(t), "x", 7) for i, t in rows]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, run string, token int")
        return df.repartition(partitions) if data else df

    return make
