import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from textlake.session import local_session

    session = local_session("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Rows of (path, content) as a table."""

    def make(rows: dict[str, bytes | None], **columns):
        names = list(columns)
        data = [(p, None if c is None else bytearray(c), *(columns[n][p] for n in names)) for p, c in rows.items()]
        return spark.createDataFrame(data, "path string, content binary" + "".join(f", {n} int" for n in names))

    return make
