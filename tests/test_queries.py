"""Every registered query against its reference SQL, or for rows when it has none."""

import subprocess
import sys

import pytest

from tests.compare import compare, duck

# names are read without a Spark session, as the driver may do
_LIST = subprocess.run(
    [sys.executable, "-c",
     "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql();"
     "assert set(o) <= set(q); print('\\n'.join(q))"],
    capture_output=True, text=True, check=True)
NAMES = _LIST.stdout.split()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.collect()) > 0
        return
    _, message = compare(df, con, sql)
    assert message == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
