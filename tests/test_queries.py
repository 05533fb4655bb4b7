import pytest

from larkspur.queries import QUERIES, SQL
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), FOLDER, SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
