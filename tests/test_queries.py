import os

import pytest

import __spark_entry__ as entry
from dirlake.plans import queries as own
from dirlake.streaming import queries as streams
from tests.oracle import check, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted({**own.SQL, **streams.SQL}))
def test_query_gives_the_rows_of_its_sql(spark, name):
    check(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(own.QUERIES) | set(streams.QUERIES) == set(own.SQL) | set(streams.SQL)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["object_class", "n"] and df.count() > 0
