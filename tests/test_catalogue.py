import pytest

from siftlode.plans.catalogue import QUERIES, SQL

from .check_sql import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_what_its_sql_gives(spark, name):
    got = rows_of(QUERIES[name](spark, FOLDER))
    if name in SQL:
        assert got == rows_of_sql(SQL[name], FOLDER)
    else:
        assert got[1]


def test_every_query_but_the_checksum_has_sql():
    assert set(QUERIES) - set(SQL) == {"crc_check"}


def test_entry_point_works_without_a_session_of_its_own(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["num_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
