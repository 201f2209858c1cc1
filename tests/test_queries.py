import pytest

from mapframe.plans import queries
from tests.oracle import same

MAY_BE_EMPTY = {"first_nonempty", "discard_anti", "rect_contains", "image_diff"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, name):
    n = same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert n or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
