"""Every registered query of the core against its SQL; those without SQL must at least run."""

import pytest

from chunkloom.plans import oracle, queries
from tests.helpers import SF, duck_table, spark_table


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = spark_table(queries.queries()[name](spark, SF))
    assert got[1], "no rows"
    if name in oracle.SQL:
        assert got == duck_table(oracle.SQL[name])


def test_known_totals(spark):
    row = queries.dedup_efficiency(spark, "/root/testdata/sf0.01").first()
    assert (row.artifacts, row.chunks, row.objects, row.logical_bytes, row.unique_logical_bytes) == (927, 9487, 9382, 2308497, 2284189)


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
