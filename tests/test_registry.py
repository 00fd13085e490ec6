"""Every registered query against its DuckDB statement."""

import pytest

import __spark_entry__ as entry
from check_queries import connect, difference


@pytest.fixture(scope="module")
def con(request):
    return connect("/root/testdata/sf0.001")


def test_every_query_has_a_statement():
    assert set(entry.REGISTERED) == set(entry.oracle_sql()) - set(entry.LLM_STATEMENTS)
    assert set(entry.LLM_STATEMENTS) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).first()
    assert (row.n_examples, row.equation_correct) == (1500, 579)


@pytest.mark.parametrize("name", sorted(entry.REGISTERED))
def test_matches(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert difference(got, con.execute(entry.oracle_sql()[name]).df()) is None
