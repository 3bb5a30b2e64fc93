"""Every registered query against its SQL on the smallest data set."""

import pytest
from check_oracle import compare, connect, oracle_frame

import __spark_entry__ as entry
from floodlens.plans import catalog

SF = "/root/testdata/sf0.001"
#: The library's own queries; those of the text operators have their tests in tests/llm.
QUERIES = {n: q for n, q in entry.queries().items() if n in catalog.QUERIES}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        verdict = compare(got, oracle_frame(duck, ORACLES[name]))
        assert verdict == "ok", verdict
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
