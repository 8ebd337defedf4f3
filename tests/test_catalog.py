"""Every registered query against its SQL check on the smallest sample."""

import pytest

import compare
from flowlens.plans.catalog import all_checks, all_queries

SAMPLE = "/root/testdata/sf0.001"
QUERIES, CHECKS = all_queries(), all_checks()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SAMPLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SAMPLE)
    if name in CHECKS:
        assert compare.difference(df, duck, CHECKS[name]) is None
    else:
        assert len(df.columns) > 0 and df.count() >= 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
