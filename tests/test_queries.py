"""Every catalogue query against its SQL twin on the small tables."""

import pytest

from __spark_entry__ import entry
from feedlake.plans.catalog import QUERIES
from feedlake.plans.oracles import ORACLES
from oracle_check import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize(
    "name, condition",
    [
        ("sentiment", "label = 'positive'"),
        ("sentiment", "label = 'negative'"),
        ("language", "language_by_list = 'fa'"),
        ("agent_signals", "dispatch_route = 'publish_immediately'"),
        ("agent_signals", "dispatch_route = 'review_required'"),
        ("header_and_tags", "tags LIKE '%tech%'"),
        ("authorize_requests", "status = 403"),
        ("authorize_requests", "status = 401"),
        ("throttle_one_per_hour", "NOT admitted"),
        ("throttle_three_per_day", "NOT admitted"),
    ],
)
def test_query_is_not_vacuous(spark, name, condition):
    assert not QUERIES[name](spark, SF).where(condition).isEmpty()
