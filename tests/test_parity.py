"""Every registered query against its SQL, in plain and in split form."""

import pytest
from conftest import SMALL
from parity import compare, connect

import __spark_entry__ as entry
from apexline import plans

QUERIES, CHECKS = plans.QUERIES, plans.CHECKS
# Queries that order rows inside a key, hence have a split form.
ORDERED = (
    "boundaries class_members pit_laps class_position pit_from_counter gap_ahead_series"
    " live_position frozen_sector_marks pit_laps_inferred stints stopped_estimate"
    " position_if_clean error_quantiles overtakes fastest_lap_notes class_rank"
    " championship_rounds grid_vs_finish in_session event_bundle laps_with_weather driven_km"
    " part_life usage_ranking"
).split()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, CHECKS[name]) == ""


@pytest.mark.parametrize("name", ORDERED)
def test_matches_sql_when_split(spark, duck, hot, name):
    assert compare(QUERIES[name](spark, SMALL), duck, CHECKS[name]) == ""
