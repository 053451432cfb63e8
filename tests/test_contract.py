"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from questlake.schema import EVENT_TYPES
from questlake.sources.generator import generate_events

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == ""
    else:
        assert QUERIES[name](spark, FOLDER).count() >= 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["dt", "server_id", "dau", "metric_id"]


def test_generator_is_reproducible_and_valid(spark):
    a, b = (generate_events(spark, 500, 50, seed=7).orderBy("event_id").collect() for _ in range(2))
    assert a == b and len({r.event_id for r in a}) == 500
    assert {r.event_type for r in a} <= set(EVENT_TYPES)
    for r in a:
        assert r.player_id >= 1 and r.server_id >= 1
        assert (r.dungeon_id is not None) or r.event_type not in ("enter_dungeon", "clear_dungeon")
        assert (r.amount_fen or 0) >= 1 if r.event_type == "recharge" else r.amount_fen is None
    assert generate_events(spark, 500, 50, seed=8).select("event_id").intersect(spark.createDataFrame(a).select("event_id")).count() == 0
