"""Every catalog query against its SQL, on the smallest tables."""

import pytest

from cairn.plans.ingest_queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, oracle, same):
    same(QUERIES[name](spark, sf), oracle.sql(SQL[name]))


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_streams_equal_sql(spark, sf, oracle, same):
    from cairn.streaming import queue

    same(queue.queue_state(spark, sf), oracle.sql(queue.QUEUE_SQL))
    same(queue.watch_events(spark, sf), oracle.sql(queue.WATCH_SQL))
