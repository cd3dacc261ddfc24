"""Leases of the queue in stream state: expiry, renewal, late events, restarts, and the rule in SQL."""

import datetime as dt

import duckdb

from cairn.streaming import leases

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, extra string"
START = dt.datetime(2024, 1, 1)


def write(spark, folder, rows):
    made = [(i, s if s is None else START + dt.timedelta(seconds=s), photo, kind, "x") for i, s, photo, kind in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def seconds(found):
    base = int((START - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return sorted((r.photo_id, r.attempt, (r.claimed_us - base) / 1e6, (r.closed_us - base) / 1e6, r.renewals, r.outcome) for r in found.collect())


def test_expiry_renewal_and_late_events(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    def run():
        return seconds(leases.closed_leases(spark, log, SCHEMA, lease_s=100, late_s=10, out=out))

    write(spark, log, [
        (1, 0, 1, "click"), (2, 90, 1, "click"), (3, 190, 1, "purchase"),  # renewed once, done at the very end
        (4, 0, 2, "click"), (5, 101, 2, "purchase"), (6, 150, 2, "click"), (7, 150, 2, "error"),  # expired, then an error at the same time
        (8, 20, 3, "purchase"), (9, 30, 3, "view"), (10, 250, 4, "click"),  # nothing to close; still held
        (11, None, 1, "click"), (12, 5, None, "click"), (13, 300, 9, "signup"), (14, 290, 8, "error"),
    ])
    first = [(1, 1, 0, 190, 1, "done"), (2, 1, 0, 100, 0, "expired"), (2, 2, 150, 150, 0, "error")]
    assert run() == first
    assert run() == first  # nothing new
    write(spark, log, [(20, 200, 4, "purchase"), (21, 285, 5, "click"), (22, 345, 4, "click"), (23, 900, 8, "error")])
    # the purchase came too late; the one claim at 345 renewed the lease of 250, and both photos ran out
    assert run() == first + [(4, 1, 250, 445, 1, "expired"), (5, 1, 285, 385, 0, "expired")]
    write(spark, log, [(30, 895, 5, "click"), (31, 893, 5, "click"), (32, 2000, 8, "error")])  # not in order of time
    assert run()[-1] == (5, 2, 893, 995, 1, "expired")


def test_empty_log(spark, tmp_path):
    write(spark, str(tmp_path / "log"), [])
    assert leases.closed_leases(spark, str(tmp_path / "log"), SCHEMA, out=str(tmp_path / "out")).count() == 0


def test_leases_agree_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    found = leases.queue_leases(spark, sf)
    db = duckdb.connect()
    db.sql(f"create view events as from '{sf}/events.parquet'")
    rows = sorted(db.sql(leases.LEASES_SQL).select(", ".join(found.columns)).fetchall())
    assert sorted(tuple(r) for r in found.collect()) == rows
    assert {r[5] for r in rows} == {"done", "error", "expired"} and max(r[4] for r in rows) > 0
