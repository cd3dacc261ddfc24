"""Leases of claimed photos as a stream: claims, renewals and ends kept in state by photo, ends found by timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.streaming.queue import STATE_OF
from cairn.workspace import fresh_dir

#: Seconds that a claim holds unless it is renewed, and seconds that an event may come late.
LEASE_S, LATE_S = 3600, 600
#: What an event means for a lease, by the state that it leads to.
MEANS = {"processing": "claim", "done": "done", "error": "error"}
_CLOSED = "photo_id long, attempt long, claimed_us long, closed_us long, renewals long, outcome string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """Events wait until the watermark has passed them and are then taken in order of time and id, so arrival order changes nothing."""

    def __init__(self, lease_us: int) -> None:
        self.lease_us = lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, means string")
        self.held = handle.getValueState("held", "claimed long, until long, renewals long")
        self.attempts = handle.getValueState("attempts", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.us, r.event_id, r.means) for r in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(min(came)[0] // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((r[0], r[1], r[2]) for r in self.waiting.get()), key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        due, later = [r for r in rows if r[0] < final], [r for r in rows if r[0] >= final]
        attempt = self.attempts.get()[0] if self.attempts.exists() else 0
        held = tuple(self.held.get()) if self.held.exists() else None
        closed = []

        def close(at: int, outcome: str) -> None:
            closed.append(Row(photo_id=key[0], attempt=attempt, claimed_us=held[0], closed_us=at, renewals=held[2], outcome=outcome))

        for us, _, means in due:
            if held and us > held[1]:
                close(held[1], "expired")
                held = None
            if means == "claim":
                attempt += not held
                held = (held[0], us + self.lease_us, held[2] + 1) if held else (us, us + self.lease_us, 0)
            elif held:
                close(us, means)
                held = None
        if held and held[1] < final:
            close(held[1], "expired")
            held = None
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if held:
            self.held.update(held)
        else:
            self.held.clear()
        self.attempts.update((attempt,))
        if pending := [r[0] for r in later[:1]] + ([held[1]] if held else []):
            self.handle.registerTimer(min(pending) // 1000)
        return iter(closed)


def signals(log: DataFrame) -> DataFrame:
    """``photo_id, us, event_id, means`` of the events of a log that concern leases; others, and those without a photo or a time, are left out."""
    means = F.coalesce(*[F.when(F.col("event_type") == kind, MEANS[state]) for kind, state in STATE_OF.items() if state in MEANS])
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return log.select(F.col("user_id").cast("long").alias("photo_id"), us.alias("us"), F.col("event_id").cast("long").alias("event_id"), means.alias("means")).where("means is not null and photo_id is not null and us is not null")


def closed_leases(spark: SparkSession, log_path: str, schema, *, lease_s: int = LEASE_S, late_s: int = LATE_S, files_per_batch: int = 8, out: str | None = None) -> DataFrame:
    """``photo_id, attempt, claimed_us, closed_us, renewals, outcome``: the leases that are over, once what is new in a log has been read.

    A claim opens a lease, or renews the one that is held; ``done`` and ``error`` close it, and at its end it is ``expired`` and the
    photo may be claimed again. An event at the very end still counts. Attempts go on counting through all outcomes. Events more than
    ``late_s`` seconds behind the newest of earlier batches are dropped; leases that later events might still change are not given yet, and
    a repeated call with the same ``out`` gives them when they are over. Equal times go by id, null ids first; a repeated claim
    renews. An empty log gives an empty table. A photo's state is its lease and the events that the watermark has not passed.
    """
    root = out or fresh_dir(spark, "leases")
    log = signals(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path))
    timed = log.withColumn("at", F.timestamp_micros("us")).withWatermark("at", f"{late_s} seconds")
    over = timed.groupBy("photo_id").transformWithState(Leases(lease_s * 1_000_000), _CLOSED, "append", "eventTime")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        sink = over.writeStream.format("parquet").option("path", f"{root}/closed").option("checkpointLocation", f"{root}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(_CLOSED).parquet(f"{root}/closed")


#: Seconds of a lease in the query, whose events are hours apart.
QUERY_LEASE_S = 6 * 3600


def queue_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leases of the events that are over."""
    path = f"{sf_dir}/events.parquet"
    return closed_leases(spark, path.replace("events.", "event[s]."), spark.read.parquet(path).schema, lease_s=QUERY_LEASE_S)


LEASES_SQL = f"""
WITH signal AS (
  SELECT user_id AS photo_id, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS means
  FROM events WHERE event_type IN ('click', 'purchase', 'error') AND user_id IS NOT NULL AND ts IS NOT NULL
), final AS (SELECT (max(us) // 1000) * 1000 - {LATE_S * 1_000_000} AS us FROM signal),
beside AS (
  SELECT *, lag(us) OVER w AS before_us, lag(means) OVER w AS before, lead(us) OVER w AS after_us, lead(means) OVER w AS after
  FROM signal WINDOW w AS (PARTITION BY photo_id ORDER BY us, event_id NULLS FIRST)
), claims AS (
  SELECT *, sum(CASE WHEN before = 'claim' AND us <= before_us + {QUERY_LEASE_S * 1_000_000} THEN 0 ELSE 1 END) OVER (PARTITION BY photo_id ORDER BY us, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS attempt
  FROM beside WHERE means = 'claim'
), leases AS (
  SELECT photo_id, attempt, min(us) AS claimed_us, max(us) + {QUERY_LEASE_S * 1_000_000} AS ends, count(*) - 1 AS renewals,
    max(CASE WHEN after <> 'claim' AND after_us <= us + {QUERY_LEASE_S * 1_000_000} THEN after_us END) AS stopped,
    max(CASE WHEN after <> 'claim' AND after_us <= us + {QUERY_LEASE_S * 1_000_000} THEN after END) AS how
  FROM claims GROUP BY photo_id, attempt
)
SELECT photo_id, CAST(attempt AS BIGINT) AS attempt, claimed_us, coalesce(stopped, ends) AS closed_us, CAST(renewals AS BIGINT) AS renewals, coalesce(how, 'expired') AS outcome
FROM leases, final WHERE coalesce(stopped, ends) < final.us
"""
