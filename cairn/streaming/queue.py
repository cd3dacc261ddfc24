"""The work queue as a stream: an append log of state changes folded into one row a photo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.workspace import fresh_dir, remove

#: What each kind of event says about the queue.
STATE_OF = {"view": "queued", "click": "processing", "purchase": "done", "error": "error", "signup": "deferred"}


def states(log: DataFrame) -> DataFrame:
    """``photo_id, ts, event_id, status`` of a log of events."""
    named = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATE_OF.items()])
    return log.select(F.col("user_id").alias("photo_id"), "ts", "event_id", named.alias("status")).where("status is not null and photo_id is not null")


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each photo, ties by event id, and how many changes led there; partial sums before the shuffle."""
    last = F.max(F.struct("ts", "event_id", "status")).alias("last")
    return changes.groupBy("photo_id").agg(last, F.sum("n").alias("n")).select("photo_id", "last.ts", "last.event_id", "last.status", "n")


#: Folded changes of batches that are kept apart before they are folded into one.
MOST_DELTAS = 16
_STATE = "photo_id long, ts timestamp_ntz, event_id long, status string, n long"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole tables in a folder, ascending; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
    whole = [n for n in names if store.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n) for n in whole)


def state(spark: SparkSession, root: str) -> DataFrame:
    """The state of each photo as the folder holds it: the newest folded table and the changes of the batches after it."""
    folded = _numbers(spark, f"{root}/folded")[-1:]
    later = [n for n in _numbers(spark, f"{root}/delta") if not folded or n > folded[0]]
    paths = [f"{root}/folded/{n}" for n in folded] + [f"{root}/delta/{n}" for n in later]
    found = spark.read.schema(_STATE).parquet(*paths) if paths else spark.createDataFrame([], _STATE)
    return latest(found)


def compact(spark: SparkSession, root: str) -> None:
    """Fold all changes so far into one table; it is whole before what it replaces goes."""
    deltas, before = _numbers(spark, f"{root}/delta"), _numbers(spark, f"{root}/folded")
    if deltas:
        state(spark, root).write.mode("overwrite").parquet(f"{root}/folded/{deltas[-1]}")
        for path in [f"{root}/delta/{n}" for n in deltas] + [f"{root}/folded/{n}" for n in before if n != deltas[-1]]:
            remove(spark, path)


def drain(spark: SparkSession, log_path: str, schema, out: str | None = None) -> DataFrame:
    """Read what is new in a Parquet log as a stream and fold it batch by batch; returns the state after the last.

    Each micro-batch writes its own folded changes under its number, so one that is repeated after a failure overwrites them and
    nothing counts twice, and no batch writes the whole state. Many of them are folded into one table at the end. A
    repeated call goes on where the last one stopped; without anything new it gives the same state.
    """
    root = out or fresh_dir(spark, "queue")

    def fold(batch: DataFrame, number: int) -> None:
        latest(states(batch).withColumn("n", F.lit(1).cast("long"))).write.mode("overwrite").parquet(f"{root}/delta/{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(log_path)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if len(_numbers(spark, f"{root}/delta")) > MOST_DELTAS:
        compact(spark, root)
    return state(spark, root)


def watch(spark: SparkSession, folder: str, schema, sink, checkpoint: str, interval: str | None = "60 seconds"):
    """New files of a folder: ``sink(batch, number)`` gets each micro-batch exactly once per checkpoint.

    Forever, a look each ``interval``; without one until what is there now was seen.
    """
    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each kind that a watched folder brought, each batch written under its number."""
    path, root = f"{sf_dir}/events.parquet", fresh_dir(spark, "watch")
    run = watch(spark, path.replace("events.", "event[s]."), spark.read.parquet(path).schema, lambda batch, n: batch.groupBy("event_type").count().write.mode("overwrite").parquet(f"{root}/seen/{n}"), f"{root}/checkpoint", None)
    run.awaitTermination()
    return spark.read.parquet(f"{root}/seen/*").groupBy("event_type").agg(F.sum("count").alias("n"))


WATCH_SQL = "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type"


def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return drain(spark, path.replace("events.", "event[s]."), spark.read.parquet(path).schema)


QUEUE_SQL = """
SELECT user_id AS photo_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'deferred' END, (ts, event_id)) AS status,
  CAST(count(*) AS BIGINT) AS n
FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error', 'signup') AND user_id IS NOT NULL GROUP BY user_id
"""
