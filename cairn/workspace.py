"""Shared scratch space: tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Paths that this process has written and not removed.
_WRITTEN: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (a local test session) is a folder of this machine
    set; on a cluster that is an error, because executors would not see each other's files.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {SETTING} to a folder that all machines of {master} share")
    own = tempfile.mkdtemp(prefix="cairn-")
    spark.conf.set(SETTING, own)
    return own


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other call gets; nothing is created there yet."""
    path = f"{shared_dir(spark)}/cairn-{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    return path


def cut_to(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it back; also the table's path.

    The reread table has no lineage, is computed once however often it is used, and is there
    for every executor after any other is lost.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """The table of ``cut_to`` alone."""
    return cut_to(df, tag)[0]


def let_go(spark: SparkSession) -> None:
    """Give back what finished jobs hold on the driver: plans, and through their end shuffles and broadcasts everywhere.

    A driver that plans hundreds of jobs in a row otherwise grows to its limit before it looks for garbage. What its
    threads freed outside the heap stays in their arenas, so these are asked to give it back too, where Java can.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    diagnose(spark, "systemTrimNativeHeap")


def diagnose(spark: SparkSession, command: str) -> str | None:
    """What a diagnostic command without arguments says of the driver's Java; None where Java has no such command."""
    context = spark.sparkContext
    jvm, new_array = context._jvm, context._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    call = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class is not open to reflection
    invoke = next(m for m in call.getMethods() if m.getName() == "invoke")
    arguments = new_array(jvm.java.lang.Object, 4)
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), command
    try:
        return invoke.invoke(server, arguments)
    except Py4JJavaError:
        return None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_dir`` named; no plan that is still to run may read it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.pop(path, None)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end what was written within, but the paths that are put into the list it gives."""
    before, kept = set(_WRITTEN), []
    yield kept
    for path in [p for p in _WRITTEN if p not in before and p not in kept]:
        remove(spark, path)
