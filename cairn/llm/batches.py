"""What the Arrow-batched operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A-Z to a-z, every other byte as it is; UTF-8 bytes of other letters are over 0x7F.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased; null has none."""
    return text.translate(LOWER).split() if text else []


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Apply ``each`` to every Arrow batch; narrow, so a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def append(df: DataFrame, added: str, each: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns of the DDL ``added``; a column of such a name in ``df`` gives way."""
    new = T.StructType.fromDDL(added)
    kept = df.drop(*new.names)
    schema = T.StructType(kept.schema.fields + new.fields)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *each(batch)], names=schema.names)

    return map_batches(kept, one, schema)


def shielded(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with columns that are not ``used`` under names that clash with nothing; ``toDF`` of the old names undoes it."""
    return docs.toDF(*[c if c in used else f"kept_{i}_" for i, c in enumerate(docs.columns)])


_RESIDENT: dict = {}


def resident(name: tuple, make: Callable):
    """What ``make`` gives for ``name``, kept by the worker process between tasks.

    A worker keeps one such table at a time: workers outlive the stages of a pipeline, and
    what an earlier operator remembers must not add to the memory of a later one.
    """
    if name not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _RESIDENT[name] = make()
    return _RESIDENT[name]


class Memo(dict):
    """A bounded memo of a pure function: emptied when full, so it saves time and never changes results."""

    def __init__(self, make: Callable, limit: int = 300_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        out = self[key] = self.make(key)
        return out
