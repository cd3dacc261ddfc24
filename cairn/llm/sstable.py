"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

A shard is, in order: data blocks; the index block (last key, place and row count of each block); the
Bloom filter over document keys; the footer. Entries of a block are ``varint shared key bytes, varint
other key bytes, varint value bytes, key rest, value``; every 16th entry is a restart that shares
nothing, and restart places end the block, so a block is searched by bisection. Blocks are
compressed with zstd and carry a CRC-32.

Keys keep the order of their identifiers as bytes: null sorts before integers, integers
before strings. Four bytes follow that number the entries of equal identifiers, so repeated
identifiers all stay.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.batches import raw, values
from cairn.llm.tokens import chunk_encoder, library_tokenizer
from cairn.workspace import fresh_dir

MAGIC = b"CAIRNSS1"
RESTART, BLOCK_BYTES = 16, 64 << 10
FOOTER = struct.Struct("<QQQQQQBI8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def encode_key(doc_id: int | str | None) -> bytes:
    if doc_id is None:
        return b"\x00"
    if isinstance(doc_id, int):
        return b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")
    return b"\x02" + doc_id.encode() + b"\x00"


def decode_key(key: bytes) -> int | str | None:
    if key[:1] == b"\x00":
        return None
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[:1] == b"\x01" else key[1:-1].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    step = (h >> 64) | 1
    return ((h + i * step) % bits for i in range(BLOOM_HASHES))


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.at = self.tokens = self.entries = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.last, self.order = None, 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.count, self.previous = bytearray(), [], 0, b""

    def add(self, doc_id, value: bytes) -> None:
        user = encode_key(doc_id)
        self.order = self.order + 1 if user == self.last else 0
        if self.order == 0:
            self.keys.append(user)
        self.last = user
        key, shared = user + self.order.to_bytes(4, "big"), 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.previous))
            while shared < most and key[shared] == self.previous[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.previous = key
        self.count += 1
        self.entries += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            packed = zstandard.compress(body, 3)
            self.index.append((self.previous, self.at, len(packed), self.count))
            self._put(packed + struct.pack("<I", zlib.crc32(packed)))
        self._new_block()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) + _varint(n) for k, at, size, n in self.index))
        bloom_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            bloom[list(_bloom_places(key, bits))] = 1
        self._put(np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, self.entries, self.tokens, self.width, len(self.index), MAGIC))
        self.out.close()


class Reader:
    """Reads one shard: ``get`` by bisection, ``scan`` in order."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        foot = source.read_at(FOOTER.size, end - FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.entries, self.tokens, self.width, blocks, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, at = source.read_at(index_size, index_at), 0
        self.index = []
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            count, at = _read_varint(data, at)
            self.index.append((key, place, size, count))
        self.bloom = source.read_at((self.bits + 7) // 8, bloom_at)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, size, _ = self.index[i]
        data = self.source.read_at(size + 4, at)
        if zlib.crc32(data[:size]) != struct.unpack("<I", data[size:])[0]:
            raise ValueError("a block is damaged")
        body = zstandard.decompress(data[:size])
        n = struct.unpack_from("<I", body, len(body) - 4)[0]
        return body[: len(body) - 4 * n - 4], list(struct.unpack_from(f"<{n}I", body, len(body) - 4 * n - 4))

    @staticmethod
    def _entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | str | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, value in self._entries(self._block(i)[0]):
                yield decode_key(key[:-4]), np.frombuffer(value, dtype=f"<u{self.width}")

    def may_hold(self, doc_id) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(encode_key(doc_id), self.bits))

    def get(self, doc_id) -> list[np.ndarray]:
        """Ids of every entry with this identifier, none if there is none."""
        if not self.may_hold(doc_id):
            return []
        user, found = encode_key(doc_id), []
        low = user + bytes(4)
        for i in range(bisect_left(self.index, low, key=lambda x: x[0]), len(self.index)):
            body, restarts = self._block(i)
            first = bisect_left(restarts, low, key=lambda at, body=body: next(self._entries(body, at))[0])
            for key, value in self._entries(body, restarts[max(0, first - 1)]):
                if key[:-4] == user:
                    found.append(np.frombuffer(value, dtype=f"<u{self.width}"))
                elif key > low:
                    return found
        return found


def open_shard(path: str) -> Reader:
    store, place = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))
    return Reader(store.open_input_file(place))


MANIFEST = "path string, part int, roll int, first string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, *, key: str = "doc_id", text: str = "text", shard_bytes: int = 256 << 20) -> list:
    """Encode and write ``docs`` into shards under ``folder``; returns the manifest in key order.

    Rows are range-partitioned by key and, so that one key with many rows still spreads, by a hash
    of the text; within equal keys they stand in the order of that hash and the text. A null text
    is empty; ids are integers or strings, null ids sort first; an empty table writes nothing. Each shard is written under the
    name of its task attempt and moved into place when whole, so a repeated task leaves the same file, and what failed attempts
    left is swept. The driver gets a row a shard.
    """
    width = 2 if max(library_tokenizer(tokenizer).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(root, recursive=True)
        encode, tail = chunk_encoder(tokenizer, width), b"" if end_id is None else end_id.to_bytes(width, "little")
        made: list[tuple] = []
        writer = None

        def finish() -> None:
            nonlocal writer
            writer.close()
            name = f"part-{part:06d}-{len(made):04d}.sst"
            target = posixpath.join(root, name)
            if store.get_file_info(target).type == pa.fs.FileType.File:  # an earlier attempt of this task was as far
                store.delete_file(target)
            store.move(posixpath.join(root, f".{name}.{attempt}"), target)
            made.append((f"{folder}/{name}", part, len(made), str(decode_key(writer.keys[0])), writer.entries, writer.tokens))
            writer = None

        for batch in batches:
            for doc_id, body in zip(values(batch, key), raw(batch, text), strict=True):
                if writer is None:
                    writer = Writer(store.open_output_stream(posixpath.join(root, f".part-{part:06d}-{len(made):04d}.sst.{attempt}")), width)
                writer.add(doc_id, encode(body) + tail)
                if writer.at >= shard_bytes:
                    finish()
        if writer is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*[(a, b, c, d, e, f) for a, b, c, d, e, f in made], strict=True)], names=["path", "part", "roll", "first", "n_docs", "n_tokens"]).cast(
                pa.schema([("path", pa.string()), ("part", pa.int32()), ("roll", pa.int32()), ("first", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
            )

    tie = F.xxhash64(text)
    rows = docs.select(key, text).repartitionByRange(F.col(key), tie).sortWithinPartitions(F.col(key), tie, F.col(text))
    made = sorted(rows.mapInArrow(run, MANIFEST).collect(), key=lambda r: (r["part"], r["roll"]))
    if made:
        _sweep(folder)
    return made


def _sweep(folder: str) -> None:
    """Remove what attempts that failed have left."""
    store, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder.removeprefix("file:"))
    for found in store.get_file_info(pa.fs.FileSelector(root)):
        if found.base_name.startswith(".part-"):
            store.delete_file(found.path)


def read_tokens(spark, manifest: list, key_type: str = "long") -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every entry of the shards, one task a shard; no shards give an empty result."""
    rows, start = [], 0
    for r in manifest:
        rows.append((r["path"], start))
        start += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(values(batch, "path"), values(batch, "first"), strict=True):
                yield from _entries(path, first)

    def _entries(path: str, at: int) -> Iterator[pa.RecordBatch]:
        keys, starts, counts, bodies = [], [], [], []

        def out() -> pa.RecordBatch:
            kind = pa.string() if key_type == "string" else pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

        size = 0
        for doc_id, ids in open_shard(path).scan():
            keys.append(doc_id)
            starts.append(at)
            counts.append(len(ids))
            bodies.append(ids.astype("<u4").tobytes())
            at += len(ids)
            size += len(bodies[-1])
            if size > 8 << 20:
                yield out()
                keys, starts, counts, bodies, size = [], [], [], [], 0
        if keys:
            yield out()

    shards = spark.createDataFrame(rows, "path string, first long")
    return shards.repartition(max(1, min(len(rows), 10_000)), "path").mapInArrow(run, f"doc_id {key_type}, start long, n_tokens long, ids binary")


TOKENIZER, END_ID = "word_bpe_49k.json", 2


def query(spark, sf_dir: str) -> DataFrame:
    """op2: written as shards in the shared folder, then read back; order of equal ids is by text hash."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, fresh_dir(spark, "tokens"), public_tokenizers.path(TOKENIZER), END_ID)
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
