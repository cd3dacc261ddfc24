"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model holds a white-space marker behind another character, nothing that the
encoder does reaches over the border in front of a run of markers. Each distinct chunk, a run of
markers with the characters up to the next run, is then segmented once, and ids and decoded
text of a document are joined from the table by position. Other models are encoded text by text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.batches import Memo, append, raw, resident

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*").findall
_DOUBLE = re.compile("  | $").search


class ChunkTable:
    """Ids and text of whole documents, exactly as the library gives them."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        probe = [" a  b ", "\txéﬁ "]
        self.by_chunk = (
            not any(re.search(f"[^{MARK}]{MARK}", p) for i, p in enumerate(pieces) if not model.is_control(i))
            and all(model.decode(model.encode(t)) == t for t in probe)
            and MARK in pieces
        )
        self.anchor = model.encode("a")
        self.mark = model.piece_to_id(MARK)
        self.table = Memo(self._chunk, limit)
        self.first = Memo(lambda chunk: self.model.decode(self._ids(chunk)), limit // 4)
        self.begin, self.end = np.array([model.bos_id()], "<u4").tobytes(), np.array([model.eos_id()], "<u4").tobytes()

    def _ids(self, chunk: str) -> list[int]:
        """``chunk`` begins with a space; the library puts that first one in front by itself."""
        return [self.mark] if chunk == " " else self.model.encode(chunk[1:])

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = self._ids(chunk)
        behind = self.model.decode(self.anchor + ids)[1:]
        return np.array(ids, "<u4").tobytes(), chunk if behind == chunk else behind  # the key's own text needs no copy

    def convert(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers with begin and end, and their decoded text."""
        if not text:
            return self.begin + self.end, ""
        if not self.by_chunk:
            ids = self.model.encode(text, add_bos=True, add_eos=True)
            return np.array(ids, "<u4").tobytes(), self.model.decode(ids)
        marked = " " + (text.replace(MARK, " ") if MARK in text else text)
        if _DOUBLE(marked):
            chunks = _CHUNK(marked)
        else:
            chunks = [" " + x for x in marked[1:].split(" ")]
        rows = list(map(self.table.__getitem__, chunks))
        ids = b"".join([self.begin, *[r[0] for r in rows], self.end])
        return ids, self.first[chunks[0]] + "".join([r[1] for r in rows[1:]])


def chunk_table(model: str) -> ChunkTable:
    return resident(("pieces", model), lambda: ChunkTable(model))


def encode_decode(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded`` (text) of each whole text; null is empty.

    Rows are independent of one another; columns named like a result give way. The table of
    chunks lives in each worker process and is emptied when it is full, which costs time only.
    """

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        table = chunk_table(model)
        counts, ids_of, decoded = [], [], []
        for body in raw(batch, text):
            ids, back = table.convert(body.decode() if body else "")
            counts.append(len(ids) // 4)
            ids_of.append(ids)
            decoded.append(back)
        return [pa.array(counts, pa.int64()), pa.array(ids_of, pa.binary()), pa.array(decoded, pa.string())]

    return append(docs, "n_tokens long, ids binary, decoded string", each)


def digests(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; ids and texts never leave the worker."""

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        table = chunk_table(model)
        counts, first, second = [], [], []
        for body in raw(batch, text):
            ids, back = table.convert(body.decode() if body else "")
            counts.append(len(ids) // 4)
            first.append(hashlib.sha256(ids).hexdigest())
            second.append(hashlib.sha256(back.encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(first), pa.array(second)]

    return append(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", each).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


MODEL = "piece_bpe_32k.model"


def query(spark, sf_dir: str) -> DataFrame:
    """op4: ids with begin and end, and their decoded text, of all documents."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path(MODEL))
