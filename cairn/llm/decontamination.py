"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The automaton holds the word
strings of all items of a block; document words are streamed through it while the length of the
longest match ending at each word is tracked. A match of ``window`` words, or of a whole shorter item,
is a hit. Items are read in blocks of at most ``block_words`` words, so that what is broadcast keeps
its bound however large the benchmark is; each block is one more narrow pass over the documents, which writes hits only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.batches import append, raw, resident, shielded, values
from cairn.workspace import cut

WINDOW = 10
#: Words of benchmark items in one automaton: about 100 MB as Python objects.
BLOCK_WORDS = 200_000
_WORD_BYTE = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTE else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word-id strings, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.window_items: dict[int, set] = {}
        self.short_items: dict[int, list[tuple[int, str | None]]] = {}
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=window)
        for name, ids in coded:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.window_items.setdefault(self.suffix_state(state, window), set()).add(name)
            if len(ids) < window:
                self.short_items.setdefault(self.suffix_state(state, len(ids)), []).append((len(ids), name))
        self.width = len(self.vocab) + 1
        pairs = {a * self.width + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self._short_of: dict[int, list] = {-1: []}

    def _extend(self, last: int, w: int) -> int:
        """Add ``w`` after the string that ends in ``last``; returns the state of the longer string."""
        if w in self.next[last]:
            into = self.next[last][w]
            return into if self.len[into] == self.len[last] + 1 else self._clone(last, w, into)
        new = self._state({}, self.len[last] + 1)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            into = self.next[at][w]
            self.link[new] = into if self.len[into] == self.len[at] + 1 else self._clone(at, w, into)
        return new

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, at: int, w: int, into: int) -> int:
        """Split off the strings of ``into`` that are no longer than that of ``at`` and ``w``."""
        twin = self._state(dict(self.next[into]), self.len[at] + 1)
        self.link[twin] = self.link[into]
        self.link[into] = twin
        while at >= 0 and self.next[at].get(w) == into:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def suffix_state(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match that ends in ``state``."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def shorts(self, state: int) -> list[tuple[int, str | None]]:
        """Short items that are suffixes of the strings of ``state``."""
        if (known := self._short_of.get(state)) is None:
            known = self._short_of[state] = self.short_items.get(state, []) + self.shorts_above(state)
        return known

    def shorts_above(self, state: int) -> list:
        return self.shorts(self.link[state]) if state > 0 else []

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words whose neighbours all stand side by side in some item; every match lies in one."""
        n = len(ids)
        if n < self.shortest:
            return
        known = ids > 0
        if len(self.pairs):
            code = ids[:-1] * self.width + ids[1:]
            at = np.searchsorted(self.pairs, code)
            at[at == len(self.pairs)] = 0
            tied = (self.pairs[at] == code) & known[:-1] & known[1:]
        else:
            tied = np.zeros(n - 1, dtype=bool)
        first = known.copy()
        first[1:] &= ~tied
        last = known.copy()
        last[:-1] &= ~tied
        for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist(), strict=True):
            if b - a + 1 >= self.shortest:
                yield a, b + 1

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Positions hit, ascending, and the names of the items with occurring windows."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words))
        hit, found = np.zeros(len(words) + 1, dtype=np.int64), set()
        for a, b in self.candidates(ids):
            state = length = 0
            for i, w in enumerate(ids[a:b].tolist(), start=a + 1):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.len[state]
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
                if length >= self.window:
                    hit[i - self.window] += 1
                    hit[i] -= 1
                    found |= self.window_items.get(self.suffix_state(state, self.window), set())
                for n, name in self.shorts(state):
                    if n <= length:
                        hit[i - n] += 1
                        hit[i] -= 1
                        found.add(name)
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), found


def _blocks(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[list]:
    block, size = [], 0
    for name, body in benchmark.select(F.col(key).cast("string"), text).toLocalIterator():
        words = item_words(body.encode() if body else None)
        if words and block and size + len(words) > limit:
            yield block
            block, size = [], 0
        if words:
            block.append((name, words))
            size += len(words)
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (ascending word positions) and ``hit_items`` (ids as sorted strings).

    A null or empty text has no words and no hits; items without words are ignored; an item
    with a null id hits words but is not listed; repeated items and repeated documents each count as
    they stand; an empty benchmark hits nothing, and an empty table gives an empty result. Other columns pass through, but
    those named like a result, ``row_``, ``hit_words_`` or ``hit_items_`` give way. An item of more than
    ``block_words`` words is a block of its own.
    """
    return _passes(docs, benchmark, text, item_key, item_text, window, block_words, None)


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str, window: int, block_words: int, finish) -> DataFrame:
    """The documents with what was found; ``finish`` is a column of the result and how it is made.

    One block of items is one narrow pass. Of several, each is a pass that writes the hits alone, which are then joined to the
    documents; these are written once, however many blocks there are.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "hit_words", "hit_items", "row_", "hit_words_", "hit_items_")
    parts = []
    for block, more in _one_ahead(_blocks(benchmark, item_key, item_text, block_words)):
        shared, name = spark.sparkContext.broadcast(Automaton(block, window)), uuid.uuid4().hex
        if not more and not parts:
            return append(out, f"{_FOUND}, {finish[0]}" if finish else _FOUND, _whole_pass(shared, name, text, finish))
        if not parts:
            out = cut(out.withColumn("row_", F.monotonically_increasing_id()), "documents")
        parts.append(cut(append(out.select("row_", text), "hit_words array<int>, hit_items array<string>", _hit_pass(shared, name, text)).drop(text).where(F.size("hit_words") > 0), "hits"))
        shared.destroy()
    hits = reduce(DataFrame.union, parts).groupBy("row_").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"{c}_") for c in ("hit_words", "hit_items")])
    met = out.join(hits, "row_", "left").drop("row_")
    return append(met, f"{_FOUND}, {finish[0]}" if finish else _FOUND, _joined_pass(text, finish)).drop("hit_words_", "hit_items_")


_FOUND = "n_words long, hit_words array<int>, hit_items array<string>"


def _found(bodies: list[bytes | None], n_words: list[int], hits: list, items: list[list[str]], finish) -> list[pa.Array]:
    more = [finish[1](bodies, n_words, hits)] if finish else []
    return [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), *more]


def _scanned(shared, name: str, bodies: list[bytes | None]) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
    automaton: Automaton = resident(("automaton", name), lambda: shared.value)
    n_words, hits, items = [], [], []
    for body in bodies:
        words = item_words(body)
        at, names = automaton.scan(words)
        n_words.append(len(words))
        hits.append(at.astype(np.int32))
        items.append(sorted(x for x in names if x is not None))
    return n_words, hits, items


def _whole_pass(shared, name: str, text: str, finish):
    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        bodies = raw(batch, text)
        return _found(bodies, *_scanned(shared, name, bodies), finish)

    return each


def _hit_pass(shared, name: str, text: str):
    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        _, hits, items = _scanned(shared, name, raw(batch, text))
        return [pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    return each


def _joined_pass(text: str, finish):
    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        bodies = raw(batch, text)
        hits = [np.array(h or [], dtype=np.int32) for h in values(batch, "hit_words_")]
        return _found(bodies, [len(item_words(b)) for b in bodies], hits, [i or [] for i in values(batch, "hit_items_")], finish)

    return each


def _one_ahead(items: Iterator) -> Iterator[tuple]:
    """Each item, and whether another follows."""
    held = next(items)
    for following in items:
        yield held, True
        held = following
    yield held, False


def without_spans(data: bytes, hits: list[int]) -> str:
    """The text without the hit words and what separates the words of one span."""
    spans = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    out, at, previous = [], 0, -2
    for i in hits:
        if i != previous + 1:
            out.append(data[at : spans[i][0]])
        at, previous = spans[i][1], i
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with every matched span of ``window`` words or more cut out of ``text``.

    Documents of whose words more than ``max_coverage`` are hit are dropped whole. All others stay,
    and a text without a hit stays as it is, null and empty ones included; repeated documents are treated alike; an empty
    table gives an empty result. Columns are those of ``docs``, whatever their names.
    """
    plain = shielded(docs, text)

    def clean(bodies: list[bytes | None], n_words: list[int], hits: list[np.ndarray]) -> pa.Array:
        def one(body: bytes | None, n: int, at: np.ndarray) -> str | None:
            if body is None or len(at) > n * max_coverage:  # the latter are dropped below
                return None
            return without_spans(body, at.tolist()) if len(at) else body.decode()

        return pa.array(list(map(one, bodies, n_words, hits)), pa.string())

    found = _passes(plain, benchmark, text, item_key, item_text, window, block_words, ("cleaned_text_ string", clean))
    kept = found.where(F.size("hit_words") <= F.col("n_words") * max_coverage)
    return kept.withColumn(text, F.col("cleaned_text_")).select(*plain.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: one row per document with its hit words and items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


#: Windows as joined words, with their first position; short items are one window.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
