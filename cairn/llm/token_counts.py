"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens not seen before are held as one flat symbol array with sequence lengths. In each round
every sequence applies all occurrences of its own lowest-ranked pair at once; sequences without a
pair left are finished and their symbols counted. That equals merging one pair at a time, because a merge
only ever makes pairs of a higher rank than its own, which is checked when the merges are loaded.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.batches import append, raw, resident

#: White space of Unicode, and the pre-token pattern of byte-level BPE.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class RankMerger:
    """Counts the symbols that are left of byte strings after all merges."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        born = dict.fromkeys(self.first.tolist(), -1)
        for rank, (a, b) in enumerate(pairs):
            if max(born.get(vocab[a], rank), born.get(vocab[b], rank)) >= rank:
                raise ValueError(f"merge {rank} uses a symbol that no earlier merge makes")
            born.setdefault(vocab[a + b], rank)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        out = np.array([len(s) for s in sequences], dtype=np.int64)
        live = np.flatnonzero(out > 1)
        lens = out[live]
        sym = self.first[np.frombuffer(b"".join(sequences[i] for i in live.tolist()), dtype=np.uint8)]
        while len(live):
            starts = np.cumsum(lens) - lens
            place = np.searchsorted(self.key, pair := sym[:-1] * self.size + sym[1:])
            place[place == len(self.key)] = 0
            rank = np.append(np.where(self.key[place] == pair, self.rank[place], _NONE), _NONE)
            rank[starts + lens - 1] = _NONE  # no pair reaches over the end of its sequence
            least = np.minimum.reduceat(rank, starts)
            going = least < _NONE
            out[live[~going]] = lens[~going]
            hit = np.flatnonzero((rank == np.repeat(least, lens)) & (rank < _NONE))
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)[: len(hit)]  # of overlapping pairs, every other one from the left
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))) % 2 == 0]
            sym[hit] = self.made[place[hit]]
            keep = np.repeat(going, lens)
            keep[hit + 1] = False
            merged = np.bincount(np.searchsorted(starts, hit, side="right") - 1, minlength=len(lens))
            sym, live, lens = sym[keep], live[going], (lens - merged)[going]
        return out


class TokenCounter:
    """Counts tokens as the tokenizers library gives them for a byte-level BPE file.

    Counts are remembered by chunk: a single space between two characters that are not white space always
    begins a pre-token, so texts are cut there, and only chunks not met before are split and merged.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are counted")
        special = [t for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("special strings that take in their surroundings are not supported")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
        self.split = regex.compile(_PATTERN).findall
        self.odd = regex.compile(rf"^ ?(?:[{_SPACE}]|$)|[{_SPACE}]$").search
        self.known: dict[str, int] = {}
        self.limit = limit

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """A text cut before every space; sound where no piece is odd: blank, or with white space at an end."""
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def _learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts of new pieces."""
        split = [self.split(p) for p in pieces]
        tokens = list({t for s in split for t in s} - self.known.keys())
        counts = dict(zip(tokens, self.merger.counts([t.encode() for t in tokens]).tolist(), strict=True))
        return {p: sum(counts[t] if t in counts else self.known[t] for t in s) for p, s in zip(pieces, split, strict=True)}

    def counts(self, texts: list[bytes | None]) -> list[int]:
        out, waiting, new = [0] * len(texts), [], set()
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        for i, body in enumerate(texts):
            if not body:
                continue
            text = body.decode()
            parts = [text]
            if self.special is not None and (found := len(self.special.findall(text))):
                parts = [p for p in self.special.split(text) if p]
                out[i] = found
            for part in parts:
                pieces = self._pieces(part)
                try:
                    out[i] += sum(map(known.__getitem__, pieces))
                except KeyError:
                    new.update(pieces)
                    waiting.append((i, part, pieces))
        if waiting:
            new -= known.keys()
            odd = {p for p in new if self.odd(p)}
            new -= odd
            whole = {part for _, part, pieces in waiting if odd and not odd.isdisjoint(pieces)}
            learnt = self._learn(new | whole)
            for i, part, pieces in waiting:
                out[i] += learnt[part] if part in whole else sum(learnt[p] if p in learnt else known[p] for p in pieces)
            known.update((p, n) for p, n in learnt.items() if len(p) <= 64 and p in new)
        return out


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``; a null or empty text has neither.

    Each row is counted by itself, so repeated rows and clashing ids change nothing; columns named
    like a result give way. At most about ``slice_bytes`` of text, or one longer text, is held as arrays at a time.
    """

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = resident(("token counts", tokenizer), lambda: TokenCounter(tokenizer))
        texts, counts, at = raw(batch, text), [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < slice_bytes):
                size += len(texts[end] or b"")
                end += 1
            counts += counter.counts(texts[at:end])
            at = end
        return [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counts, pa.int64())]

    return append(docs, "n_bytes long, n_tokens long", each)


TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024


def query(spark, sf_dir: str) -> DataFrame:
    """op3: token counts of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
