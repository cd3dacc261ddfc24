"""Token ids of whole texts, one distinct chunk at a time."""

from __future__ import annotations

import json
import re

from cairn.llm.batches import Memo

_LOADED: dict = {}
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A capital before another letter or mark: NFC may join the two, and may join a mark to the small letter only.
_MAY_JOIN = re.compile(rb"[A-Z][\x80-\xff]").search
#: The normalizer and pre-tokenizer for which a text is the sum of its chunks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PLAIN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def library_tokenizer(path: str):
    """The tokenizer of ``path``, loaded once in each worker process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def by_chunk(path: str) -> bool:
    """Whether the tokenizer of ``path`` gives a text the ids of its chunks one after another, as ``ChunkEncoder`` cuts them."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    return (
        (found.get("normalizer"), found.get("pre_tokenizer")) == (_NORMALIZER, _PRE_TOKENIZER)
        and not any(found.get(k) for k in ("truncation", "padding"))
        and all("<|" in t["content"] and not re.search(r"\s", t["content"]) and _PLAIN.items() <= t.items() for t in found.get("added_tokens") or [])
    )


class ChunkEncoder:
    """Ids of a text as little-endian bytes, by chunk for tokenizers that lower-case and drop white space.

    Such a tokenizer never looks across a space or line feed, nor across the border between a letter or
    digit and ASCII punctuation that ends a chunk. So each chunk between them is encoded once by the library,
    whatever else it holds, and the ids are joined in order. Chunks with "<|" may hold a special string and stay whole.
    A-Z are lower-cased first to fill the memo faster, but not where NFC, which the tokenizer runs before it
    lower-cases, would then join what it doesn't join in the text. Texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str, width: int) -> None:
        tokenizer = library_tokenizer(path)

        def whole(text: bytes) -> bytes:
            found = tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
            return b"".join([i.to_bytes(width, "little") for i in found])

        def ids(chunk: bytes) -> bytes:
            core = chunk.rstrip(_PUNCTUATION)
            if core and core != chunk and core[-1:].isalnum() and b"<|" not in chunk:
                return self.memo[core] + self.memo[chunk[len(core) :]]
            return whole(chunk)

        self.whole = None if by_chunk(path) else whole
        self.memo = Memo(ids, 1_000_000)

    def __call__(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if self.whole:
            return self.whole(text)
        joins = not text.isascii() and _MAY_JOIN(text)
        special = b"<|" in text  # lower case could bring about a special string
        chunks = (text if joins or special else text.lower()).replace(b"\n", b" ").split(b" ")
        if joins and not special:
            chunks = [c.lower() if c.isascii() else c for c in chunks]
        return b"".join(map(self.memo.__getitem__, chunks))


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def chunk_encoder(path: str, width: int) -> ChunkEncoder:
    """The encoder of a worker process, whose memo later tasks find filled."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = ChunkEncoder(path, width)
    return _ENCODERS[path, width]
