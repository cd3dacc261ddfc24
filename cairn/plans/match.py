"""The MATCH grammar of full-text search: a recursive-descent parser to a small tree.

Accepted: words (AND by default), ``AND``, ``OR``, ``NOT``, parentheses, ``"phrases"``, ``prefix*``, ``a + b``
(one phrase), ``^first``, ``column : x``, ``{a b} : x``, ``- column : x`` and ``NEAR(a b, k)``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import regex

from cairn.functions.normalize import fold

COLUMNS = ("text", "context", "vision_text")


class QuerySyntaxError(ValueError):
    """The query does not follow the grammar or names an unknown column."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    gap: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, NOT
    left: object
    right: object


_LEX = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<punct>[():{}+*^,-])|(?P<word>[^\W]+))', re.UNICODE)
_SPLIT = regex.compile(r"[^\p{L}\p{N}\p{Co}\p{Cn}]+")


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip():
        if not (m := _LEX.match(query, at)):
            raise QuerySyntaxError(f"cannot read {query[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, query: str) -> None:
        self.items, self.at = _lex(query), 0

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        kind, text = self.items[min(self.at + ahead, len(self.items) - 1)]
        return kind != "str" and text in texts

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        found = self.items[self.at]
        if kind and found[0] != kind or text and found[1] != text:
            raise QuerySyntaxError(f"unexpected {found[1]!r}")
        self.at += 1
        return found[1]

    def query(self):
        tree = self.either()
        self.take("end")
        return tree

    def either(self):
        left = self.both()
        while self.peek("OR"):
            self.take()
            left = Op("OR", left, self.both())
        return left

    def both(self):
        left = self.without()
        while self.peek("AND"):
            self.take()
            left = Op("AND", left, self.without())
        return left

    def without(self):
        left = self.listed()
        while self.peek("NOT"):
            self.take()
            left = Op("NOT", left, self.listed())
        return left

    def starts(self) -> bool:
        kind, text = self.items[self.at]
        return kind in ("str", "word") and text not in ("AND", "OR", "NOT") or kind == "str" or text in ("(", "{", "^", "-") and kind == "punct"

    def listed(self):
        left = self.scoped()
        while self.starts():
            left = Op("AND", left, self.scoped())
        return left

    def scoped(self):
        negated = self.peek("-")
        if negated:
            self.take()
        names: list[str] | None = None
        if self.peek("{"):
            self.take()
            names = []
            while not self.peek("}"):
                names.append(self.take("word"))
            self.take()
        elif self.items[self.at][0] in ("word", "str") and self.peek(":", ahead=1):
            names = [self.take().strip('"')]
        elif negated:
            raise QuerySyntaxError("a column must follow '-'")
        if names is None:
            return self.primary()
        self.take("punct", ":")
        wrong = [n for n in names if n.lower() not in COLUMNS]
        if wrong:
            raise QuerySyntaxError(f"no such column: {wrong[0]}")
        chosen = tuple(c for c in COLUMNS if (c in {n.lower() for n in names}) != negated)
        return _within(self.primary(), chosen)

    def primary(self):
        if self.peek("("):
            self.take()
            tree = self.either()
            self.take("punct", ")")
            return tree
        if self.peek("NEAR") and self.peek("(", ahead=1):
            self.take()
            self.take()
            phrases = [self.phrase()]
            while not self.peek(")", ","):
                phrases.append(self.phrase())
            gap = 10
            if self.peek(","):
                self.take()
                gap = int(self.take("word"))
            self.take("punct", ")")
            return Near(tuple(phrases), gap)
        return self.phrase()

    def phrase(self) -> Phrase:
        initial = self.peek("^")
        if initial:
            self.take()
        words, prefix = self.string()
        while self.peek("+"):
            self.take()
            more, prefix = self.string()
            words += more
        return Phrase(tuple(words), prefix, initial)

    def string(self) -> tuple[list[str], bool]:
        kind, text = self.items[self.at]
        if kind not in ("word", "str") or kind == "word" and text in ("AND", "OR", "NOT"):
            raise QuerySyntaxError(f"unexpected {text!r}")
        self.at += 1
        words = words_of(text[1:-1].replace('""', '"') if kind == "str" else text)
        prefix = self.peek("*")
        if prefix:
            self.take()
        return words, prefix


def _within(tree, columns: tuple[str, ...]):
    if isinstance(tree, Phrase):
        return replace(tree, columns=tuple(c for c in tree.columns if c in columns))
    if isinstance(tree, Near):
        return Near(tuple(_within(p, columns) for p in tree.phrases), tree.gap)
    return Op(tree.kind, _within(tree.left, columns), _within(tree.right, columns))


def words_of(text: str) -> list[str]:
    """The tokens of a query string, folded as the index folds them."""
    return [w for w in _SPLIT.split(fold(text)) if w]


def parse(query: str):
    return _Parser(query).query()


def parse_or_phrase(query: str) -> tuple[object, str]:
    """The tree, and the query as it took effect: on a syntax error the whole input becomes one phrase."""
    try:
        return parse(query), query
    except QuerySyntaxError:
        quoted = '"' + query.replace('"', '""') + '"'
        return parse(quoted), quoted


def leaves(tree) -> list[Phrase | Near]:
    """Phrases and NEAR groups that add to a score, in order, repeats kept; what NOT excludes adds nothing."""
    if isinstance(tree, Op):
        return leaves(tree.left) + ([] if tree.kind == "NOT" else leaves(tree.right))
    return [tree]
