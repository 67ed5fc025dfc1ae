"""The query language: parser, tree, and the tree as expressions over term positions.

Grammar: terms, ``term*``, "phrases", ``a + b`` (phrase concatenation), ``^first``, ``NEAR(a b, n)``, parentheses, and the
upper-case operators NOT, AND, OR. Terms side by side bind tightest, then NOT (from the left), then AND, then OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions import porter
from ..functions.text import sanitize, tokens_py


class QuerySyntaxError(ValueError):
    """The query can't be read."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; the last may be a prefix, the first may have to open the text."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    args: tuple = field(default_factory=tuple)


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()+^,:{}*])|([^\s"()+^,:{}*]+))')


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QuerySyntaxError(f"can't read {text[at:]!r}")
        if m.group(1) is not None:
            out.append(("string", m.group(1)[1:-1].replace('""', '"')))
        elif m.group(2):
            out.append((m.group(2), m.group(2)))
        else:
            w = m.group(3)
            out.append((w if w in ("AND", "OR", "NOT") else "word", w))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, stemmed: bool):
        self.toks, self.at, self.stemmed = _lex(text), 0, stemmed

    def peek(self, k: int = 0) -> str | None:
        return self.toks[self.at + k][0] if self.at + k < len(self.toks) else None

    def next(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.toks) or (want and self.toks[self.at][0] != want):
            raise QuerySyntaxError(f"syntax error near {self.toks[self.at][1] if self.at < len(self.toks) else 'the end'!r}")
        self.at += 1
        return self.toks[self.at - 1]

    def parse(self):
        if not self.toks:
            raise QuerySyntaxError("empty query")
        out = self.either()
        if self.peek() is not None:
            self.next("end")
        return out

    def either(self):
        args = [self.both()]
        while self.peek() == "OR":
            self.next()
            args.append(self.both())
        return args[0] if len(args) == 1 else Op("or", tuple(args))

    def both(self):
        args = [self.without()]
        while self.peek() == "AND":
            self.next()
            args.append(self.without())
        return args[0] if len(args) == 1 else Op("and", tuple(args))

    def without(self):
        out = self.side_by_side()
        while self.peek() == "NOT":
            self.next()
            out = Op("not", (out, self.side_by_side()))
        return out

    def side_by_side(self):
        args = [self.unit()]
        while self.peek() in ("string", "word", "(", "^"):
            args.append(self.unit())
        return args[0] if len(args) == 1 else Op("and", tuple(args))

    def unit(self):
        if self.peek() == "(":
            self.next()
            out = self.either()
            self.next(")")
            return out
        if self.peek() == "word" and self.toks[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases = []
            while self.peek() in ("string", "word", "^"):
                phrases.append(self.phrase())
            distance = 10
            if self.peek() == ",":
                self.next()
                distance = int(self.next("word")[1])
            self.next(")")
            return Near(tuple(p for p in phrases if p.terms), distance)
        if self.peek() == "word" and self.peek(1) == ":":
            column = self.next()[1]
            self.next(":")
            inner = self.unit()
            return inner if column == "content" else Op("none")
        return self.phrase()

    def phrase(self) -> Phrase:
        first = self.peek() == "^"
        if first:
            self.next()
        terms, prefix = self.string()
        while self.peek() == "+":
            self.next()
            more, prefix = self.string()
            terms += more
        return Phrase(tuple(terms), prefix and bool(terms), first)

    def string(self) -> tuple[list[str], bool]:
        if self.peek() not in ("string", "word"):
            self.next("word")
        terms = tokens_py(self.next()[1])
        prefix = self.peek() == "*"
        if prefix:
            self.next()
        return [porter.stem(t) if self.stemmed else t for t in terms], prefix


def parse(query: str, stemmed: bool = True):
    """The tree of a query text that has been sanitized."""
    return _parser_result(_Parser(query, stemmed).parse())


def _parser_result(node):
    out = _drop_empty(node)
    return out if out is not None else Op("none")


def _drop_empty(node):
    """Phrases without a token are ignored beside others, and match nothing alone."""
    if isinstance(node, Phrase):
        return node if node.terms else None
    if isinstance(node, Near):
        return node if node.phrases else None
    if node.kind == "none":
        return node
    args = [_drop_empty(a) for a in node.args]
    if node.kind == "not":
        return args[0] if args[1] is None else None if args[0] is None else Op("not", tuple(args))
    args = [a for a in args if a is not None]
    return None if not args else args[0] if len(args) == 1 else Op(node.kind, tuple(args))


def plan(raw: str, stemmed: bool = True):
    """Sanitizes and parses what a user typed."""
    return parse(sanitize(raw), stemmed)


def leaves(node) -> list[Phrase]:
    """Every phrase of the tree in order, repeats included."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return [x for a in node.args for x in leaves(a)]
