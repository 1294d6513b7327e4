"""Recursive-descent parser of CQL 1.2: booleans of one precedence, left to right, and sortBy at the end."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..errors import QueryError

COMPARATORS = ("==", "<>", "<=", ">=", "=", "<", ">")
BOOLEANS = ("and", "or", "not", "prox")
_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<sign>==|<>|<=|>=|[=<>()/])|(?P<word>[^\s"=<>()/]+))')


@dataclass(frozen=True)
class Clause:
    index: str
    relation: str
    term: str
    modifiers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Boolean:
    op: str
    left: Clause | Boolean
    right: Clause | Boolean


@dataclass(frozen=True)
class Key:
    index: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    root: Clause | Boolean
    keys: tuple[Key, ...] = ()


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected character at {at}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, sign: str) -> None:
        if self.take() != ("sign", sign):
            raise ValueError(f"expected {sign}")

    def word(self) -> str:
        kind, value = self.take()
        if kind == "quoted":
            # a backslash keeps the next character from ending the string; it stays in the term unless that is a quote
            return value[1:-1].replace('\\"', '"')
        if kind != "word":
            raise ValueError("expected a term")
        return value

    def modifiers(self) -> tuple[str, ...]:
        found = []
        while self.peek() == ("sign", "/"):
            self.take()
            name = self.word().lower()
            if self.peek()[0] == "sign" and self.peek()[1] in COMPARATORS:
                name += self.take()[1] + self.word()
            found.append(name)
        return tuple(found)

    def query(self) -> Query:
        root, keys = self.booleans(None), []
        if self.peek()[0] == "word" and self.peek()[1].lower() == "sortby":
            self.take()
            while self.peek()[0] != "end":
                index = self.word()
                keys.append(Key(index, "sort.descending" in self.modifiers()))
            if not keys:
                raise ValueError("sortBy without a key")
        if self.peek()[0] != "end":
            raise ValueError("text behind the query")
        return Query(root, tuple(keys))

    def booleans(self, scope: Clause | None) -> Clause | Boolean:
        left = self.clause(scope)
        while self.peek()[0] == "word" and self.peek()[1].lower() in BOOLEANS:
            op = self.take()[1].lower()
            self.modifiers()
            left = Boolean(op, left, self.clause(scope))
        return left

    def relation(self) -> str | None:
        kind, value = self.peek()
        if kind == "sign" and value in COMPARATORS:
            return value
        if kind == "word" and value.lower() in ("all", "any", "adj", "exact", "within", "encloses") and self.peek(1)[0] in ("quoted", "word", "sign") and self.peek(1)[1].lower() not in BOOLEANS:
            return value.lower()
        return None

    def clause(self, scope: Clause | None) -> Clause | Boolean:
        if self.peek() == ("sign", "("):
            self.take()
            inner = self.booleans(scope)
            self.expect(")")
            return inner
        first = self.word()
        relation = self.relation()
        if relation is None:
            return replace(scope, term=first) if scope else Clause("cql.serverChoice", "=", first)
        self.take()
        whole = Clause(first, relation, "", self.modifiers())
        if self.peek() == ("sign", "("):  # index relation (a or b): the relation goes to each term
            self.take()
            inner = self.booleans(whole)
            self.expect(")")
            return inner
        return replace(whole, term=self.word())


def parse(text: str, resource: str = "") -> Query:
    """Tree of a query, or QueryError."""
    try:
        return _Parser(text).query()
    except (ValueError, IndexError, AttributeError) as e:
        raise QueryError(f"Failed to parse CQL query [cql: '{text}', resource: {resource}]") from e
