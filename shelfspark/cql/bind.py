"""Binding: CQL tree plus resource descriptor to a predicate tree, and predicate trees to columns.

The predicate tree keeps conditions on filter fields apart from the rest where facets and browsing need that.
Negation is two-valued: a document without the field matches NOT.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import analysis
from ..errors import QueryError, UnsupportedError
from ..functions import stemming
from ..model import Field, Resource
from .parser import Boolean, Clause, Query, parse

RANGES: dict[str, Callable[[Column, Column], Column]] = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Match:
    """``op`` of true, exists, absent, eq, in, all, any, phrase, plain, wild, or a range comparator; ``raw``: a range's term as it was typed."""

    fields: tuple[Field, ...]
    op: str
    value: object = None
    raw: str | None = None

    @property
    def filter(self) -> bool:
        return len(self.fields) == 1 and "filter" in self.fields[0].uses


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


TRUE = Match((), "true")


def joined(kind: type, left, right):
    """One flat node where possible."""
    parts = (*(left.parts if isinstance(left, kind) else (left,)), *(right.parts if isinstance(right, kind) else (right,)))
    return kind(parts)


def bind(text: str | Query, resource: Resource) -> tuple[object, tuple]:
    """(predicate tree, sort keys) of a query."""
    query = parse(text, resource.name) if isinstance(text, str) else text
    return _bind(query.root, resource), query.keys


def _bind(node: Clause | Boolean, resource: Resource):
    if isinstance(node, Boolean):
        if node.op == "prox":
            raise UnsupportedError("Operator 'PROX' is not supported")
        left, right = _bind(node.left, resource), _bind(node.right, resource)
        if node.op == "not":
            return joined(And, left, Not(right))
        return joined(And if node.op == "and" else Or, left, right)
    return _clause(node, resource)


def _clause(c: Clause, resource: Resource):
    term = c.term.replace("\\\\", "\\")
    name, relation = c.index, c.relation
    if name == "cql.allRecords" and relation == "=" and term.strip() == "1":
        return TRUE
    if name in ("keyword", "cql.serverChoice") and "".join(term.split()) == "*":
        return TRUE
    if name == "cql.serverChoice":
        name = "keyword"
    fields, aliased = resource.resolve(name)
    one = fields[0]
    if relation not in (*RANGES, "=", "==", "<>", "all", "any", "adj"):
        raise QueryError(f"Comparator '{relation}' is not supported")
    process = next((f.term for f in fields if f.term), None)
    if process and term:
        done = process(term)
        if isinstance(done, (list, tuple)):
            return Match(tuple(fields), "in", tuple(done)) if done else TRUE
        term = done if done is not None else term
    if relation in RANGES:
        if len(fields) > 1 or one.text:
            raise UnsupportedError(f"Query is not supported yet [operator(s): {relation}, field(s): {[f.path for f in fields]}]")
        return Match((one,), relation, _literal(one, term), term)
    if "*" in term:
        return _negated(relation, Match(tuple(fields), "wild", term))
    text = aliased or one.text
    if term == "" and relation in ("=", "all", "any", "adj") and len(fields) == 1:
        return Match((one,), "exists")
    if relation == "==":
        if term == "[]" and (one.text or one.type == "keyword"):
            return Match(tuple(fields), "absent")
        if text:
            return Match(tuple(fields), "plain" if "string" in c.modifiers or term == "" else "phrase", term)
        return Match((one,), "eq", _literal(one, term))
    if not text:
        return _negated(relation, Match((one,), "eq", _literal(one, term)))
    return _negated(relation, Match(tuple(fields), "any" if relation == "any" else "all", term))


def _negated(relation: str, match):
    return Not(match) if relation == "<>" else match


def _literal(f: Field, term: str):
    """The term as a value of the field's type."""
    if f.type == "date":
        try:
            return datetime.fromisoformat(term.replace("Z", "+00:00"))
        except ValueError as e:
            raise QueryError("Invalid date format") from e
    try:
        if f.type in ("long", "short"):
            return int(term)
        if f.type == "double":
            return float(term)
    except ValueError as e:
        raise QueryError(f"Invalid number in the CQL query: {term}") from e
    if f.type == "bool":
        return term.strip().lower() == "true"
    return analysis.normalised_text(f.type, term)


class Reader:
    """Columns of a table's fields, taken from normalised copies where the table has them (see ``plans.index``)."""

    def __init__(self, columns: list[str], element: Column | None = None, nested: str | None = None, resource: Resource | None = None):
        self.columns, self.element, self.nested = set(columns), element, nested
        self.languages = tuple(x for x in resource.languages if x in stemming.LANGUAGES) if resource is not None and element is None else ()
        self.language_path = resource.language_path if resource is not None else None

    def stored(self, prefix: str, path: str) -> Column | None:
        name = f"{prefix}__{path.replace('.', '__')}"
        return F.col(name) if self.element is None and name in self.columns else None

    def raw(self, f: Field) -> Column:
        if self.element is not None:
            out = self.element
            for step in f.path.removeprefix(self.nested + ".").split("."):
                out = out.getField(step)
            return out
        return F.col(f.path)

    def many(self, f: Field) -> bool:
        return f.many and self.element is None

    def norm(self, f: Field) -> Column:
        found = self.stored("norm", f.path)
        if found is not None:
            return found
        if f.type not in analysis.NORMALISERS and not f.text or f.type in ("keyword", "source"):
            return self.raw(f)
        return F.transform(self.raw(f), lambda x: analysis.normalised(f.type, x)) if self.many(f) else analysis.normalised(f.type, self.raw(f))

    def each(self, f: Field, analyser: Callable[[Column], Column], prefix: str) -> Column:
        """Array of token arrays, one for each value."""
        found = self.stored(prefix, f.path)
        if found is not None:
            return found
        if not f.text:
            return F.transform(self.norm(f) if self.many(f) else F.array(self.norm(f)), lambda x: F.array(x))
        raw = self.raw(f) if self.many(f) else F.array(self.raw(f))
        return F.transform(raw, analyser)

    def tokens(self, f: Field) -> Column:
        return F.flatten(self.each(f, analysis.tokens, "tok"))

    def finds(self, f: Field, pattern: str) -> Column | None:
        """Whether a value of a text field that has no stored tokens finds the pattern once folded; nothing is split for it."""
        if not f.text or self.stored("tok", f.path) is not None:
            return None
        test = lambda c: F.rlike(analysis.read(c), F.lit(pattern))
        return F.exists(self.raw(f), test) if self.many(f) else test(self.raw(f))

    def has(self, f: Field, word: str) -> Column:
        found = self.finds(f, analysis.token_pattern(word))
        return nz(F.array_contains(self.tokens(f), word) if found is None else found)

    def phrases(self, f: Field) -> Column:
        return self.each(f, analysis.base_tokens, "base")

    def spoken(self, f: Field, language: str, every: bool = True) -> Column:
        """Array of token arrays, one for each value, of a record in the language; null for another record."""
        return F.when(F.array_contains(self.language_path, language), self.each(f, lambda x: analysis.language_tokens(language, x, every), f"{'tok' if every else 'base'}_{language}"))

    def in_language(self, m: Match, test: Callable[[str, list[str], list[Field]], Column]) -> list[Column]:
        """``test`` of (language, the term's words in it, fields) for each language that fields are analysed in."""
        fields = [f for f in m.fields if f.type == "multilang"]
        found = [(x, list(dict.fromkeys(analysis.language_words(x, m.value)))) for x in self.languages] if fields else []
        return [nz(test(language, words, fields)) for language, words in found if words]


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def _value(reader: Reader, f: Field, c: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(c, test) if reader.many(f) else test(c)


def like(term: str) -> tuple[str, str]:
    """(kind, text) of a wildcard term: ``prefix`` with its text, or ``like`` with a pattern."""
    inner = term.rstrip("*")
    if term.endswith("*") and "*" not in inner and "?" not in inner:
        return "prefix", inner
    return "like", re.sub(r"([\\%_])", r"\\\1", term).replace("*", "%").replace("?", "_")


def _wild(reader: Reader, f: Field, term: str) -> Column:
    kind, text = like(analysis.normalised_text(f.type, term))
    test = (lambda x: x.startswith(text)) if kind == "prefix" else (lambda x: x.like(text))
    if text in ("", "%"):
        return _exists(reader, f)
    return _value(reader, f, reader.norm(f), test)


def _exists(reader: Reader, f: Field) -> Column:
    raw = reader.raw(f)
    return raw.isNotNull() & (F.size(raw) > 0) if reader.many(f) else raw.isNotNull()


def _overlap(reader: Reader, f: Field, words: list[str]) -> Column:
    found = reader.finds(f, "|".join(f"(?:{analysis.token_pattern(w)})" for w in words))
    return nz(F.arrays_overlap(reader.tokens(f), F.array(*[F.lit(w) for w in words])) if found is None else found)


def _equals(f: Field, term: str) -> Callable[[Column], Column]:
    text = F.lit(analysis.normalised_text(f.type, term))
    return lambda c: c == text


def leaf(m: Match, reader: Reader) -> Column:
    f = m.fields[0] if m.fields else None
    if m.op == "true":
        return F.lit(True)
    if m.op == "exists":
        return _exists(reader, f)
    if m.op == "absent":
        return _all([~_exists(reader, x) for x in m.fields])
    if m.op == "wild":
        return _any([nz(_wild(reader, x, m.value)) for x in {x.path: x for x in m.fields}.values()])
    if m.op == "eq":
        return _value(reader, f, reader.norm(f), lambda x: x == F.lit(m.value))
    if m.op == "in":
        return _any([nz(_value(reader, x, reader.norm(x), lambda c: c.isin(*m.value))) for x in m.fields])
    if m.op in RANGES:
        return _value(reader, f, reader.norm(f), lambda x: RANGES[m.op](x, F.lit(m.value)))
    if m.op == "plain":
        return _any([nz(_value(reader, x, reader.norm(x), _equals(x, m.value))) for x in m.fields])
    if m.op == "phrase":
        words = analysis.text_tokens(m.value)
        wanted = f" {' '.join(words)} "

        def phrase(x: Field) -> Column:
            if not x.text:
                return _value(reader, x, reader.norm(x), _equals(x, m.value))
            found = reader.finds(x, analysis.phrase_pattern(words)) if words else None
            if found is not None:
                return found
            return F.exists(reader.phrases(x), lambda t: F.contains(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), F.lit(wanted)))

        def spoken(language: str, _: list[str], fields: list[Field]) -> Column:
            wanted = f" {' '.join(analysis.language_words(language, m.value))} "
            return _any([nz(F.exists(reader.spoken(x, language, False), lambda t: F.contains(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), F.lit(wanted)))) for x in fields])

        return _any([*[nz(phrase(x)) for x in m.fields], *reader.in_language(m, spoken)])
    words = list(dict.fromkeys(analysis.text_tokens(m.value)))
    if m.op == "any":
        parts = [_overlap(reader, x, words) for x in m.fields if x.text and words]
        parts += [nz(_value(reader, x, reader.norm(x), _equals(x, m.value))) for x in m.fields if not x.text]
        parts += reader.in_language(m, lambda language, own, fields: _any([nz(F.arrays_overlap(F.flatten(reader.spoken(x, language)), F.array(*map(F.lit, own)))) for x in fields]))
        return _any(parts)
    # all: every token in at least one of the fields that share an analyser; a keyword field has the whole term or not
    texts = [x for x in m.fields if x.text]
    if len(texts) == 1 and words and not reader.many(texts[0]):  # one pass over the text for all words
        found = reader.finds(texts[0], "(?s)\\A" + "".join(f"(?=.*?(?:{analysis.token_pattern(w)}))" for w in words))
        parts = [_all([reader.has(texts[0], w) for w in words]) if found is None else nz(found)]
    else:
        parts = [_all([_any([reader.has(x, w) for x in texts]) for w in words])] if texts and words else []
    parts += [nz(_value(reader, x, reader.norm(x), _equals(x, m.value))) for x in m.fields if not x.text]
    parts += reader.in_language(m, lambda language, own, fields: _all([_any([nz(F.array_contains(F.flatten(reader.spoken(x, language)), w)) for x in fields]) for w in own]))
    return _any(parts)


def to_column(node, resource: Resource, columns: list[str], reader: Reader | None = None) -> Column:
    """The condition as one column without nulls."""
    reader = reader or Reader(columns, resource=resource)
    if isinstance(node, Match):
        return nz(leaf(node, reader))
    if isinstance(node, Not):
        return ~to_column(node.part, resource, columns, reader)
    if isinstance(node, Or):
        return _any([to_column(p, resource, columns, reader) for p in node.parts])
    inner = [p for p in node.parts if resource.nested and isinstance(p, Match) and p.fields and all(f.path.startswith(resource.nested + ".") for f in p.fields)]
    if len(inner) > 1:  # conditions on one nested array have to hold for one element
        rest = [to_column(p, resource, columns, reader) for p in node.parts if p not in inner]
        nested = F.exists(F.col(resource.nested), lambda x: _all([nz(leaf(p, Reader(columns, x, resource.nested))) for p in inner]))
        return _all([*rest, nz(nested)])
    return _all([to_column(p, resource, columns, reader) for p in node.parts])


def split_filters(node) -> tuple[object, list]:
    """(query without filters, filter conditions): conjuncts on filter fields, and disjunctions of terms on one of them."""
    parts = node.parts if isinstance(node, And) else (node,)
    filters = [p for p in parts if filter_field(p)]
    rest = [p for p in parts if p not in filters]
    return (And(tuple(rest)) if len(rest) != 1 else rest[0]) if rest else TRUE, filters


def filter_field(node) -> str | None:
    """The filter field that a condition is on, if it is on one alone."""
    if isinstance(node, Match):
        return node.fields[0].path if node.filter else None
    if isinstance(node, Or):
        found = {filter_field(p) for p in node.parts}
        return found.pop() if len(found) == 1 else None
    return None


def terms_of(node) -> list:
    """Values that a filter condition selects by equality."""
    if isinstance(node, Match):
        return [node.value] if node.op == "eq" else list(node.value) if node.op == "in" else []
    return [v for p in node.parts for v in terms_of(p)]
