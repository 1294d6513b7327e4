"""Resource descriptors: which fields a resource has, of which type, and what a search may do with them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .analysis import TEXT
from .errors import QueryError

LONGS = ("long", "short")
_STORED = re.compile(r"norm__|(?:tok|base)(?:_[a-z]{3})?__")


def is_stored(column: str) -> bool:
    """Whether a column is a stored copy of a field (``plans.index``)."""
    return _STORED.match(column) is not None


@dataclass(frozen=True)
class Field:
    """``path``: column, dotted for fields of structs; ``many``: an array of values.

    ``uses``: any of facet, filter, sort.  ``term``: function on a query term, None for no result.
    ``array``: physical array-of-struct column whose elements the path is in, flattened unless the resource nests it."""

    path: str
    type: str = "keyword"
    many: bool = False
    uses: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    term: Callable[[str], str | None] | None = None
    shown: bool = True
    plain: bool = True
    sort: tuple[str, ...] = ()
    default: object = None

    @property
    def text(self) -> bool:
        return self.type in TEXT


@dataclass(frozen=True)
class Resource:
    """``languages``: those whose analysers full-text fields of type ``multilang`` have beside the common one; a record is read by those
    that its ``language_path`` names."""

    name: str
    fields: tuple[Field, ...]
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    nested: str | None = None
    rename: tuple[tuple[str, str], ...] = ()
    key: str = "id"
    languages: tuple[str, ...] = ()
    language_path: str = "languages"

    def get(self, path: str) -> Field | None:
        return next((f for f in self.fields if f.path == path), None)

    def resolve(self, name: str) -> tuple[list[Field], bool]:
        """(fields, whether an alias named them)."""
        for old, new in self.rename:
            if name.startswith(old):
                name = new + name[len(old) :]
        named = list(self.aliases.get(name, ()))
        named += [f.path for f in self.fields if name in f.aliases and f.path not in named]
        if named:
            found = [self.get(p) for p in named]
            return [f for f in found if f is not None], True
        own = self.get(name)
        if own is None or own.type == "source":
            raise QueryError("Invalid search field provided in the CQL query")
        return [own], False

    def facet(self, name: str) -> Field:
        fields = [f for f in (self.get(name), *self.resolve_quiet(name)) if f is not None and "facet" in f.uses]
        if not fields:
            raise QueryError("Invalid facet value")
        return fields[0]

    def resolve_quiet(self, name: str) -> list[Field]:
        try:
            return self.resolve(name)[0]
        except QueryError:
            return []

    def with_fields(self, *more: Field) -> Resource:
        return replace(self, fields=(*self.fields, *more))

    def schema(self) -> T.StructType:
        """Schema of the stored documents; dotted paths become structs, arrays of structs where they hold many."""
        return _struct([(f.path.split("."), f) for f in self.fields if f.type != "none"])


_SPARK = {"bool": T.BooleanType(), "long": T.LongType(), "short": T.ShortType(), "date": T.TimestampType(), "double": T.DoubleType()}


def _struct(paths: list[tuple[list[str], Field]]) -> T.StructType:
    out, groups = [], {}
    for path, f in paths:
        groups.setdefault(path[0], []).append((path[1:], f))
    for name, group in groups.items():
        if group[0][0]:
            inner = _struct(group)
            out.append(T.StructField(name, T.ArrayType(inner) if all(f.many for _, f in group) else inner))
        else:
            f = group[0][1]
            kind = _SPARK.get(f.type, T.StringType())
            meta = {"type": f.type, "uses": list(f.uses), "shown": f.shown}
            out.append(T.StructField(name, T.ArrayType(kind) if f.many and "." not in f.path else kind, True, meta))
    return T.StructType(out)
