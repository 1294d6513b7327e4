"""CQL search: condition, sort, page and projection of one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cql.bind import And, Reader, bind, to_column
from ..cql.parser import Key
from ..errors import QueryError, ValidationError
from ..model import Resource, is_stored
from ..plans import index

MOST_RESULTS = 10_000
MOST_PAGE = 500
DEFAULT_PAGE = 100


def order(keys: tuple[Key, ...], resource: Resource, columns: list[str]) -> list[Column]:
    """Sort columns, normalised as their fields are: a collection takes its least value ascending, its greatest descending; missing
    values come last; then the key."""
    out, reader = [], Reader(columns)
    for key in keys:
        f = next((x for x in (resource.get(key.index), resource.get(f"sort_{key.index}")) if x is not None and "sort" in x.uses), None)
        if f is None:
            raise QueryError("Sort field not found or cannot be used.")
        for path in (f.path, *f.sort):
            g = resource.get(path) or f
            c = reader.norm(resource.get(path)) if resource.get(path) is not None else F.col(path)
            if g.many:
                c = F.array_max(c) if key.descending else F.array_min(c)
            out.append(c.desc_nulls_last() if key.descending else c.asc_nulls_last())
    return [*out, F.col(resource.key).asc_nulls_last()]


def page(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """Rows of a page; all of them from ``offset`` on where ``limit`` is None."""
    if limit is None:
        if offset < 0:
            raise ValidationError("offset should be 0 or more")
        return df.offset(offset) if offset else df
    if offset + limit > MOST_RESULTS:
        raise ValidationError("The sum of limit and offset should not exceed 10000.")
    if not 0 <= limit <= MOST_PAGE or offset < 0:
        raise ValidationError(f"limit should be between 0 and {MOST_PAGE}, offset 0 or more")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def matched(df: DataFrame, cql: str, resource: Resource, extra=None) -> DataFrame:
    """All rows that match, unordered."""
    node, _ = bind(cql, resource)
    return df.where(to_column(And((node, extra)) if extra is not None else node, resource, df.columns))


def shown(resource: Resource, include: list[str] | None, expand_all: bool) -> list[str] | None:
    """Columns to return; None for all."""
    if expand_all:
        return None
    paths = [f.path for f in resource.fields if f.shown] + [p for p in include or [] if resource.get(p) is not None]
    return list(dict.fromkeys(p.split(".")[0] for p in [resource.key, *paths]))


def search(
    df: DataFrame,
    cql: str,
    resource: Resource,
    limit: int | None = DEFAULT_PAGE,
    offset: int = 0,
    include: list[str] | None = None,
    expand_all: bool = False,
    affiliation: Column | None = None,
    inverted: index.Inverted | None = None,
    grams: index.Grams | None = None,
) -> DataFrame:
    """A page of the matching rows, or with ``limit`` None all of them in their order.  Without sortBy the order is that of relevance, best first, if ``inverted`` is there to score
    full-text conditions with, and then that of the key; such conditions, and with ``grams`` those with wildcards, are looked up there."""
    node, keys = bind(cql, resource)
    found = index.filtered(df, node, resource, inverted, grams)
    if affiliation is not None:
        found = found.where(affiliation)
    names = shown(resource, include, expand_all)
    by = order(keys, resource, df.columns)
    if inverted is not None and not keys and (scored := index.scoring(node)):
        found, by = index.ranked(found, scored, inverted, resource.key), [F.desc("score"), *by]
    paged = page(found.orderBy(*by), limit, offset)
    if "score" in found.columns and "score" not in df.columns:
        paged = paged.drop("score")
    return paged.select(*[c for c in names if c in df.columns]) if names is not None else paged.drop(*[c for c in df.columns if is_stored(c)])


def total(df: DataFrame, cql: str, resource: Resource) -> int:
    """Exact number of matches."""
    return matched(df, cql, resource).count()
