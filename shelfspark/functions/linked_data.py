"""Derived fields of linked-data works and authorities.  ``None`` instances count as none; values are distinct and not blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import isbn, no_space


def values(array: Column, name: str) -> Column:
    """A field of an array of structs, without blanks and repeats."""
    found = F.transform(array, lambda x: x[name])
    return F.coalesce(F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (F.trim(v) != ""))), F.array().cast("array<string>"))


def work_and_instances(work: Column, instances: Column, field: str, name: str) -> Column:
    """Values of a field of the work and of its instances together."""
    inner = F.flatten(F.array_compact(F.transform(instances, lambda i: i[field])))
    return F.array_distinct(F.concat(values(work, name), values(inner, name)))


def sort_title(titles: Column, name: str = "value") -> Column:
    """All titles, one behind the other."""
    return F.nullif(F.array_join(values(titles, name), ""), F.lit(""))


def of_type(identifiers: Column, kind: str) -> Column:
    return F.filter(identifiers, lambda x: F.lower(x["type"]) == kind.lower())


def isbns(identifiers: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(values(of_type(identifiers, "ISBN"), "value"), isbn)))


def lccns(identifiers: Column) -> Column:
    return F.array_distinct(F.transform(values(of_type(identifiers, "LCCN"), "value"), no_space))


def classification_numbers(classifications: Column, name: str = "number") -> Column:
    return F.array_distinct(F.transform(values(classifications, name), no_space))


def identifier_values(identifiers: Column) -> Column:
    """All identifiers of an authority, as they are searched."""
    return F.array_distinct(F.transform(values(identifiers, "value"), no_space))
