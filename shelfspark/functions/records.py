"""Derived fields of instances, holdings, items and linked-data works, and keys of child resources."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import analysis


def present(c: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(F.trim(c) != "", c)


def expected(c: Column, most: int) -> Column:
    """Trimmed and cut to ``most`` characters; null becomes empty."""
    return F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, most)


def sha_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined with ``|``; null counts as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"))


def date1(c: Column) -> Column:
    """Year as a number: signs other than digits are 0; longer than 4 or empty is 0."""
    return F.when((F.length(c) <= 4) & (c != ""), F.regexp_replace(c, r"\D", "0").try_cast("short")).otherwise(F.lit(0).cast("short"))


def sort_title(index_title: Column, title: Column) -> Column:
    return F.coalesce(present(index_title), title)


def sort_contributor(contributors: Column) -> Column:
    """Name of the first primary contributor, else of the first."""
    primary = F.filter(contributors, lambda x: F.coalesce(x["primary"], F.lit(False)))
    return F.coalesce(F.get(primary, F.lit(0))["name"], F.get(contributors, F.lit(0))["name"])


def classification_number(c: Column) -> Column:
    """Letters and digits only; null if there are none."""
    return F.nullif(F.regexp_replace(c, "[^a-zA-Z0-9]", ""), F.lit(""))


def classification_ids(classifications: Column) -> Column:
    """Ids of the classification entities of a record: those of ``plans.children.classifications``, once each."""
    ids = F.transform(classifications, lambda x: F.when(expected(x["classificationNumber"], 50) != "", sha_id(expected(x["classificationNumber"], 50), x["classificationTypeId"])))
    return F.array_distinct(F.array_compact(ids))


def holdings_type_ids(holdings: Column) -> Column:
    """Trimmed type ids of the holdings that have one, once each."""
    return tags(F.transform(holdings, lambda h: h["holdingsTypeId"]))


def merged_list(*arrays: Column) -> Column:
    """Elements of all arrays in order, a null array counting as empty."""
    return F.flatten(F.array_compact(F.array(*arrays)))


def merged_set(*arrays: Column) -> Column:
    """As ``merged_list``, each element where it stands first."""
    return F.array_distinct(merged_list(*arrays))


def full_call_number(*parts: Column) -> Column:
    """Trimmed parts that are not blank, joined with a blank."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def normalised_call_number(*parts: Column) -> Column:
    """Lower-case letters and digits of all parts, joined."""
    return F.regexp_replace(F.lower(F.concat_ws("", *parts)), "[^a-z0-9]", "")


def call_number_variants(prefix: Column, number: Column, suffix: Column) -> Column:
    """Normalised with and without the prefix."""
    return F.array_distinct(F.filter(F.array(normalised_call_number(prefix, number, suffix), normalised_call_number(number, suffix)), lambda x: x != ""))


def public_notes(notes: Column) -> Column:
    """Notes that are not for staff only."""
    return F.transform(F.filter(notes, lambda x: ~F.coalesce(x["staffOnly"], F.lit(False))), lambda x: x["note"])


def tags(tag_list: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tag_list, lambda x: F.trim(x) != ""), lambda x: F.trim(x)))


def union_codes(*arrays: Column) -> Column:
    """Distinct values of several arrays that are not blank."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(a, empty) for a in arrays])), lambda x: x.isNotNull() & (F.trim(x) != "")))


def identifiers(former_ids: Column, *values: Column) -> Column:
    return F.array_compact(F.concat(F.coalesce(former_ids, F.array().cast("array<string>")), F.array(*values)))


def uniform_titles(alternatives: Column, kind: str = "Uniform Title") -> Column:
    return F.transform(F.filter(alternatives, lambda x: x["type"] == kind), lambda x: x["alternativeTitle"])


def all_values(df_schema: T.StructType, keep: tuple[str, ...] = ()) -> Callable[[], Column]:
    """All strings of a record, decided from its schema: every field whose name does not end in Id or Ids, arrays and structs too."""

    def walk(kind: T.DataType, c: Column) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(c)
        if isinstance(kind, T.StructType):
            parts = [p for f in kind if f.name in keep or not re.search(r"Ids?$", f.name) if (p := walk(f.dataType, c[f.name])) is not None]
            return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]) if parts else None
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType):
                return c
            inner = walk(kind.elementType, F.lit(None).cast(kind.elementType))
            return F.flatten(F.transform(c, lambda x: walk(kind.elementType, x))) if inner is not None else None
        return None

    def build() -> Column:
        parts = [p for f in df_schema if f.name in keep or not re.search(r"Ids?$", f.name) if (p := walk(f.dataType, F.col(f.name))) is not None]
        empty = F.array().cast("array<string>")
        return F.array_compact(F.concat(*[F.coalesce(p, empty) for p in parts])) if parts else empty

    return build


def call_number_term(term: str) -> str:
    """Prefix search on normalised call numbers."""
    return re.sub("[^a-z0-9]", "", term.lower()) + "*"


def classification_term(term: str) -> str:
    inner = re.sub("[^a-zA-Z0-9]", "", term)
    return ("*" if term.startswith("*") else "") + inner + ("*" if term.endswith("*") else "") if inner else "*"


def call_number_type_term(configs, kind: str = "instance-call-number") -> Callable[[str], list[str] | str]:
    """A browse option's name becomes its type ids; none configured matches all; anything else is taken as it is."""

    def process(term: str):
        option = configs.options.get(kind, {}).get(term.lower())
        return list(option[1]) if option is not None else term

    return process


def multilang(c: Column, languages: Column, configured: tuple[str, ...]) -> Column:
    """Tokens for each configured language the record has, and ``src`` always."""
    toks = analysis.tokens(c)
    return F.struct(*[F.when(F.array_contains(languages, lang), toks).alias(lang) for lang in configured], toks.alias("src"))
