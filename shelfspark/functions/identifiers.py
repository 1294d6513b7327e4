"""Standard numbers: ISBN, ISSN, OCLC and LCCN."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the printed forms of an ISBN that are taken for one, by the standard's parts (prefix, group, publisher, title, check)
_GAP = r"[-\s]"
ISBN13 = rf"^(?:978|979)(?:\d{{10}}|{_GAP}\d{{1,5}}{_GAP}\d{{1,7}}{_GAP}\d{{1,6}}{_GAP}\d)"
ISBN10 = rf"^(?:\d{{9}}[\dX]|\d{{1,5}}{_GAP}\d{{1,7}}{_GAP}\d{{1,6}}{_GAP}[\dX])"
ISBN_TYPES = ("ISBN", "Invalid ISBN")
ISSN_TYPES = ("ISSN", "Invalid ISSN", "Linking ISSN")
OCLC_TYPES = ("OCLC", "Cancelled OCLC")
LCCN_TYPES = ("LCCN",)
CANCELED_LCCN_TYPES = ("Canceled LCCN",)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _weighted(digits: Column, weight, n: int) -> Column:
    return sum((F.substring(digits, i + 1, 1).cast("int") * weight(i) for i in range(n)), F.lit(0))


def isbn(c: Column) -> Column:
    """Array of normalised forms: an ISBN-13 as digits; a valid ISBN-10 as itself and as ISBN-13; then what stands
    behind the number.  Anything else loses the hyphens and blanks between digits.

    The value is lower-cased before matching, so a number that ends in X is taken as anything else."""

    def forms(m: Column) -> Column:
        v, long, short = m["v"], m["long"], m["short"]
        behind = lambda x: F.nullif(F.trim(F.substring(v, F.length(x) + 1, F.length(v))), F.lit(""))
        plain = F.array(F.regexp_replace(v, r"(?<=\d)[ -](?=\d)", ""))

        def of_ten(ten: Column) -> Column:
            nine = F.concat(F.lit("978"), F.substring(ten, 1, 9))
            check = (F.lit(10) - _weighted(nine, lambda i: 1 + 2 * (i % 2), 12) % 10) % 10
            valid = (F.length(ten) == 10) & (_weighted(ten, lambda i: 10 - i, 10) % 11 == 0)
            return F.when(F.coalesce(valid, F.lit(False)), F.array_compact(F.array(ten, F.concat(nine, check.cast("string")), behind(short)))).otherwise(plain)

        return (
            F.when(v == "", F.array().cast("array<string>"))
            .when(long != "", F.array_compact(F.array(F.regexp_replace(long, "[- ]", ""), behind(long))))
            .when(short != "", once(F.regexp_replace(short, "[- ]", ""), of_ten))
            .otherwise(plain)
        )

    matched = lambda v: F.struct(v.alias("v"), F.regexp_extract(v, ISBN13, 0).alias("long"), F.regexp_extract(v, ISBN10, 0).alias("short"))
    return F.when(c.isNotNull(), once(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), lambda v: once(matched(v), forms)))


def oclc(c: Column) -> Column:
    """Blanks become hyphens; the first run of digits and hyphens that starts with 1 to 9; a final ``*`` stays; null if there is none."""
    v = F.regexp_replace(F.trim(c), r"\s+", "-")
    found = F.regexp_extract(v, r"([1-9][\d\-]*)", 1)
    return F.when(found != "", F.concat(found, F.when(v.endswith("*"), F.lit("*")).otherwise(F.lit(""))))


def no_space(c: Column) -> Column:
    """LCCN: without white space, lower case."""
    return F.lower(F.regexp_replace(c, r"\s", ""))


def of_types(identifiers: Column, types: tuple[str, ...], value: str = "value", kind: str = "type") -> Column:
    """Values of the identifiers that have one of the types."""
    return F.transform(F.filter(identifiers, lambda x: x[kind].isin(*types)), lambda x: x[value])


def isbns(identifiers: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(of_types(identifiers, ISBN_TYPES), isbn)))


def issns(identifiers: Column) -> Column:
    return F.array_distinct(F.transform(of_types(identifiers, ISSN_TYPES), lambda x: F.trim(x)))


def oclcs(identifiers: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(of_types(identifiers, OCLC_TYPES), oclc)))


def lccns(identifiers: Column, canceled: bool = False) -> Column:
    return F.array_distinct(F.transform(of_types(identifiers, CANCELED_LCCN_TYPES if canceled else LCCN_TYPES), no_space))


def oclc_term(term: str) -> str | None:
    m = re.search(r"[1-9][\d\-]*", re.sub(r"\s+", "-", term.strip()))
    return m[0] + ("*" if term.strip().endswith("*") and not m[0].endswith("*") else "") if m else None


def no_space_term(term: str) -> str:
    return re.sub(r"\s", "", term).lower()


def isbn_values(value: str) -> list[str]:
    """``isbn`` of one Python string, for query terms."""
    v = re.sub(r"\s+", " ", value.strip()).lower()
    if not v:
        return []
    m = re.match(ISBN13, v, re.A)
    if m:
        rest = v[m.end() :].strip()
        return [re.sub("[- ]", "", m[0]), *([rest] if rest else [])]
    m = re.match(ISBN10, v, re.A)
    ten = re.sub("[- ]", "", m[0]) if m else ""
    if len(ten) == 10 and sum((10 - i) * int(d) for i, d in enumerate(ten)) % 11 == 0:
        nine, rest = "978" + ten[:9], v[m.end() :].strip()
        check = -sum((1 + 2 * (i % 2)) * int(d) for i, d in enumerate(nine)) % 10
        return [ten, f"{nine}{check}", *([rest] if rest else [])]
    return [re.sub(r"(?<=\d)[ -](?=\d)", "", v)]


def isbn_term(term: str) -> str | None:
    found = isbn_values(term)
    return found[0] + ("*" if term.endswith("*") and not found[0].endswith("*") else "") if found else None
