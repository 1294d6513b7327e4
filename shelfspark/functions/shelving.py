"""Shelving keys: strings whose order is the order of call numbers on a shelf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHMS = ("DEFAULT", "LC", "DEWEY", "NLM", "SUDOC")


def sortable(digits: Column) -> Column:
    """Number with its length in front, without leading zeros: text order is then numeric order."""
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.concat(F.length(plain).cast("string"), plain)


def sudoc_key(c: Column) -> Column:
    """Tokens with a rank in front: separators below letters, letters below years, years below other numbers.

    Blanks do not matter.  A number of 3 or 4 digits anywhere behind the first colon is a year."""
    tokens = F.regexp_extract_all(c, F.lit(r"([A-Za-z]+|\d+|[:/.\-])"), F.lit(1))
    colon = F.array_position(tokens, ":")

    def key(t: Column, i: Column) -> Column:
        year = (colon > 0) & (i + 1 > colon) & F.length(t).between(3, 4)
        number = F.concat(F.when(year, F.lit("2")).otherwise(F.lit("3")), sortable(t))
        return F.when(t == ".", "01").when(t == ":", "02").when(t == "-", "03").when(t == "/", "04").when(t.rlike("^[A-Za-z]"), F.concat(F.lit("1"), F.upper(t))).otherwise(number)

    return F.array_join(F.transform(tokens, key), " ")


def _classed(c: Column, head: str) -> Column:
    """Class letters, sortable class number with its decimals, then cutters as they are and years as sortable numbers."""
    v = F.upper(F.trim(c))
    whole = rf"^({head})\s*([0-9]+)(\.[0-9]+)?(.*)$"
    letters, number, decimals, rest = (F.regexp_extract(v, whole, i) for i in (1, 2, 3, 4))
    parts = F.filter(F.split(F.regexp_replace(rest, r"[.\s]+", " "), " "), lambda x: x != "")
    tail = F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), sortable(x)).otherwise(x))
    key = F.array_join(F.array_compact(F.concat(F.array(F.when(letters != "", letters), F.concat(sortable(number), decimals)), tail)), " ")
    return F.when(v.rlike(whole), key)


def shelving_key(c: Column, algorithm: str) -> Column:
    """Key of ``c``; null where the value is no number of that scheme."""
    if algorithm == "SUDOC":
        return sudoc_key(c)
    if algorithm == "DEWEY":
        return _classed(c, "")
    if algorithm in ("LC", "NLM"):
        return _classed(c, "[A-Z]{1,3}")
    if algorithm == "DEFAULT":
        return F.upper(F.trim(c))
    raise ValueError(f"unknown shelving algorithm {algorithm}; one of {ALGORITHMS}")


def shelving_orders(c: Column, algorithms: tuple[str, ...] = ALGORITHMS) -> dict[str, Column]:
    """A derived field for each algorithm: ``defaultShelvingOrder``, ``lcShelvingOrder`` and so on."""
    return {f"{a.lower()}ShelvingOrder": shelving_key(c, a) for a in algorithms}
