"""Secret scans of whole texts, in DataFrame operations only.

Three fixed patterns give the base spans (``assign``, ``access``, ``hex``).  The method adds ``entropy`` spans: a
candidate string is a long run of token characters; a window slides over it, counts of its characters are kept up
to date one character in, one out, and with them the Shannon entropy of the window.  The threshold depends on the
character class of the candidate (hexadecimal or base64).  A span runs from the first to the end of the last
window that reaches it.  Candidates that an allow-list pattern matches, or that touch a base span, are suppressed.

Positions are code points, ends exclusive.  Null texts are empty; empty texts have no spans.  Rows that repeat a
``doc_id`` are scanned each, null ids too.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns, their least lengths, and the order of kinds at one start
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")
TOKEN = "A-Za-z0-9+/_="
#: Matches of one list while positions are summed up.
RUN = 500


@dataclass(frozen=True)
class Scan:
    """``window`` characters; entropies in bits a character; ``allow``: patterns of harmless strings, matched as a whole; ``odd``: a
    candidate in which this is not found is harmless too.  No pattern repeats a group, on which Java's matcher would recurse."""

    window: int = 20
    hex_bits: float = 3.0
    base64_bits: float = 3.7
    allow: tuple[str, ...] = (
        r"[A-Za-z+/_=]+",  # words and paths without a digit
        r"[0-9+/_=]+",  # numbers, dates and rules
        r"(?i:.*(?:example|sample|dummy|placeholder|abcdefghij|0123456789|xxxx).*)",
    )
    # all but numbered words between signs: a start without a letter, a long number, a letter behind a digit, a number without a word inside
    odd: str = r"^[0-9+/_=]|[0-9]{5}|[0-9][A-Za-z]|[+/_=][0-9]{1,4}[^0-9]"


def located(text: Column, pattern: str, kind: int, value: int | None = None, least: int = 0) -> Column:
    """Array of (start, kind, end) of the pattern's leftmost non-overlapping matches; with ``value`` the length of that group has to be ``least``, else the match's.

    Gaps are extracted with the matches, so positions are sums of lengths."""
    whole = f"(?s)\\G(.*?)({pattern})"
    gap, hit = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    parts = [F.transform(gap, F.length).alias("gap"), F.transform(hit, F.length).alias("hit")]
    if value is not None:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(2 + value)), F.length).alias("value"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        enough = (x["value"] if value is not None else x["hit"]) >= least
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["hit"]).alias("end")))
        return F.struct((start + x["hit"]).alias("at"), F.when(enough, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def run(acc, part):
        """A run of matches has a list of its own, so no list is extended more than RUN times, however many there are."""
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out"))), 1)

    found = F.arrays_zip(*parts)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda i: F.slice(found, i * RUN + 1, RUN))
    nothing = F.array().cast("array<array<struct<start:int,kind:int,end:int>>>")
    whole_list = F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), nothing.alias("out")), run, lambda acc: acc["out"]))
    return F.when(F.size(hit) > 0, whole_list).otherwise(none)


def high_entropy(candidate: Column, how: Scan) -> Column:
    """(first, last) of the candidate's windows that reach its class's threshold; nulls if none does."""
    w = how.window
    least = F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(how.hex_bits)).otherwise(F.lit(how.base64_bits))
    code = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    # one character out, one in; -1 is none
    moves = F.flatten(F.transform(code, lambda c, i: F.array(F.struct((-F.lit(1)).alias("by"), F.when(i >= w, F.get(code, i - w)).otherwise(F.lit(-1)).alias("c"), i.alias("i")), F.struct(F.lit(1).alias("by"), c.alias("c"), i.alias("i")))))

    def weight(n):
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(acc, x):
        old = F.coalesce(F.get(acc["n"], x["c"]), F.lit(0))
        total = F.when(x["c"] < 0, acc["total"]).otherwise(acc["total"] - weight(old) + weight(old + x["by"]))
        high = (x["by"] == 1) & (x["i"] >= w - 1) & (F.lit(math.log2(w)) - total / w >= least)
        return F.struct(
            F.when(x["c"] < 0, acc["n"]).otherwise(F.transform(acc["n"], lambda v, j: F.when(j == x["c"], v + x["by"]).otherwise(v))).alias("n"),
            total.alias("total"),
            F.when(high, F.coalesce(acc["first"], x["i"] - (w - 1))).otherwise(acc["first"]).alias("first"),
            F.when(high, x["i"] + 1).otherwise(acc["last"]).alias("last"),
        )

    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(moves, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropies(text: Column, base: Column, how: Scan) -> Column:
    """Array of (start, kind, end) of the entropy spans."""
    run = f"(?<![{TOKEN}])[{TOKEN}]{{{how.window},}}"
    found = located(text, run, 3)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def piece(start, end):
        return F.when(end - start >= how.window, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)

    def rest(s):
        """What the base spans leave of a run, in pieces."""
        touching = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["start"])).alias("out"))
        return F.aggregate(touching, F.struct(s["start"].alias("at"), none.alias("out")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], s["end"])))

    open_ = F.flatten(F.transform(found, rest))
    named = F.transform(open_, lambda s: F.struct(s["start"].alias("start"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("c")))
    allowed = "^(?:" + "|".join(how.allow) + ")$" if how.allow else "^$"
    named = F.filter(named, lambda s: s["c"].rlike(how.odd) & ~s["c"].rlike(allowed))
    judged = F.transform(named, lambda s: F.struct(s["start"].alias("start"), high_entropy(s["c"], how).alias("w")))
    judged = F.filter(judged, lambda s: s["w"]["first"].isNotNull())
    return F.transform(judged, lambda s: F.struct((s["start"] + s["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (s["start"] + s["w"]["last"]).alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, how: Scan = Scan()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, row for row of ``docs``."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text, low = F.col("text"), F.lower("text")
    # cheap tests first: most texts have nothing for a pattern to find
    assign = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.when(assign, located(text, ASSIGN, 0, 1, LEAST["assign"])).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), located(text, ACCESS, 1, None, LEAST["access"])).otherwise(none).alias("access"),
        F.when(text.rlike(f"[0-9a-f]{{{LEAST['hex']}}}"), located(text, HEX, 2, None, LEAST["hex"])).otherwise(none).alias("hex"),
        text.rlike(f"(?<![{TOKEN}])[{TOKEN}]{{{how.window}}}").alias("candidates"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    rows = rows.withColumn("more", F.when(F.col("candidates"), entropies(text, F.col("base"), how)).otherwise(none))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )
