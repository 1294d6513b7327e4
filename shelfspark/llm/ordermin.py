"""Order MinHash fingerprints of whole texts, in DataFrame operations only.

A k-mer is a run of ``k`` pieces together with its occurrence number in the text.  Pieces are words, cut after
``PIECE_CHARS`` characters; a character of a script written without blanks is a piece of its own, so texts without
blanks have k-mers too.  Each of ``size`` hash functions (a 64-bit hash under a mask of its own) selects its two
smallest k-mers; the hash of the two in text order is one component of the fingerprint.  Since the order counts,
moving passages changes components although the set of k-mers stays, as with edit distance.  Likeness of two
fingerprints is the share of equal components.

Occurrence numbers need no shuffle: k-mer hashes are sorted within the row together with their places, a k-mer whose
neighbour is equal has occurred before, and its number is found by binary search.  (Two k-mers of one text whose
hashes agree in all bits that the place leaves over, 63 less the length of the text's k-mer count, share their numbering.)

A text of fewer than ``k`` pieces has its whole sequence as its one k-mer; a text without any, null or empty, has an
empty fingerprint, like another such one (likeness 1) and unlike all others (0).  Rows that repeat a ``doc_id`` are rows of
their own, ordered by a hash of the text and then as given; a null ``doc_id`` comes first.  Extra columns are ignored.
One task holds one whole text and about 100 bytes for each of its k-mers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, store

#: Characters that are pieces of their own: East Asian scripts without blanks.
WIDE = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
PIECE_CHARS = 16
PIECE = rf"[{WIDE}]|[^\x20\x09-\x0D{WIDE}]{{1,{PIECE_CHARS}}}+"


@dataclass(frozen=True)
class OrderMin:
    k: int = 3
    size: int = 32
    seed: int = 17

    @property
    def masks(self) -> list[int]:
        """One 63-bit mask for each hash function."""
        return [int(x) >> 1 for x in kernels.seeded(self.size, self.seed)]


def made(df: DataFrame, keep: list[str], **new: Column) -> DataFrame:
    """``keep`` and the new columns, each computed once a row: the optimiser does not merge expressions over a generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def kmers(rows: DataFrame, keys: list[str], how: OrderMin) -> DataFrame:
    """``keys``; ``e``: hashes of the k-mers in text order, then those of repeated ones with their numbers; ``n``: how many of
    the first kind; ``places`` of the second.  A repeated k-mer of the first kind equals its first occurrence and changes nothing."""
    k, zero = how.k, F.lit(0).cast("long")
    w = made(rows, keys, w=F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).filter(F.size("w") > 0)
    gram = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get("w", i + j) for j in range(k)], F.lit(how.seed)), 1)
    g = made(w, keys, g=F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))), gram))
    # the low bits of a hash give way to its place; a sort then brings equal hashes together, in text order
    g = made(g, [*keys, "g"], low=F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("g")))) - 1)
    placed = F.transform("g", lambda x, i: F.coalesce(x.bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long")), zero))
    s = made(g, [*keys, "g", "low"], s=F.sort_array(placed))
    again = made(s, [*keys, "g", "low"], r=F.filter("s", lambda v, j: v.bitwiseXOR(F.get("s", j - 1)) <= F.col("low")))
    powers = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])

    def numbered(v, i):
        back = lambda d, b: F.when((i >= d + b) & (F.get("r", i - d - b).bitwiseXOR(v) <= F.col("low")), d + b).otherwise(d)
        at = v.bitwiseAND(F.col("low")).cast("int")
        number = F.aggregate(powers, F.lit(0), back) + 1
        return F.struct(at.alias("at"), F.shiftrightunsigned(F.xxhash64(F.get("g", at), number), 1).alias("h"))

    r = made(again, [*keys, "g"], r=F.transform("r", numbered))
    return made(r, keys, e=F.concat("g", F.transform("r", lambda x: x["h"])), n=F.size("g"), places=F.transform("r", lambda x: x["at"]))


def fingerprints(rows: DataFrame, keys: list[str], how: OrderMin) -> DataFrame:
    """``keys`` and ``print``: array of ``size`` components; no row for texts without pieces.

    ``rows``: keys, which are unique, and ``text``, dealt by the first key, which keeps every step within its partition."""
    each = kmers(rows, keys, how).select(*keys, "e", "n", "places", F.posexplode(F.array(*[F.lit(m) for m in how.masks])).alias("i", "mask"))
    t = made(each, [*keys, "n", "places", "i"], t=F.transform("e", lambda x: x.bitwiseXOR(F.col("mask"))))
    t = made(t, [*keys, "n", "places", "i", "t"], a=F.array_min("t"))
    t = made(t, [*keys, "n", "places", "i", "t", "a"], b=F.array_min(F.array_remove("t", F.col("a"))))
    t = made(t, [*keys, "n", "places", "i", "a", "b"], x=F.array_position("t", F.col("a")).cast("int"), y=F.array_position("t", F.col("b")).cast("int"))
    place = lambda p: F.when(F.col(p) <= F.col("n"), F.col(p) - 1).otherwise(F.get("places", F.col(p) - F.col("n") - 1))
    # a single k-mer has no second: its own hash is the component
    ordered = F.when(F.col("b").isNull() | (place("x") < place("y")), F.xxhash64("a", "b")).otherwise(F.xxhash64("b", "a"))
    value = F.shiftright(ordered, 32).cast("int")
    parts = t.select(*keys, F.struct("i", value.alias("v")).alias("part")).groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select(*keys, F.col("parts.v").alias("print"))


def hexed(print_: Column) -> Column:
    """Fixed-width text of a fingerprint: 8 hex digits for each component."""
    digit = F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(digit, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components; without a fingerprint 1 if neither has one, else 0."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal.cast("double") / F.size(a))


def followed(docs: DataFrame) -> DataFrame:
    """key, next_key of each row: its successor in ascending order of id, the first after the last.

    Ids are dealt by range, which balances any distribution of them; each part is ordered by itself and only
    one row a part is ordered as a whole."""
    parts = docs.select("key", "doc_id").repartitionByRange("key").withColumn("part", F.spark_partition_id())
    parts = store.stored(parts, "ids")
    first = parts.groupBy("part").agg(F.min("key").alias("first"))
    whole = Window.orderBy("part")
    first = first.select("part", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return parts.withColumn("inside", inside).join(F.broadcast(first), "part").select("key", F.coalesce("inside", "after").alias("next_key"))


def compared(docs: DataFrame, how: OrderMin = OrderMin()) -> DataFrame:
    """Row for row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as many first characters of the next document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    special = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count() > 0
    if special:  # ids that are null or repeat: rows get a number within their id and text
        docs = docs.withColumn("hash", F.xxhash64("text"))
        number = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("text"))
        docs = docs.withColumn("key", F.struct("doc_id", "hash", number.alias("number")))
    else:
        docs = docs.withColumn("key", F.col("doc_id"))
    # every branch reads the same two columns of this exchange, so texts are dealt once
    texts = docs.select("key", "text").repartition("key")
    order = store.stored(followed(docs).join(docs.select("key", F.expr("length(text) div 4").alias("quarter")), "key"), "order")
    heads = texts.join(order.select(F.col("key").alias("before"), F.col("next_key").alias("key"), F.col("quarter").alias("take")), "key")
    heads = heads.select(F.col("before").alias("key"), F.expr("substring(text, 1, take)").alias("head"))
    edited = texts.join(heads, "key").select("key", "text", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), "head").alias("edited"))
    both = edited.select("key", F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t")).select("key", "t.which", "t.text")
    found = fingerprints(both, ["key", "which"], how).groupBy("key").agg(*[F.max(F.when(F.col("which") == i, F.col("print"))).alias(name) for i, name in enumerate(("own", "other"))])
    facts = edited.select("key", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    rows = store.stored(facts.join(found, "key", "left"), "prints")
    after = rows.select(F.col("key").alias("next_key"), F.col("own").alias("following"))
    rows = rows.join(order.select("key", "next_key"), "key").withColumn("doc_id", F.col("key.doc_id") if special else F.col("key"))
    return rows.join(after, "next_key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(F.col("own")).alias("fingerprint"),
        hexed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
