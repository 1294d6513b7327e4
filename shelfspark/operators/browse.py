"""Browsing: a page of an ordered list around, before or behind an anchor.

The order is that of one or more key columns, nulls last; the first is taken as its field normalises it, and so is the anchor.
A page is two limited scans on either side of the anchor.  Over a table stored in order (``plans.ordered``) they read the files
around it only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import analysis
from ..cql.bind import RANGES, And, Match, Or, Reader, bind, filter_field, to_column
from ..errors import NotFoundError, QueryError, ValidationError
from ..functions.shelving import shelving_key
from ..model import Resource, is_stored

INVALID = "Invalid CQL query for browsing."


@dataclass(frozen=True)
class Context:
    """``anchor``: as it was typed; ``backward``/``forward``: how many rows on each side; ``included``: whether rows equal to it are wanted."""

    anchor: str
    backward: int
    forward: int
    included: bool
    filters: tuple = ()

    @property
    def around(self) -> bool:
        return self.backward > 0 and self.forward > 0


def context(cql: str, resource: Resource, target: str, limit: int = 100, preceding: int | None = None) -> Context:
    """Reads a browse query: one range on the target field, or two opposite ones with the same anchor, and filters."""
    node, keys = bind(cql, resource)
    if keys:
        raise QueryError("Invalid CQL query for browsing, 'sortBy' is not supported")
    parts = list(node.parts) if isinstance(node, And) else [node]
    ranges = [p for p in parts if _is_range(p, target) or isinstance(p, Or) and all(_is_range(x, target) for x in p.parts)]
    filters = tuple(p for p in parts if p not in ranges)
    if len(ranges) != 1 or any(filter_field(p) is None for p in filters):
        raise QueryError(INVALID)
    if isinstance(ranges[0], Match):
        m = ranges[0]
        down = m.op in ("<", "<=")
        return Context(_anchor(m), limit if down else 0, 0 if down else limit, m.op.endswith("="), filters)
    two = ranges[0].parts
    if len(two) != 2 or {p.op[0] for p in two} != {"<", ">"}:
        raise QueryError(INVALID)
    if two[0].value != two[1].value:
        raise QueryError("Anchors must be the same in range conditions.")
    before = limit // 2 if preceding is None else preceding
    if before >= limit:
        raise ValidationError("Preceding records count must be less than request limit")
    return Context(_anchor(two[0]), before, limit - before, any(p.op.endswith("=") for p in two), filters)


def _anchor(m: Match) -> str:
    return str(m.value) if m.raw is None else m.raw


def _is_range(p, target: str) -> bool:
    return isinstance(p, Match) and p.op in RANGES and p.fields[0].path == target


def key_struct(keys: list[Column]) -> Column:
    """Comparable tuple with nulls last."""
    return F.struct(*[x for i, k in enumerate(keys) for x in (k.isNull().alias(f"n{i}"), k.alias(f"k{i}"))])


@dataclass(frozen=True)
class Order:
    """``keys``: columns in order; the first is compared with the anchor, both normalised as its field is.  ``name``: what a row is called in cursors."""

    keys: tuple[str, ...]
    name: str


def first_key(order: Order, resource: Resource, columns: list[str]) -> Column:
    f = resource.get(order.keys[0])
    return F.col(order.keys[0]) if f is None else Reader(columns).norm(f)


def anchor_key_of(ctx: Context, order: Order, resource: Resource) -> str:
    f = resource.get(order.keys[0])
    return ctx.anchor if f is None else analysis.normalised_text(f.type, ctx.anchor)


def browse(df: DataFrame, ctx: Context, order: Order, resource: Resource, anchor_key: str | None = None, highlight: bool = True) -> DataFrame:
    """The page, with ``is_anchor``, ``position`` (0 from the first row on), ``prev`` and ``next`` cursors.

    An anchor that no row has, or that the query leaves out, is shown as a placeholder row if ``highlight`` holds and
    the page has both sides.  An empty anchor gives an empty page."""
    key, columns = anchor_key_of(ctx, order, resource) if anchor_key is None else anchor_key, [c for c in df.columns if not is_stored(c)]
    if ctx.filters:
        df = df.where(to_column(And(ctx.filters), resource, df.columns))
    df = df.withColumn("__first", first_key(order, resource, df.columns))
    first, keys = F.col("__first"), [F.col("__first"), *[F.col(k) for k in order.keys[1:]]]
    up = [k.asc_nulls_last() for k in keys]
    down = [k.desc_nulls_first() for k in keys]
    none = F.lit(None).cast("int")
    sides = []
    if key == "":
        df = df.limit(0)
    limit = ctx.backward + ctx.forward
    hits = df.where(first == key).orderBy(*up).limit(limit + 1).withColumn("__side", F.lit(0)).withColumn("is_anchor", F.lit(True))
    if ctx.included:
        sides.append(hits)
    if ctx.backward:
        sides.append(df.where(first < key).orderBy(*down).limit(ctx.backward + 1).withColumn("__side", F.lit(-1)).withColumn("is_anchor", F.lit(False)))
    if ctx.forward:
        sides.append(df.where((first > key) | first.isNull()).orderBy(*up).limit(ctx.forward + 1).withColumn("__side", F.lit(1)).withColumn("is_anchor", F.lit(False)))
    if ctx.around and highlight and key != "":
        shape = df.limit(0).withColumn("__side", none).withColumn("is_anchor", F.lit(True))
        hole = df.sparkSession.range(1).select(
            *[(F.lit(key) if c == "__first" else F.lit(ctx.anchor) if c == order.name else F.lit(key) if c == order.keys[0] else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes],
            F.lit(0).alias("__side"),
            F.lit(True).alias("is_anchor"),
        )
        if ctx.included:
            hole = hole.join(hits.select(F.lit(1).alias("__hit")).limit(1), how="left_anti", on=F.lit(True))
        sides.append(shape.unionByName(hole))
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    # rows of a page number at most 2 * limit + 2; the window below orders those, never the table
    whole = Window.partitionBy(F.lit(0)).orderBy("__side", *[k.asc_nulls_last() for k in keys])
    rows = rows.withColumn("__at", F.row_number().over(whole))
    every = Window.partitionBy(F.lit(0))
    back = F.count(F.when(F.col("__side") < 0, 1)).over(every)
    n = F.count(F.lit(1)).over(every)
    rows = rows.withColumn("__back", back).withColumn("__n", n)
    if ctx.around:
        low = F.greatest(F.col("__back") - ctx.backward, F.lit(0))
        high = low + F.least(F.lit(ctx.backward), F.col("__back")) + ctx.forward
    elif ctx.forward:
        low, high = F.lit(0), F.lit(limit)
    else:
        low, high = F.greatest(F.col("__n") - limit, F.lit(0)), F.col("__n")
    inside = (F.col("__at") > low) & (F.col("__at") <= high)
    name = F.col(order.name).cast("string")
    more_before, more_behind = low > 0, F.col("__n") > high
    page = Window.partitionBy(F.lit(0)).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("__low", more_before).withColumn("__high", more_behind).where(inside)
    prev = F.first(name).over(page)
    next_ = F.last(name).over(page)
    if ctx.around:
        prev, next_ = F.when(F.col("__low"), prev), F.when(F.col("__high"), next_)
    elif ctx.forward:
        next_ = F.when(F.col("__high"), next_)
    else:
        prev = F.when(F.col("__low"), prev)
    out = rows.select(
        *columns,
        "is_anchor",
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__at")) - 1).cast("long").alias("position"),
        prev.alias("prev"),
        next_.alias("next"),
    )
    return out.orderBy("position")


#: Browse options of each kind with their algorithm, where nothing is configured.
DEFAULTS = {
    "instance-classification": {"all": ("DEFAULT", ()), "lc": ("LC", ()), "dewey": ("DEWEY", ())},
    "instance-call-number": {"all": ("DEFAULT", ()), "lc": ("LC", ()), "dewey": ("DEWEY", ()), "nlm": ("NLM", ()), "sudoc": ("SUDOC", ()), "other": ("DEFAULT", ())},
}


@dataclass
class Configs:
    """Browse options: algorithm of the shelving key and the type ids that belong to an option."""

    options: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = field(default_factory=lambda: {k: dict(v) for k, v in DEFAULTS.items()})

    def get(self, kind: str, option: str) -> tuple[str, tuple[str, ...]]:
        try:
            return self.options[kind][option]
        except KeyError:
            raise NotFoundError(f"Config for {kind} type {option} must be present in database") from None

    def put(self, kind: str, option: str, algorithm: str, type_ids: tuple[str, ...]) -> None:
        self.options.setdefault(kind, {})[option] = (algorithm, tuple(type_ids))

    def types_deleted(self, kind: str, type_ids: set[str]) -> None:
        """Deleted types leave every option."""
        for option, (algorithm, ids) in self.options.get(kind, {}).items():
            self.options[kind][option] = (algorithm, tuple(i for i in ids if i not in type_ids))


def shelved(df: DataFrame, column: str, algorithm: str) -> DataFrame:
    """``df`` with the shelving key of ``column`` as ``shelving_order``."""
    return df.withColumn("shelving_order", F.lower(shelving_key(F.col(column), algorithm)))
