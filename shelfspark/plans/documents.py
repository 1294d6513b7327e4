"""Documents: assembly of instances with their holdings and items, authorities by heading, location units, projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Field, Resource

#: Heading fields of an authority: (field, heading type, form).  The forms are the heading, see-from and see-also.
HEADINGS = ("personalName", "personalNameTitle", "corporateName", "corporateNameTitle", "meetingName", "meetingNameTitle", "uniformTitle", "topicalTerm", "geographicName", "genreTerm", "chronTerm", "chronSubdivision", "generalSubdivision", "geographicSubdivision", "formSubdivision", "mediumPerfTerm", "namedEvent")
FORMS = (("", "Authorized"), ("sft", "Reference"), ("saft", "Auth/Ref"))


def heading_fields() -> list[tuple[str, str, str]]:
    """(column, heading type, reference type) for each heading field and form."""
    return [(f"{form}{h[0].upper()}{h[1:]}" if form else h, h, kind) for h in HEADINGS for form, kind in FORMS]


def assembled(instances: DataFrame, holdings: DataFrame, items: DataFrame) -> DataFrame:
    """Instances with arrays of their holdings and items, empty where there are none; each side is aggregated before it is joined."""
    h = holdings.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in holdings.columns if c != "instance_id"]))).alias("holdings"))
    i = items.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in items.columns if c != "instance_id"]))).alias("items"))
    out = instances.join(h, instances["id"] == h["instance_id"], "left").drop("instance_id").join(i, instances["id"] == i["instance_id"], "left").drop("instance_id")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("holdings", "items")})


def _heading(column: str, heading: str, kind: str):
    """A heading value and its counter as a struct."""

    def one(v: Column, i: Column) -> Column:
        return F.struct(F.concat(F.lit(column), i.cast("string")).alias("distinct"), F.lit(heading).alias("heading_type"), F.lit(kind).alias("auth_ref_type"), v.alias("heading_ref"))

    return one


def authority_headings(authorities: DataFrame, fields: list[tuple[str, str, str]] | None = None, common: tuple[str, ...] = ()) -> DataFrame:
    """One row for each heading value: id = field, counter, ``_`` and the record's id; a record without any has ``other0_<id>``."""
    known = [f for f in fields or heading_fields() if f[0] in authorities.columns]
    entry = []
    for column, heading, kind in known:
        values = F.col(column) if isinstance(authorities.schema[column].dataType, T.ArrayType) else F.array(F.col(column))
        values = F.filter(values, lambda v: v.isNotNull() & (v != ""))
        entry.append(F.transform(values, _heading(column, heading, kind)))
    other = F.array(F.struct(F.lit("other0").alias("distinct"), F.lit("Other").alias("heading_type"), F.lit(None).cast("string").alias("auth_ref_type"), F.lit(None).cast("string").alias("heading_ref")))
    found = F.concat(*entry)
    rows = authorities.select("id", *common, F.explode(F.when(F.size(found) > 0, found).otherwise(other)).alias("h"))
    return rows.select(
        F.concat_ws("_", "h.distinct", F.col("id").cast("string")).alias("document_id"), "id", *common, "h.heading_type", "h.auth_ref_type", "h.heading_ref", F.lower(F.col("h.heading_type")).endswith("title").alias("is_title_heading_ref")
    )


def heading_changes(new: DataFrame, old: DataFrame, key: str = "document_id") -> DataFrame:
    """Index actions of an update: all new documents are created, and old ones that are no longer there deleted."""
    gone = old.select(key).join(new.select(key), key, "left_anti").withColumn("action", F.lit("DELETE"))
    return new.select(key).withColumn("action", F.lit("CREATE")).unionByName(gone)


def actions(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """id, action: ids whose document is gone become deletions."""
    there = documents.select("id", F.lit(True).alias("__there"))
    return ids.distinct().join(there, "id", "left").select("id", F.when(F.col("__there"), "INDEX").otherwise("DELETE").alias("action"))


def _tree(resource: Resource) -> dict:
    """Field names by level: a field, or what lies under it."""
    tree: dict = {}
    for f in sorted((f for f in resource.fields if f.type != "none"), key=lambda f: f.path.count(".")):
        *above, name = f.path.split(".")
        node = tree
        for step in above:
            node = node.setdefault(step, {})
            if not isinstance(node, dict):  # a field is taken whole
                break
        else:
            node.setdefault(name, f)
    return tree


def rebuilt(c: Column, kind: T.DataType, names: Callable[[list[str]], list[tuple[str, str, object]]], node: object = None, leaf: Callable[[Column, object], Column] = lambda c, _: c) -> Column:
    """``c`` with its objects made anew, inside lists and at every level.  ``names``: for the fields of an object and what stands for it,
    which field becomes which, and what stands for that."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.ArrayType, T.StructType)):
        return F.transform(c, lambda x: rebuilt(x, kind.elementType, names, node, leaf))
    if isinstance(kind, T.StructType):
        fields = names(kind.fieldNames(), node)
        made = [rebuilt(c.getField(old), kind[old].dataType, names, sub, leaf).alias(new) for old, new, sub in fields]
        return F.when(c.isNotNull(), F.struct(*made)) if made else F.lit(None).cast("struct<>")
    return leaf(c, node)


def projected(df: DataFrame, resource: Resource) -> DataFrame:
    """The fields a descriptor has, inside objects and lists of them too, with defaults for nulls; others are dropped."""

    def names(fields: list[str], node) -> list[tuple[str, str, object]]:
        return [(x, x, node[x]) for x in node if x in fields] if isinstance(node, dict) else [(x, x, None) for x in fields]

    def leaf(c: Column, f) -> Column:
        return F.coalesce(c, F.lit(f.default)) if isinstance(f, Field) and f.default is not None else c

    return df.select(*[rebuilt(F.col(x), df.schema[x].dataType, names, sub, leaf).alias(x) for x, _, sub in names(df.columns, _tree(resource))])


def unplained(df: DataFrame) -> DataFrame:
    """``plain_x`` as ``x``, inside objects and lists of them too; it wins over an analysed ``x``."""

    def names(fields: list[str], _=None) -> list[tuple[str, str, object]]:
        plain = {x.removeprefix("plain_"): x for x in fields if x.startswith("plain_")}
        return [(plain.get(x, x), x, None) for x in dict.fromkeys(x.removeprefix("plain_") for x in fields)]

    return df.select(*[rebuilt(F.col(old), df.schema[old].dataType, names).alias(new) for old, new, _ in names(df.columns)])


def at_path(df: DataFrame, path: str) -> Column:
    """The value at a dotted path; where the path goes through lists, all its values as one list, nulls left out."""

    def step(c: Column, kind: T.DataType, steps: list[str]) -> tuple[Column, bool]:
        if isinstance(kind, T.ArrayType):
            if not steps:
                return c, True
            many = _through_list(kind.elementType, steps)
            inner = F.transform(c, lambda x: step(x, kind.elementType, steps)[0])
            return (F.flatten(F.filter(inner, lambda x: x.isNotNull())) if many else F.array_compact(inner)), True
        if not steps:
            return c, False
        return step(c.getField(steps[0]), kind[steps[0]].dataType, steps[1:])

    first, *rest = path.split(".")
    return step(F.col(first), df.schema[first].dataType, rest)[0]


def _through_list(kind: T.DataType, steps: list[str]) -> bool:
    if isinstance(kind, T.ArrayType):
        return True
    return bool(steps) and _through_list(kind[steps[0]].dataType, steps[1:])


def page_of(df: DataFrame, offset: Column, limit: Column | int, total: Column | int) -> DataFrame:
    """A page of linked data as it is returned: without ``instances``, with its number and how many pages there are."""
    count = lambda n: F.ceil((n if isinstance(n, Column) else F.lit(n)) / limit).cast("long")
    return df.drop("instances").withColumns({"page_number": count(offset), "total_pages": count(total)})


def json_text(body: Column, *path: str) -> Column:
    """Text at a path of names in a JSON document, whatever signs the names have; null where there is none."""
    return F.get_json_object(body, "$" + "".join(f"['{p}']" for p in path))


def expanded(df: DataFrame, resource: Resource) -> DataFrame:
    """Full-text fields with their ``plain_`` form beside them."""
    from .. import analysis

    more = {f"plain_{f.path}": analysis.normalised(f.type, F.col(f.path)) for f in resource.fields if f.text and f.plain and not f.many and f.path in df.columns}
    return df.withColumns(more)


def serialised(df: DataFrame, key: str = "id") -> DataFrame:
    """key, body: each document as JSON without its null fields."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*df.columns)).alias("body"))
