"""Multi-select facets: each counts the documents that match the query and all filters but its own."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import analysis
from ..cql.bind import Reader, bind, filter_field, split_filters, terms_of, to_column
from ..errors import QueryError
from ..model import Resource

#: How facets are asked for; column names may have underscores.
SPEC = re.compile(r"^([A-Za-z._]+)(:(\d{1,10}))?$")
MOST = 2**31 - 1


def parse_spec(spec: str) -> tuple[str, int]:
    """``name`` or ``name:size``."""
    if not spec:
        raise QueryError("Facet name cannot be null")
    m = SPEC.match(spec)
    if not m:
        raise QueryError("Invalid facet name format, must be 'facet' or 'facet:size'")
    return m[1], int(m[3]) if m[3] else MOST


def facets(df: DataFrame, cql: str, specs: list[str], resource: Resource) -> DataFrame:
    """facet, id, total_records, selected: normalised values by count then value, selected ones first.

    One pass over the table: each document gives one row for each facet and value that its filters leave it, counts
    are combined before the shuffle.  ``size`` limits a facet's values; if no more than the selected fit, only they stay."""
    wanted = [(resource.facet(name), size) for name, size in map(parse_spec, specs)]
    node, _ = bind(cql, resource)
    query, filters = split_filters(node)
    columns, reader = df.columns, Reader(df.columns)
    by_field: dict[str, list] = {}
    for f in filters:
        by_field.setdefault(filter_field(f), []).append(f)
    keep = {path: reduce(Column.__and__, [to_column(p, resource, columns) for p in parts]) for path, parts in by_field.items()}
    rows, sizes, selected = [], [], []
    for f, size in wanted:
        passes = reduce(Column.__and__, [c for path, c in keep.items() if path != f.path], F.lit(True))
        values = F.array_distinct(F.array_compact(reader.norm(f))) if f.many else F.array_compact(F.array(reader.norm(f)))
        values = F.transform(values, lambda x: x.cast("string"))
        rows.append(F.struct(F.lit(f.path).alias("facet"), F.when(passes, values).otherwise(F.array().cast("array<string>")).alias("ids")))
        sizes.append((f.path, size))
        selected.append((f.path, [analysis.normalised_text(f.type, v) if isinstance(v, str) else str(v).lower() for p in by_field.get(f.path, []) for v in terms_of(p)]))
    # a document that fails two filters counts nowhere; drop it before exploding
    any_ = reduce(Column.__or__, [reduce(Column.__and__, [c for path, c in keep.items() if path != f.path], F.lit(True)) for f, _ in wanted])
    each = df.where(to_column(query, resource, columns) & any_).select(F.explode(F.array(*rows)).alias("r")).select("r.facet", F.explode("r.ids").alias("id"))
    counts = each.groupBy("facet", "id").agg(F.count(F.lit(1)).alias("total_records"))
    is_selected = reduce(Column.__or__, [(F.col("facet") == path) & F.col("id").isin(*values) for path, values in selected if values], F.lit(False))
    counts = counts.withColumn("selected", is_selected)
    if all(size == MOST for _, size in sizes):
        return counts.orderBy("facet", F.desc("selected"), F.desc("total_records"), "id")
    # cut to the greatest size first, which Spark does before the shuffle
    most = max(size for _, size in sizes)
    order = [F.desc("selected"), F.desc("total_records"), "id"]
    if most < MOST:
        counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(*order))).where(F.col("place") <= most).drop("place")
    limit = reduce(lambda acc, s: acc.when(F.col("facet") == s[0], s[1]), sizes[1:], F.when(F.col("facet") == sizes[0][0], sizes[0][1]))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(*order))
    return counts.withColumn("place", place).where(F.col("place") <= limit).drop("place").orderBy("facet", F.desc("selected"), F.desc("total_records"), "id")


def totals(found: DataFrame, specs: list[str], resource: Resource) -> DataFrame:
    """facet, total_records: how many values each facet asked for has in a result, 0 for one without any."""
    asked = found.sparkSession.createDataFrame([(resource.facet(parse_spec(s)[0]).path,) for s in specs], "facet string")
    counts = found.groupBy("facet").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, "facet", "left").select("facet", F.coalesce("n", F.lit(0)).alias("total_records"))
