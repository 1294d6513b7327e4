"""Lookups that decorate results, each as one join instead of a query per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as numbers

#: Most identifier types of one code.
MOST_TYPES = 1000


def number_of_titles(authorities: DataFrame, instances: DataFrame, ids: Column) -> DataFrame:
    """``authorities`` with ``number_of_titles``: how many instances name the authority in any field, once each.

    ``ids``: array of all authority ids of an instance.  Only authorised headings have a number."""
    counts = instances.select("id", F.explode(F.array_distinct(ids)).alias("__authority")).groupBy("__authority").agg(F.count(F.lit(1)).alias("__titles"))
    out = authorities.join(counts, authorities["id"] == F.col("__authority"), "left")
    return out.withColumn("number_of_titles", F.when(F.col("auth_ref_type") == "Authorized", F.coalesce("__titles", F.lit(0)))).drop("__authority", "__titles")


def single_titles(children: DataFrame, instances: DataFrame, ids: str = "instance_ids") -> DataFrame:
    """``children`` with the ``title`` of their instance, where there is exactly one."""
    only = F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))
    titles = instances.select(F.col("id").alias("__id"), F.col("title").alias("instance_title"))
    return children.withColumn("__only", only).join(titles, F.col("__only") == F.col("__id"), "left").drop("__only", "__id")


def single_classifications(children: DataFrame, instances: DataFrame) -> DataFrame:
    """Sub-resources that one instance has (``count`` 1), with its title and contributors, matched on (classification_id, tenant_id)."""
    known = instances.select(F.explode("classification_ids").alias("id"), "tenant_id", F.col("title").alias("instance_title"), "contributors")
    one = children.where("count = 1").join(known, ["id", "tenant_id"], "left")
    return one.unionByName(children.where("count <> 1"), allowMissingColumns=True)


def holdings_of_items(instances: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Holdings whose item has one of the barcodes: items inside instances lead to holdings inside the same instance.

    An item is shuffled as its barcode and its holding's id, and once for each holding after that; holdings never go with it."""
    items = instances.select("id", F.explode("items").alias("i")).select("id", "i.barcode", "i.holding_id")
    named = items.join(barcodes, items["barcode"] == barcodes["barcode"], "left_semi").select(F.col("id").alias("__instance"), F.col("holding_id").alias("__holding")).distinct()
    held = instances.select(F.col("id").alias("instance_id"), F.explode("holdings").alias("h"))
    found = held.join(named, held["instance_id"].eqNullSafe(named["__instance"]) & (held["h.id"] == named["__holding"]), "left_semi")
    return found.select("instance_id", "h.*").distinct()


def subject_counts(instances: DataFrame, subjects: Column, wanted: list[str]) -> DataFrame:
    """subject, count of instances for a list of subjects, compared in lower case."""
    low = instances.select("id", F.explode(F.array_distinct(F.transform(subjects, F.lower))).alias("subject"))
    return low.where(F.col("subject").isin(*[w.lower() for w in wanted])).groupBy("subject").agg(F.count(F.lit(1)).alias("count"))


def reference_ids(reference: DataFrame, names: list[str], by: str = "name") -> DataFrame:
    """Ids of reference records by name or code."""
    return reference.where(F.col(by).isin(*names)).select("id").distinct()


#: Codes of the identifier types that authorities have LCCNs under, as fixed values.
LCCN_CODE, CANCELED_LCCN_CODE = "lccn", "canceled-lccn"


def lccns_by_code(authorities: DataFrame, reference: DataFrame, canceled: bool = False, identifiers: str = "identifiers") -> DataFrame:
    """``authorities`` with ``lccn`` or ``canceledLccn``: normalised values of the identifiers whose type has the code in the reference table
    (id, code).  The types of one code are a few rows, which become a condition."""
    found = reference_ids(reference, [CANCELED_LCCN_CODE if canceled else LCCN_CODE], "code").limit(MOST_TYPES).collect()
    types = tuple(str(r.id) for r in found)
    values = numbers.of_types(F.col(identifiers), types, kind="identifierTypeId") if types else F.array().cast("array<string>")
    return authorities.withColumn("canceledLccn" if canceled else "lccn", F.array_distinct(F.transform(values, numbers.no_space)))
