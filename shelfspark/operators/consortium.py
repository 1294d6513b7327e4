"""Consortium: which tenant sees which documents, and lookups over the holdings and items of all tenants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError

MOST_IDS = 20_000
MOST_PAGE = 1000


@dataclass(frozen=True)
class Tenant:
    """A tenant and the central tenant of its consortium, if it is in one."""

    name: str
    central: str | None = None

    @property
    def is_central(self) -> bool:
        return self.name == self.central


def visible(tenant: Tenant, tenant_id: Column, shared: Column, linked_data: bool = False) -> Column | None:
    """Condition on documents: a member sees its own and shared ones, the central tenant shared ones; None for no condition."""
    if tenant.central is None or linked_data and tenant.is_central:
        return None
    is_shared = F.coalesce(shared, F.lit(False))
    return is_shared if tenant.is_central else F.coalesce(tenant_id == tenant.name, F.lit(False)) | is_shared


def visible_elements(tenant: Tenant, instances: Column, shared: bool | None = None, tenants: list[str] | None = None, location: str | None = None, names: tuple[str, str] = ("tenant_id", "location_id")) -> Column:
    """Elements of a child resource's ``instances`` that the tenant sees and the browse filters ask for.

    ``shared=False`` asks a member for its own elements that are not shared.  ``names``: what the elements call tenant and location."""

    def test(x: Column) -> Column:
        own, is_shared = F.coalesce(x[names[0]] == tenant.name, F.lit(False)), F.coalesce(x["shared"], F.lit(False))
        keep = F.lit(True)
        if tenant.central is not None:
            keep = is_shared if tenant.is_central else own | is_shared
            if shared is not None:
                keep = keep & (is_shared if shared else (own & ~is_shared))
        elif shared is not None:
            keep = is_shared == shared
        if tenants:
            keep = keep & x[names[0]].isin(*tenants)
        if location is not None:
            keep = keep & (x[names[1]] == location)
        return keep

    return F.filter(instances, test)


def page(df: DataFrame, sortable: tuple[str, ...], sort_by: str | None, descending: bool, limit: int, offset: int, filtered: bool, what: str) -> DataFrame:
    """A sorted page; only listed columns sort, and only a filtered table is sorted."""
    if sort_by is not None:
        if sort_by not in sortable:
            raise ValidationError(f"Not allowed sort field for {what}")
        if not filtered:
            raise ValidationError("At least one filter criteria required")
        c = F.col(sort_by)
        df = df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id")
    if not 0 <= limit <= MOST_PAGE or offset < 0:
        raise ValidationError(f"limit should be between 0 and {MOST_PAGE}, offset 0 or more")
    return df.offset(offset).limit(limit)


def holdings(df: DataFrame, instance_id: str | None = None, tenant: str | None = None, sort_by: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    conditions = [F.col(c) == v for c, v in (("instance_id", instance_id), ("tenant_id", tenant)) if v is not None]
    for c in conditions:
        df = df.where(c)
    return page(df, ("id", "hrid", "tenant_id", "instance_id", "call_number", "copy_number"), sort_by, descending, limit, offset, bool(conditions), "holdings")


def items(df: DataFrame, instance_id: str | None, holding_id: str | None = None, tenant: str | None = None, sort_by: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    if instance_id is None:
        raise ValidationError("instanceId filter is required")
    for c, v in (("instance_id", instance_id), ("holding_id", holding_id), ("tenant_id", tenant)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return page(df, ("id", "hrid", "tenant_id", "instance_id", "holding_id", "barcode"), sort_by, descending, limit, offset, True, "items")


def locations(df: DataFrame, id_: str | None = None, tenant: str | None = None, sort_by: str = "name", descending: bool = False, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Location units of any kind: institutions, campuses, libraries or locations; shadow units never are among them."""
    own = "tenantId" if "tenantId" in df.columns else "tenant_id"
    if sort_by not in ("name", "id", "tenantId", "tenant_id"):
        raise ValidationError("Invalid sortBy value is being used")
    sort_by = own if sort_by in ("tenantId", "tenant_id") else sort_by
    if offset + limit > 10_000:
        raise ValidationError("The sum of limit and offset should not exceed 10000.")
    for c, v in (("id", id_), (own, tenant)):
        if v is not None:
            df = df.where(F.col(c) == v)
    key = F.col(sort_by)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id").offset(offset).limit(limit)


#: Identifier types of the batch lookup with the column each one reads.
LOOKUPS = {"ID": "id", "HRID": "hrid", "BARCODE": "barcode", "FORMER_IDS": "former_ids", "ACCESSION_NUMBER": "accession_number", "HOLDINGS_RECORD_ID": "holding_id", "INSTANCE_HRID": "instance_hrid", "ITEM_BARCODE": "item_barcode"}


def batch(df: DataFrame, identifier: str, values: list[str]) -> DataFrame:
    """Rows of the records that an identifier's values name; a handful of values is a condition, many are a join."""
    if len(values) > MOST_IDS:
        raise ValidationError(f"IDs array size exceeds the maximum allowed limit {MOST_IDS}")
    column = LOOKUPS.get(identifier.upper())
    if column is None or column not in df.columns:
        raise ValidationError(f"Identifier type {identifier} is not supported")
    many = dict(df.dtypes)[column].startswith("array")
    if len(values) <= 1000:
        return df.where(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])) if many else F.col(column).isin(*values))
    wanted = F.broadcast(df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "__v string"))  # at most MOST_IDS rows
    if many:  # each value of a row is looked up; rows come back by key, once
        hits = df.select("id", F.explode(column).alias("__v")).join(wanted, "__v", "left_semi").select("id").distinct()
        return df.join(hits, "id", "left_semi")
    return df.join(wanted, F.col(column).cast("string") == F.col("__v"), "left_semi")
