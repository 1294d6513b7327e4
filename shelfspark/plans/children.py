"""Child resources of instances: extraction into entities and relations, and two-level aggregation back.

Entity ids are SHA-1 over the identifying values, so equal entities of any records meet without a lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import expected, sha_id


def subjects(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities id, value, authority_id, source_id, type_id; relations instance_id, subject_id, tenant_id, shared)."""
    x = instances.select("id", "tenant_id", "shared", F.explode("subjects").alias("s"))
    value = expected(F.col("s.value"), 255)
    rows = x.select("id", "tenant_id", "shared", value.alias("value"), "s.authorityId", "s.sourceId", "s.typeId").filter("value <> ''")
    rows = rows.withColumn("child", sha_id(F.col("value"), F.col("authorityId"), F.col("sourceId"), F.col("typeId")))
    entities = rows.select(F.col("child").alias("id"), "value", F.col("authorityId").alias("authority_id"), F.col("sourceId").alias("source_id"), F.col("typeId").alias("type_id")).dropDuplicates(["id"])
    return entities, rows.select(F.col("id").alias("instance_id"), F.col("child").alias("subject_id"), "tenant_id", "shared")


def contributors(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities id, name, name_type_id, authority_id; relations instance_id, contributor_id, type_id, tenant_id, shared)."""
    x = instances.select("id", "tenant_id", "shared", F.explode("contributors").alias("c"))
    rows = x.select("id", "tenant_id", "shared", expected(F.col("c.name"), 255).alias("name"), "c.contributorNameTypeId", "c.authorityId", F.coalesce("c.contributorTypeId", F.lit("")).alias("type_id")).filter("name <> ''")
    rows = rows.withColumn("child", sha_id(F.col("name"), F.col("contributorNameTypeId"), F.col("authorityId")))
    entities = rows.select(F.col("child").alias("id"), "name", F.col("contributorNameTypeId").alias("name_type_id"), F.col("authorityId").alias("authority_id")).dropDuplicates(["id"])
    return entities, rows.select(F.col("id").alias("instance_id"), F.col("child").alias("contributor_id"), "type_id", "tenant_id", "shared")


def classifications(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities id, number, type_id; relations instance_id, classification_id, tenant_id, shared)."""
    x = instances.select("id", "tenant_id", "shared", F.explode("classifications").alias("c"))
    rows = x.select("id", "tenant_id", "shared", expected(F.col("c.classificationNumber"), 50).alias("number"), F.col("c.classificationTypeId").alias("type_id")).filter("number <> ''")
    rows = rows.withColumn("child", sha_id(F.col("number"), F.col("type_id")))
    return rows.select(F.col("child").alias("id"), "number", "type_id").dropDuplicates(["id"]), rows.select(F.col("id").alias("instance_id"), F.col("child").alias("classification_id"), "tenant_id", "shared")


def call_numbers(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From items (id, instance_id, tenant_id, location_id, call_number, prefix, suffix, type_id):
    (entities id, call_number, prefix, suffix, type_id; relations call_number_id, item_id, instance_id, tenant_id, location_id)."""
    rows = items.select(
        F.col("id").alias("item_id"), "instance_id", "tenant_id", "location_id",
        expected(F.col("call_number"), 50).alias("call_number"), expected(F.col("prefix"), 20).alias("prefix"), expected(F.col("suffix"), 25).alias("suffix"), expected(F.col("type_id"), 40).alias("type_id"),
    ).filter("call_number <> ''")
    rows = rows.withColumn("child", sha_id(F.col("call_number"), F.col("prefix"), F.col("suffix"), F.col("type_id")))
    entities = rows.select(F.col("child").alias("id"), "call_number", "prefix", "suffix", "type_id").dropDuplicates(["id"])
    return entities, rows.select(F.col("child").alias("call_number_id"), "item_id", "instance_id", "tenant_id", "location_id")


def counted(relations: DataFrame, child: str, entities: DataFrame, distinct_instances: bool = False, types: str | None = None) -> DataFrame:
    """Each entity with ``instances``: an array of (tenant_id, shared, count, type ids), sorted.  Entities without relations keep a null.

    Counts are combined by (entity, tenant, shared) first, so the array of an entity is as long as its tenants are many."""
    aggs = [(F.countDistinct("instance_id") if distinct_instances else F.count(F.lit(1))).alias("count")]
    fields = ["tenant_id", "shared", "count"]
    if types:
        aggs.append(F.sort_array(F.collect_set(F.when(F.col(types) != "", F.col(types)))).alias("type_ids"))
        fields.append("type_ids")
    level = relations.groupBy(child, "tenant_id", "shared").agg(*aggs)
    whole = level.groupBy(F.col(child).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("instances"))
    return entities.join(whole, "id", "left")


def located(relations: DataFrame, instances: DataFrame, entities: DataFrame) -> DataFrame:
    """Each call number with ``instances``: an array of (tenant_id, shared, location_id, instance_ids)."""
    shared = relations.join(instances.select(F.col("id").alias("instance_id"), "shared"), "instance_id")
    level = shared.groupBy("call_number_id", "tenant_id", "shared", "location_id").agg(F.sort_array(F.collect_set("instance_id")).alias("instance_ids"))
    whole = level.groupBy(F.col("call_number_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("tenant_id", "shared", "location_id", "instance_ids"))).alias("instances"))
    return entities.join(whole, "id", "left")


def total_count(instances_column: str = "instances"):
    """Sum of the counts of the visible elements."""
    return F.aggregate(F.coalesce(F.transform(instances_column, lambda x: x["count"]), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b)


def distinct_instances(instances_column: str = "instances"):
    return F.size(F.array_distinct(F.flatten(F.transform(instances_column, lambda x: x["instance_ids"])))).cast("bigint")
