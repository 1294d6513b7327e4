"""Change events: schema, routing by topic, and the filters of each listener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tables

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "deleteEventSubType", "tenant", "resourceName", "new", "old")])
TYPES = ("UPDATE", "CREATE", "DELETE", "REINDEX", "DELETE_ALL")

#: Resource of each topic, by the topic's last part.
ROUTES = {
    "instance": "instance",
    "holdings-record": "holdings",
    "item": "item",
    "bound-with": "bound_with",
    "authority": "authority",
    "classification-type": "classification-type",
    "call-number-type": "call-number-type",
    "location": "location",
    "campus": "campus",
    "institution": "institution",
    "library": "library",
    "work": "linked-data-work",
    "hub": "linked-data-hub",
    "linked-data-authority": "linked-data-authority",
    "contributor": "contributor",
    "subject": "instance_subject",
}


def routed(topic: Column) -> Column:
    """Resource name of a topic; null for a topic that is not known."""
    last = F.element_at(F.split(topic, r"\."), -1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair]), last)


def record_id(resource: Column, key: Column, body: Column) -> Column:
    """Holdings and items are named by their body, all else by the message key."""
    return F.when(resource.isin("holdings", "item"), F.coalesce(F.get_json_object(body, "$.id"), key)).otherwise(key)


def parsed(messages: DataFrame) -> DataFrame:
    """Messages (key, value, topic, timestamp) as events."""
    e = messages.select(F.col("key").cast("string").alias("key"), F.col("topic"), F.col("timestamp").alias("ts"), F.from_json(F.col("value").cast("string"), SCHEMA).alias("e"))
    out = e.select("key", "ts", "e.*", F.coalesce(routed(F.col("topic")), F.col("e.resourceName")).alias("resource"))
    return out.withColumn("record_id", record_id(F.col("resource"), F.col("key"), F.coalesce("new", "old")))


def kafka(spark: SparkSession, servers: str, topics: str, most: int = 200) -> DataFrame:
    """Stream of messages from Kafka (needs its connector on the class path)."""
    options = {"kafka.bootstrap.servers": servers, "subscribePattern": topics, "maxOffsetsPerTrigger": str(most), "startingOffsets": "earliest"}
    return spark.readStream.format("kafka").options(**options).load()


def files(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """Stream of events from line-delimited JSON files in a folder."""
    schema = T.StructType([*SCHEMA.fields, T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("resource", T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).json(path)


def ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line-delimited records; blank lines are no records."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def record_batches(messages: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One row for each record of messages that hold a list of them."""
    return messages.select(F.explode(F.from_json(F.col(column).cast("string"), f"array<{schema}>")).alias("r")).select("r.*")


def own(events: DataFrame, source: str = "source") -> DataFrame:
    """Without copies of a consortium's shared records."""
    return events.where(~F.coalesce(F.col(source).startswith("CONSORTIUM-"), F.lit(False)))


def real_units(units: DataFrame) -> DataFrame:
    """Without shadow location units."""
    return units.where(~F.coalesce("is_shadow", F.lit(False)))


def accepted(events: DataFrame) -> DataFrame:
    """Without events that another path handles: deletions of everything, and hard deletions of authorities."""
    hard = (F.col("resource") == "authority") & (F.col("type") == "DELETE") & (F.col("deleteEventSubType") == "HARD_DELETE")
    return events.where((F.col("type") != "DELETE_ALL") & ~F.coalesce(hard, F.lit(False)))


def parents(events: DataFrame, old: Column, new: Column) -> DataFrame:
    """One row for each parent an event touches: the old and the new one, if it moved."""
    return events.withColumn("parent_id", F.explode(F.array_distinct(F.array_compact(F.array(old, new)))))


def sharing_completed(shared: DataFrame, relations: DataFrame, call_numbers: DataFrame, stamp: Column) -> DataFrame:
    """Call numbers after instances (``instance_id``) became shared: those of the instances get the time stamp, so they are indexed again."""
    ids = relations.join(shared.select("instance_id"), "instance_id", "left_semi").select(F.col("call_number_id").alias("id"))
    return tables.touched(call_numbers, ids, "id", stamp)
