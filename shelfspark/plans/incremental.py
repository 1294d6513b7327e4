"""Child resources kept up to date by what changes, without a rebuild.

State is three tables dealt by key (``Versions``): relations by instance, counts by entity, and entities.  A batch names the instances that
changed.  Their old relations are looked up, their new ones extracted, and the difference of the two is all that moves: counts by
(entity, tenant, shared) and by type go up and down, and an entity whose last relation goes is found by its own counts.  A batch reads
and writes the buckets that its instances and entities lie in.

A batch has a number.  Its difference is written before anything else and never made again, and each table records the
number of the last batch that it has taken, so a run that ended anywhere may be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import Versions
from . import children

GROUP = ("child", "tenant_id", "shared", "type")


@dataclass(frozen=True)
class Kind:
    """``extract``: entities and relations of instances; ``child``: the relation's entity; ``types``: its type; ``distinct``: an
    instance counts once however many relations it has."""

    extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    child: str
    types: str | None = None
    distinct: bool = False


KINDS = {
    "subject": Kind(children.subjects, "subject_id"),
    "contributor": Kind(children.contributors, "contributor_id", "type_id", True),
    "classification": Kind(children.classifications, "classification_id"),
}


def counts(relations: DataFrame, kind: Kind) -> DataFrame:
    """child, tenant_id, shared, type, n: how many of each group of relations, with a null type; and of each type there, if the kind has types."""
    rows = relations.withColumnRenamed(kind.child, "child")
    own = rows.select("child", "tenant_id", "shared", "instance_id").distinct() if kind.distinct else rows
    out = own.groupBy("child", "tenant_id", "shared").agg(F.count(F.lit(1)).alias("n")).select("child", "tenant_id", "shared", F.lit(None).cast("string").alias("type"), "n")
    if kind.types:
        typed = rows.where(F.col(kind.types) != "").groupBy("child", "tenant_id", "shared", F.col(kind.types).alias("type")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(typed)
    return out


def moved(old: DataFrame | None, new: DataFrame, kind: Kind) -> DataFrame:
    """What to add to the counts of each group to get from the old relations to the new ones."""
    both = counts(new, kind)
    if old is not None:
        both = both.unionByName(counts(old, kind).withColumn("n", -F.col("n")))
    return both.groupBy(*GROUP).agg(F.sum("n").alias("n")).where("n <> 0")


def instances_of(found: DataFrame, kind: Kind) -> DataFrame:
    """id, instances: the array that ``children.counted`` makes, from counts."""
    aggs, fields = [F.max(F.when(F.col("type").isNull(), F.col("n"))).alias("count")], ["tenant_id", "shared", "count"]
    if kind.types:
        aggs.append(F.sort_array(F.collect_set("type")).alias("type_ids"))
        fields.append("type_ids")
    level = found.groupBy("child", "tenant_id", "shared").agg(*aggs)
    return level.groupBy(F.col("child").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("instances"))


class Children:
    """The state of one kind of child in a folder."""

    def __init__(self, spark: SparkSession, path: str, kind: str, buckets: int = 64):
        self.spark, self.path, self.kind = spark, f"{path.rstrip('/')}/{kind}", KINDS[kind]
        self.name = kind
        self.relations, self.counted, self.entities = (Versions(spark, f"{self.path}/{x}", buckets) for x in ("relations", "counts", "entities"))
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, path: str) -> bool:
        return self._files.exists(self._make(f"{path}/_SUCCESS"))

    def _taken(self, table: Versions, number: int) -> bool:
        return table.log()["batches"].get(self.name, -1) >= number

    def apply(self, changes: DataFrame, number: int) -> DataFrame:
        """Take a batch of instances (id, tenant_id, shared, what the kind is extracted from, ``deleted``), each in its last state.

        Returns id, the entity's columns and ``instances`` of each entity whose counts moved; null ``instances`` for one that is gone."""
        kind, folder = self.kind, f"{self.path}/batches/{number:012d}"
        present = changes.where(~F.coalesce("deleted", F.lit(False)))
        entities, new = kind.extract(present)
        ids = changes.select(F.col("id").alias("instance_id")).distinct()
        if not self._done(f"{folder}/moved"):
            touched = {r[0] for r in ids.select(self.relations.bucket(["instance_id"]).alias("b")).distinct().collect()}  # at most as many as buckets
            old = self.relations.read(touched)
            old = old.join(ids, "instance_id", "left_semi") if old is not None else None
            moved(old, new, kind).write.mode("overwrite").parquet(f"{folder}/moved")
        change = self.spark.read.parquet(f"{folder}/moved")
        if not self._taken(self.counted, number):
            self.counted.merge(change, ["child"], lambda old, x: (x if old is None else old.unionByName(x)).groupBy(*GROUP).agg(F.sum("n").alias("n")).where("n <> 0"), (self.name, number))
        moved_ids = change.select(F.col("child").alias("id")).distinct()
        here = {r[0] for r in change.select(self.counted.bucket(["child"]).alias("b")).distinct().collect()}
        left = self.counted.read(here) if here else None
        if left is None:
            left = change.limit(0)
        now = instances_of(left.join(moved_ids, left.child == moved_ids.id, "left_semi"), kind)
        if not self._taken(self.entities, number):
            rows = moved_ids.join(entities, "id", "left").join(now.select("id", F.lit(True).alias("live")), "id", "left")
            self.entities.merge(rows, ["id"], _kept, (self.name, number))
        if not self._taken(self.relations, number):
            # an instance without relations has a row that names it, so that its old ones go
            rows = ids.join(new, "instance_id", "left")
            self.relations.merge(rows, ["instance_id"], lambda old, x: _replaced(old, x, kind.child), (self.name, number))
        known = self.entities.read({r[0] for r in moved_ids.select(self.entities.bucket(["id"]).alias("b")).distinct().collect()} or None)
        return moved_ids.join(known, "id", "left").join(now, "id", "left")

    def documents(self) -> DataFrame:
        """All entities with their ``instances``."""
        return self.entities.read().join(instances_of(self.counted.read(), self.kind), "id")


def _kept(old: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Entities that have counts: those known, and of the rest the new ones."""
    columns = [c for c in rows.columns if c != "live"]
    live = rows.where("live").drop("live")
    if old is None:
        return live
    gone = rows.where("live is null").select("id")
    return old.join(gone, "id", "left_anti").unionByName(live.join(old.select("id"), "id", "left_anti")).select(*columns)


def _replaced(old: DataFrame | None, rows: DataFrame, child: str) -> DataFrame:
    live = rows.where(F.col(child).isNotNull())
    return live if old is None else old.join(rows.select("instance_id").distinct(), "instance_id", "left_anti").unionByName(live)
