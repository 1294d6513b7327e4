"""Table operations by key: last event, latest row, insert-ignore, upsert, difference, keyset scans, hex ranges.

Without an ACID table format an upsert is copy on write: old rows whose key is not replaced, and the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_events(events: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts",), kind: str = "type", tenant: str | None = None) -> DataFrame:
    """The last event of each key, by ``order``, and by all columns where that is equal; found by one aggregation, combined before the shuffle.

    Two exceptions keep both of exactly two events of different tenants: a creation with a deletion (the record
    changes its owner), and a creation with an update (the record becomes shared)."""
    whole = F.struct(*events.columns)
    # maps have no order; they are compared as text
    place = F.struct(*[F.col(c) for c in order], *[F.to_json(c) if "map<" in t else F.col(c) for c, t in events.dtypes])
    aggs = [F.max_by(whole, place).alias("last")]
    if tenant is None:
        return events.groupBy(F.col(key).alias("__k")).agg(*aggs).select("last.*")
    # the rows of a pair are its greatest and its least
    aggs += [F.min_by(whole, place).alias("first"), F.count(F.lit(1)).alias("n")]
    last, first = F.col("last"), F.col("first")
    kinds = F.sort_array(F.array(last[kind], first[kind]))
    pair = (F.col("n") == 2) & (last[tenant] != first[tenant]) & kinds.isin(F.array(F.lit("CREATE"), F.lit("DELETE")), F.array(F.lit("CREATE"), F.lit("UPDATE")))
    kept = F.when(pair, F.array(last, first)).otherwise(F.array(last))
    return events.groupBy(F.col(key).alias("__k")).agg(*aggs).select(F.explode(kept).alias("row")).select("row.*")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows as they are, and new rows whose key is new."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of new rows that repeat a key one stays.  Null keys are equal to each other."""
    new = new.dropDuplicates(keys)
    same = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    return old.alias("o").join(new.select(*keys).alias("n"), same, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def touched(old: DataFrame, ids: DataFrame, key: str, stamp: Column, column: str = "last_updated_date") -> DataFrame:
    """``old`` with ``column`` set where the key is among ``ids``."""
    hit = ids.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    return old.join(hit, old[key] == F.col("__k"), "left").withColumn(column, F.when(F.col("__hit"), stamp).otherwise(F.col(column))).select(*old.columns)


def difference(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Keys to write: all of ``new`` as CREATE, and those only ``old`` has as DELETE."""
    return new.select(*keys).distinct().withColumn("action", F.lit("CREATE")).unionByName(old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti").withColumn("action", F.lit("DELETE")))


def soft_deleted(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``ids`` marked ``is_deleted``."""
    return touched(old.withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False))), ids, key, F.lit(True), "is_deleted")


def after(df: DataFrame, keys: list[str], values: list, limit: int | None = None) -> DataFrame:
    """Keyset page: rows whose keys come after ``values``, in order.  The bound on the first key alone is there for the scan to use."""
    lits = [v if isinstance(v, Column) else F.lit(v) for v in values]
    bigger = F.struct(*keys) > F.struct(*[v.alias(k) for v, k in zip(lits, keys, strict=True)])
    out = df.where((F.col(keys[0]) >= lits[0]) & bigger).orderBy(*keys)
    return out.limit(limit) if limit is not None else out


def between(df: DataFrame, key: str, low, high) -> DataFrame:
    """Range scan; both bounds reach the scan."""
    return df.where(F.col(key).between(low, high))


def hex_prefix(key: Column, level: int = 3) -> Column:
    """Range of a hexadecimal key: its first digits; there are 16 ** level ranges."""
    return F.substring(F.lower(key), 1, level)


def hex_ranges(level: int = 3) -> list[tuple[str, str]]:
    """(low, high) of each range over 40-digit keys; the last is open."""
    n = 16**level
    return [(f"{i:0{level}x}".ljust(40, "0"), f"{i + 1:0{level}x}".ljust(40, "0") if i + 1 < n else "x" * 40) for i in range(n)]


def uuid_ranges(n: int) -> list[tuple[uuid.UUID, uuid.UUID]]:
    """``n`` equal ranges over all UUIDs; both ends belong to a range."""
    size = 2**128
    return [(uuid.UUID(int=size * i // n), uuid.UUID(int=size * (i + 1) // n - 1)) for i in range(n)]


def deleted_by_tenant(df: DataFrame, tenant: str, keep_shared: bool = False) -> DataFrame:
    """``df`` without a tenant's documents, or without those that are not shared."""
    gone = F.coalesce(F.col("tenant_id") == tenant, F.lit(False))
    return df.where(~(gone & ~F.coalesce("shared", F.lit(False)) if keep_shared else gone))


def exists_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Versions:
    """A table as versioned folders and a log: a reader sees a whole version or the one before.

    Rows are dealt into ``buckets`` by their keys; a merge reads and writes the buckets that it touches only, and a version names the
    folder of each bucket.  The log is small text files, written through Spark, so any store it writes to will do.  There is one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def log(self, version: int | None = None) -> dict:
        """The last version, or one that is kept: ``version``, ``parts`` (folder of each bucket that has rows), ``batches`` (last batch of each stream)."""
        try:
            entries = self.spark.read.text(f"{self.path}/_versions")
            if version is not None:
                entries = entries.where(F.col("value").startswith(f"v{version:012d} "))
            last = entries.orderBy(F.desc("value")).limit(1).collect()
            if version is not None and not last:
                raise ValueError(f"version {version} is no longer kept")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = []
        return json.loads(last[0][0].split(" ", 1)[1]) if last else {"version": -1, "parts": {}, "batches": {}}

    def read(self, buckets: set[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or some buckets of it, as it is or as a version was; None if nothing was ever written there."""
        parts = {int(k): v for k, v in self.log(version)["parts"].items() if buckets is None or int(k) in buckets}
        return self.spark.read.parquet(*[f"{self.path}/{v}/__bucket={k}" for k, v in sorted(parts.items())]) if parts else None

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int") if keys else F.lit(0)

    def _write(self, df: DataFrame, keys: list[str], kept: dict, log: dict, batch: tuple[str, int] | None) -> str:
        n = log["version"] + 1
        name, columns = f"v{n:012d}", df.columns
        df.withColumn("__bucket", self.bucket(keys)).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{name}")
        try:
            made = [r[0] for r in self.spark.read.parquet(f"{self.path}/{name}").select("__bucket").distinct().collect()]
        except Exception as e:  # noqa: BLE001  a version without rows has no schema to read
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            made = []
        if not made and not kept:  # the table stays readable when it is empty
            df.limit(0).select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/__bucket=0")
            made = [0]
        entry = {"version": n, "parts": kept | {str(b): name for b in made}, "batches": log["batches"] | (dict([batch]) if batch else {})}
        self.spark.createDataFrame([(f"{name} {json.dumps(entry)}",)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_versions")
        if n % 16 == 15:
            self._forget(8)
        return f"{self.path}/{name}"

    def replace(self, df: DataFrame, keys: list[str] | None = None, batch: tuple[str, int] | None = None) -> str:
        return self._write(df, keys or [], {}, self.log(), batch)

    def merge(self, new: DataFrame, keys: list[str], how: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None, batch: tuple[str, int] | None = None) -> str:
        """Merge ``new`` by ``keys`` with ``how(old, new)``, an upsert if nothing else is asked for."""
        log = self.log()
        touched = {r[0] for r in new.select(self.bucket(keys).alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        old = self.read(touched)
        rows = how(old, new) if how else upsert(old, new, keys) if old is not None else new.dropDuplicates(keys)
        return self._write(rows, keys, {k: v for k, v in log["parts"].items() if int(k) not in touched}, log, batch)

    def _forget(self, kept: int) -> None:
        """Delete all but the last entries of the log, so that reading it costs the same however many versions there were."""
        entries = self.spark.read.text(f"{self.path}/_versions").select("value", F.col("_metadata.file_path").alias("file")).orderBy(F.desc("value")).collect()
        for row in entries[kept:]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(row.file)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def prune(self, keep: int = 1) -> int:
        """Delete folders and entries of the log that the last ``keep`` versions do not name; for when no reader is left on an older one."""
        self._forget(keep)
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system, gone = files.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        named = {v for r in self.spark.read.text(f"{self.path}/_versions").collect() for v in json.loads(r[0].split(" ", 1)[1])["parts"].values()}
        for status in system.listStatus(files):
            name = status.getPath().getName()
            if name.startswith("v") and name not in named:
                system.delete(status.getPath(), True)
                gone += 1
        return gone
