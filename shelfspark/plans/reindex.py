"""Full rebuild: merge ranges of records into base tables, then upload each resource's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..operators import tables
from . import documents

MERGE_TYPES = ("instance", "holdings", "item")
FIXED_STAMP = "2000-01-01 00:00:00"


@dataclass
class Status:
    """State of each entity: MERGE_IN_PROGRESS, MERGE_COMPLETED or _FAILED, STAGING_*, UPLOAD_IN_PROGRESS, UPLOAD_COMPLETED or _FAILED."""

    states: dict[str, str] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)
    total: dict[str, int] = field(default_factory=dict)

    def start(self, entity: str, phase: str, total: int) -> None:
        if any(s.endswith("IN_PROGRESS") for s in self.states.values()) and phase == "UPLOAD" and self.states.get(entity, "").endswith("IN_PROGRESS"):
            raise QueryError(f"{entity} is in progress")
        self.states[entity], self.done[entity], self.total[entity] = f"{phase}_IN_PROGRESS", 0, total

    def processed(self, entity: str, n: int = 1) -> None:
        self.done[entity] += n
        if self.done[entity] >= self.total[entity]:
            self.states[entity] = self.states[entity].replace("IN_PROGRESS", "COMPLETED")

    def failed(self, entity: str) -> None:
        self.states[entity] = self.states[entity].replace("IN_PROGRESS", "FAILED")

    def merge_complete(self) -> bool:
        return sum(self.states.get(t) == "MERGE_COMPLETED" for t in MERGE_TYPES) == len(MERGE_TYPES)


def staged(base: DataFrame, staging: DataFrame, keys: list[str], inserted: str = "inserted_at") -> DataFrame:
    """``base`` after a migration: the latest staged row of each key replaces it, with a fixed time stamp that marks it."""
    rows = tables.latest(staging, keys, [F.desc_nulls_last(inserted)]).drop(inserted)
    return tables.upsert(base, rows.withColumn("last_updated_date", F.lit(FIXED_STAMP).cast("timestamp")), keys)


def member_documents(local: DataFrame, central: DataFrame, holdings: DataFrame, tenant: str) -> DataFrame:
    """Instances a member uploads: its own, and the shared ones that it has holdings of."""
    held = holdings.where(F.col("tenant_id") == tenant).select(F.col("instance_id").alias("id"))
    return local.where(F.col("tenant_id") == tenant).unionByName(tables.exists_in(central.where("shared"), held, ["id"]))


def member_assembled(local: DataFrame, central: DataFrame, holdings: DataFrame, items: DataFrame, tenant: str) -> DataFrame:
    """What a member uploads, with its own holdings (id, instance_id, tenant_id, ...) and the items (holding_id, tenant_id, ...) of those.

    Each is made one row an instance before it is joined, so holdings are not repeated for their items, nor items for holdings."""
    mine = holdings.where(F.col("tenant_id") == tenant).dropDuplicates(["id"])
    below = items.where(F.col("tenant_id") == tenant).join(mine.select(F.col("id").alias("holding_id"), "instance_id"), "holding_id")
    return documents.assembled(member_documents(local, central, holdings, tenant), mine, below)


def ranges(df: DataFrame, key: str = "id", level: int = 3) -> DataFrame:
    """Rows of each hexadecimal range of the key."""
    return df.groupBy(tables.hex_prefix(F.col(key), level).alias("range")).agg(F.count(F.lit(1)).alias("rows"))


class Rebuild:
    """A rebuild by ranges of the key's hexadecimal digits, with a stored ledger: which ranges are done, with how many rows, and which failed.

    Ranges are worked on together, in halves where that fails, down to single ones; a range that fails alone is entered as failed with its
    error, and all others are written.  A run does the ranges that are not done, so after a failure only those that failed, and
    after a lost driver those not entered.  A range counts once its folder is in the ledger; folders that are not are never read."""

    def __init__(self, spark: SparkSession, path: str, level: int = 3):
        self.spark, self.path, self.level = spark, path.rstrip("/"), level
        self.all = tuple(f"{i:0{level}x}" for i in range(16**level))

    def entries(self) -> dict[str, dict]:
        """The last entry of each range: state COMPLETED or FAILED, rows, folder, error."""
        try:
            rows = self.spark.read.schema("seq long, range string, state string, rows long, folder string, error string").json(f"{self.path}/_ledger").orderBy("seq").collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return {r.range: r.asDict() for r in rows}

    def _enter(self, entries: list[tuple]) -> None:
        seq = max((e["seq"] for e in self.entries().values()), default=-1) + 1
        rows = self.spark.createDataFrame([(seq, *e) for e in entries], "seq long, range string, state string, rows long, folder string, error string")
        rows.coalesce(1).write.mode("append").json(f"{self.path}/_ledger")

    def pending(self) -> list[str]:
        done = self.entries()
        return [r for r in self.all if done.get(r, {}).get("state") != "COMPLETED"]

    def state(self, phase: str = "UPLOAD") -> str:
        """Of the whole: NEW, IN_PROGRESS, FAILED or COMPLETED, behind the phase's name."""
        entries = self.entries()
        if not entries:
            return f"{phase}_NEW"
        states = {e["state"] for e in entries.values()}
        return f"{phase}_FAILED" if "FAILED" in states else f"{phase}_COMPLETED" if len(entries) == len(self.all) else f"{phase}_IN_PROGRESS"

    def run(self, source: DataFrame, make: Callable[[DataFrame], DataFrame], key: str = "id") -> list[str]:
        """Write ``make`` of the rows of each range not done; which ranges were written.  ``make`` has to keep the key."""
        todo, written = self.pending(), []
        place = tables.hex_prefix(F.col(key), self.level)

        def work(part: list[str]) -> None:
            folder = f"rows-{uuid.uuid4().hex}"
            # neighbouring ranges are one condition on the key, which reaches the scan
            rows = source.where(place.between(part[0], part[-1]) if len(part) == self._span(part) else place.isin(*part))
            try:
                made = make(rows).withColumn("__range", place)
                made.repartition("__range").write.partitionBy("__range").parquet(f"{self.path}/{folder}")
                found = dict(map(tuple, self.spark.read.schema("__range string").parquet(f"{self.path}/{folder}").groupBy("__range").count().collect()))
            except Exception as e:  # noqa: BLE001
                if len(part) == 1:
                    self._enter([(part[0], "FAILED", None, None, str(e)[:2000])])
                    return
                for half in (part[: len(part) // 2], part[len(part) // 2 :]):
                    work(half)
                return
            self._enter([(r, "COMPLETED", found.get(r, 0), folder, None) for r in part])
            written.extend(part)

        if todo:
            work(todo)
        return written

    def _span(self, part: list[str]) -> int:
        return int(part[-1], 16) - int(part[0], 16) + 1

    def read(self) -> DataFrame | None:
        """Rows of all ranges done; None if there are none."""
        full = [e for e in self.entries().values() if e["state"] == "COMPLETED" and e["rows"]]
        paths = [f"{self.path}/{e['folder']}/__range={e['range']}" for e in full]
        return self.spark.read.parquet(*paths) if paths else None


def merge_complete(rebuilds: dict[str, Rebuild]) -> bool:
    """Whether every type that is merged is."""
    return all(t in rebuilds and rebuilds[t].state("MERGE") == "MERGE_COMPLETED" for t in MERGE_TYPES)


def upload(documents: DataFrame, write: Callable[[DataFrame], None], status: Status, entity: str) -> None:
    """One job for the whole resource: partitions take the place of ranges, task retries that of failed ones."""
    status.start(entity, "UPLOAD", 1)
    try:
        write(documents)
    except Exception:
        status.failed(entity)
        raise
    status.processed(entity)
