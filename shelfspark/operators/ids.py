"""Identifier jobs: a query's ids, extracted once, kept as a table, streamed and cleaned up."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFoundError, QueryError
from ..model import Resource
from .search import matched
from .tables import Versions

#: Path of the ids that a job of each entity type extracts.
PATHS = {"INSTANCE": "id", "HOLDINGS": "holdings.id", "ITEM": "items.id", "AUTHORITY": "id"}


def extracted(df: DataFrame, cql: str, resource: Resource, path: str = "id") -> DataFrame:
    """Distinct ``id`` of the matching rows, at a path that may go through an array."""
    found = matched(df, cql, resource)
    c = F.col(path)
    kind = found.select(c.alias("x")).schema["x"].dataType.typeName()
    return found.select((F.explode(c) if kind == "array" else c).alias("id")).where("id is not null").distinct()


@dataclass(frozen=True)
class Scroll:
    """Pages of a query's rows in key order, all of the version of the table that the first page was read from.

    A cursor is a text that names the version and the last key; nothing else is kept, so any process can go on with it."""

    table: Versions
    resource: Resource

    def page(self, cql: str, size: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """(rows, cursor of the next page or None behind the last one)."""
        at = json.loads(cursor) if cursor else {"version": self.table.log()["version"]}
        rows = self.table.read(version=at["version"])
        if rows is None:
            raise NotFoundError("there is no version of the table yet")
        found, key = matched(rows, cql, self.resource), self.resource.key
        if "last" in at:
            found = found.where(F.col(key) > F.lit(at["last"]))
        page = found.orderBy(key).limit(size)
        last, n = page.agg(F.max(key), F.count(F.lit(1))).first()
        return page, json.dumps({"version": at["version"], "last": last}) if n == size else None


class Jobs:
    """Jobs by id: IN_PROGRESS, then COMPLETED or ERROR, and DEPRECATED once their ids were streamed.

    States are files whose names say job, number and state, so they outlast the process; the store's create-if-absent decides which of two
    processes moves a job."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self, job: str) -> list[str]:
        folder = self._make(f"{self.path}/{job}/_state")
        return sorted(s.getPath().getName() for s in self._files.listStatus(folder)) if self._files.exists(folder) else []

    def state(self, job: str) -> str | None:
        entries = self._entries(job)
        return entries[-1].split("-")[1] if entries else None

    def _move(self, job: str, state: str) -> None:
        # the name of the number alone decides who moves it
        n = len([e for e in self._entries(job)])
        self._files.create(self._make(f"{self.path}/{job}/_turn/{n:06d}"), False).close()
        self._files.create(self._make(f"{self.path}/{job}/_state/{n:06d}-{state}"), False).close()

    def run(self, job: str, df: DataFrame, cql: str, resource: Resource, entity: str) -> None:
        if entity not in PATHS:
            raise QueryError(f"Entity type {entity} is not supported")
        self._move(job, "IN_PROGRESS")
        try:
            extracted(df, cql, resource, PATHS[entity]).write.mode("overwrite").parquet(f"{self.path}/{job}/ids")
        except Exception:
            self._move(job, "ERROR")
            raise
        self._move(job, "COMPLETED")

    def stream(self, job: str) -> Iterator[str]:
        """Ids one partition at a time; a job is streamed once."""
        if self.state(job) != "COMPLETED":
            raise NotFoundError(f"Completed async job with query '{job}' was not found")
        for row in self.spark.read.parquet(f"{self.path}/{job}/ids").toLocalIterator(prefetchPartitions=True):
            yield row["id"]
        self._move(job, "DEPRECATED")

    def clean(self) -> list[str]:
        """Delete the ids of jobs that were streamed or failed; which ones."""
        root, gone = self._make(self.path), []
        for status in self._files.listStatus(root) if self._files.exists(root) else []:
            job = status.getPath().getName()
            ids = self._make(f"{self.path}/{job}/ids")
            if self.state(job) in ("DEPRECATED", "ERROR") and self._files.exists(ids):
                self._files.delete(ids, True)
                gone.append(job)
        return sorted(gone)
