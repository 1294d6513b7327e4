"""Change events to stored tables, one micro-batch at a time.

Each batch is reduced to the last event of every key and merged by key, so a batch that is run again changes nothing; the
table's log also records each stream's last batch, and one already merged is passed over.  A deletion stays in the table as a
tombstone, so an older event that comes late does not bring the record back; ``live`` leaves tombstones out.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables


def merged(old: DataFrame | None, events: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts",), keep: str | None = None) -> DataFrame:
    """State after a batch: columns of ``old``; the last event of each key, deletions too.

    ``keep``: how long before the batch's latest event (an interval such as ``7 days``) a tombstone is kept; for ever if None."""
    last = tables.last_events(events.withColumn("__key", F.struct(*keys)), "__key", order).drop("__key")
    if old is not None:
        both = old.withColumn("__new", F.lit(0)).unionByName(last.select(*old.columns).withColumn("__new", F.lit(1)))
        last = tables.latest(both, keys, [*[F.col(c).desc() for c in order], F.desc("__new")]).drop("__new")
    if keep is not None and (top := events.agg(F.max(order[0])).first()[0]) is not None:
        last = last.where((F.col("type") != "DELETE") | (F.col(order[0]) >= F.lit(top) - F.expr(f"interval {keep}")))
    return last


def live(state: DataFrame) -> DataFrame:
    """Without tombstones."""
    return state.where("type <> 'DELETE'")


def one_by_one(df: DataFrame, process: Callable[[DataFrame], object], dead: Callable[[DataFrame, str], object], tries: int = 2, wait: float = 1.0) -> None:
    """``process`` a batch; if it keeps failing, its halves, down to single rows; a row that fails alone goes to ``dead`` with the error.

    A few bad rows cost a few runs over ever smaller parts; all other rows are processed.  Between tries of the whole batch the wait
    doubles.  Where a batch without rows fails too, it is the target that fails and not a row: the error is raised and no row is dead."""

    def run(part: DataFrame, level: int) -> None:
        for left in range(tries - 1, -1, -1):
            try:
                process(part)
                return
            except Exception as e:  # noqa: BLE001  whatever a record does to its batch
                failed, error = e, str(e)[:2000]
                if left:
                    time.sleep(wait * 2 ** (tries - 1 - left) if level == 0 else 0)
        if level == 0 or level >= 64 or len(part.limit(2).collect()) < 2:
            try:
                process(part.limit(0))
            except Exception as e:  # noqa: BLE001
                raise RuntimeError("the target fails without rows too") from (failed or e)
        if level >= 64 or len(part.limit(2).collect()) < 2:
            dead(part, error)
            return
        for side in (0, 1):
            half = part.where(F.getbit(F.xxhash64(F.to_json(F.struct(*part.columns))), F.lit(level)) == side)
            if not half.isEmpty():
                run(half, level + 1)

    run(df, 0)


def run(
    stream: DataFrame, table: tables.Versions, checkpoint: str, keys: list[str], order: tuple[str, ...] = ("ts",), prepare: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True, every: str = "60 seconds", keep: str | None = None, dead_letters: str | None = None,
) -> StreamingQuery:
    """Start merging ``stream`` into ``table``.  With ``dead_letters``, a folder, rows that cannot be merged are written there as JSON
    with the error, and do not stop the stream."""

    def merge(df: DataFrame, number: int | None) -> None:
        df = prepare(df) if prepare else df
        table.merge(df, keys, lambda old, new: merged(old, new, keys, order, keep), (checkpoint, number) if number is not None else None)

    def batch(df: DataFrame, number: int) -> None:
        if number <= table.log()["batches"].get(checkpoint, -1) or df.isEmpty():
            return
        if dead_letters is None:
            merge(df, number)
            return
        rows = df.persist()
        try:
            # parts do not record the batch: if the run ends between them, all are merged again, which changes nothing
            one_by_one(rows, lambda part: merge(part, None), lambda part, error: part.select(F.to_json(F.struct(*part.columns)).alias("row"), F.lit(error).alias("error")).write.mode("append").json(dead_letters))
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by tumbling or sliding window, for streams and tables alike; rows later than ``late`` are left out of a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def session_counts(events: DataFrame, gap: str, key: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts by session of a key."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
