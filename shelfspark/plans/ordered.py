"""Tables stored in the order of a browse: a page reads the files around its anchor and no others.

Rows are dealt by range of the normalised first key and the further keys, nulls last, and each range is a folder of its own.  A
small table beside them has each range's least and greatest key and its number of rows.  From it a page takes the ranges on
either side of the anchor, as many as surely have enough rows; where conditions leave rows out, they are counted, and twice as many
ranges are taken until there are enough or no more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..model import Resource
from ..operators.browse import Context, Order, first_key


@dataclass(frozen=True)
class Ordered:
    spark: SparkSession
    path: str
    order: Order

    @classmethod
    def write(cls, df: DataFrame, resource: Resource, path: str, order: Order, parts: int | None = None) -> Ordered:
        """Store ``df`` with ``norm__`` of the first key.  ``parts``: how many ranges, of which each should be a file's worth of rows."""
        f, first = resource.get(order.keys[0]), first_key(order, resource, df.columns)
        rest = [F.col(k).asc_nulls_last() for k in order.keys[1:]]
        name = order.keys[0] if f is None else f"norm__{f.path.replace('.', '__')}"
        rows = df.withColumn(name, first)
        by = [F.col(name).asc_nulls_last(), *rest]
        dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
        dealt = dealt.withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", *by)
        dealt.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
        stored = df.sparkSession.read.parquet(f"{path}/rows")
        bounds = stored.groupBy("range").agg(F.min(name).alias("low"), F.max(name).alias("high"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(name).isNull()).alias("nulls"))
        bounds.repartitionByRange("range").sortWithinPartitions("range").write.mode("overwrite").parquet(f"{path}/bounds")
        return cls(df.sparkSession, path, order)

    def rows(self, ranges: list[Row] | None = None) -> DataFrame:
        """The table, or some ranges of it."""
        read = self.spark.read.option("basePath", f"{self.path}/rows")
        if ranges is None:
            return read.parquet(f"{self.path}/rows").drop("range")
        if not ranges:
            return self.rows().limit(0)
        return read.parquet(*[f"{self.path}/rows/range={r.range}" for r in ranges]).drop("range")

    def _side(self, behind: bool, key: str, included: bool, need: int, left: Callable[[DataFrame], DataFrame] | None, first: Callable[[list[str]], Column]) -> list[Row]:
        bounds = self.spark.read.parquet(f"{self.path}/bounds")
        low, high = F.col("low"), F.col("high")
        side = bounds.where((high >= key) | (F.col("nulls") > 0)).orderBy("range") if behind else bounds.where(low < key).orderBy(F.desc("range"))
        take = 2
        while True:
            picked = side.limit(take).collect()
            if len(picked) < take:
                return picked
            if left is None:
                # all rows of a range behind the first one picked lie on this side; those equal to the anchor count where they are wanted
                sure = [r for r in picked[1:] if not behind or included or r.low is None or r.low > key]
                enough = sum(r.rows for r in sure) >= need
            else:
                rows = left(self.rows(picked))
                at = first(rows.columns)
                wanted = ((at >= key if included else at > key) | at.isNull()) if behind else at < key
                enough = rows.where(wanted).limit(need).count() >= need
            if enough:
                return picked
            take *= 2

    def near(self, ctx: Context, key: str, resource: Resource, left: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Rows among which a page around ``key`` is the same as among all.  ``left``: what conditions leave of a table; none if they leave all."""
        need = ctx.backward + ctx.forward + 1
        first = lambda columns: first_key(self.order, resource, columns)
        ranges: dict[int, Row] = {}
        if key != "":
            for behind, wanted in ((True, ctx.forward > 0 or ctx.included), (False, ctx.backward > 0)):
                for r in self._side(behind, key, ctx.included, need, left, first) if wanted else ():
                    ranges[r.range] = r
        return self.rows([ranges[r] for r in sorted(ranges)])
