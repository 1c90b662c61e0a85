"""Pages deep in a sorted list: the list is kept in ranges of its order with their counts, and a page reads the ranges it lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlake.sources.versions import VersionedStore


class PagedList:
    """A list sorted by ``order`` (columns that tell all rows apart) in a versioned store, cut into ranges.

    The counts of ranges, a row for each, are what the driver holds of it.
    """

    def __init__(self, store: VersionedStore, order: list[Column], name: str = "lista"):
        self.store, self.order, self.name = store, order, name

    def build(self, rows: DataFrame, ranges: int | None = None) -> int:
        """The list of ``rows`` as a version of the store, its ranges and their counts at once."""
        dealt = rows.repartitionByRange(ranges, *self.order) if ranges else rows.repartitionByRange(*self.order)
        ranged = dealt.sortWithinPartitions(*self.order).withColumn("faixa", F.spark_partition_id())
        made, written = self.store.stage(self.name, ranged, ["faixa"])
        counts = written.groupBy("faixa").agg(F.count(F.lit(1)).alias("linhas"))
        return self.store.commit(replaced={self.name: made, f"{self.name}_faixas": counts})

    def counts(self) -> list[tuple[int, int]]:
        """(range, rows) in order."""
        return sorted((r.faixa, r.linhas) for r in self.store.read(f"{self.name}_faixas").collect())

    def places(self) -> DataFrame:
        """The whole list with ``lugar``, each row's place from 1: the rows of earlier ranges, and its place in its own."""
        starts, at = [], 0
        for key, n in self.counts():
            starts.append((key, at))
            at += n
        before = F.broadcast(self.store.spark.createDataFrame(starts, "faixa int, antes long"))  # a row for each range
        inside = F.row_number().over(Window.partitionBy("faixa").orderBy(*self.order))
        return self.store.read(self.name).join(before, "faixa").withColumn("lugar", F.col("antes") + inside).drop("faixa", "antes")

    def total(self) -> int:
        return sum(n for _, n in self.counts())

    def ranges_of(self, offset: int, size: int) -> tuple[list[int], int]:
        """The ranges that hold rows from ``offset`` on, ``size`` of them, and how many rows of the first range come before."""
        found, skip, at = [], 0, 0
        for key, n in self.counts():
            if at < offset + size and at + n > offset:
                skip = skip if found else offset - at
                found.append(key)
            at += n
        return found, max(skip, 0)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows, in order; empty beyond the last."""
        found, skip = self.ranges_of((number - 1) * size, size)
        rows = self.store.read(self.name).where(F.col("faixa").isin(found) if found else F.lit(False)).drop("faixa")
        return rows.orderBy(*self.order).offset(skip).limit(size)
