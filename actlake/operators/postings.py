"""Full-text search through a posting table: (token, id) rows sorted by token, so that a prefix is a range of it.

The table is kept in a versioned store. Postings are partitioned by range of token and id and sorted, so a token that a third of all rows
hold spreads over many files, and file and row-group statistics let a prefix read only its range. All prefixes of a query are one
scan; a row's hits are bits of a mask, and rows with all bits are found. A later load appends the postings of its rows under its own
number and the older ones of these rows no longer count, without rewriting them; ``compact`` folds all loads into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.functions import text as T
from actlake.sources.versions import VersionedStore

#: Characters of text, and postings, that one range is sorted from: a larger load makes more ranges, so that a task's memory doesn't grow.
RANGE_CHARS, RANGE_ROWS = 1 << 24, 1 << 21
#: Prefixes that one mask of 64 bits holds.
_BITS = 62


def postings(rows: DataFrame, texts: list[Column], id_col: str = "id") -> DataFrame:
    """(token, id): each distinct folded word of a row's texts."""
    words = F.array_distinct(F.split(T.fold(F.concat_ws(" ", *texts)), T.BETWEEN_WORDS))
    return rows.select(F.explode(words).alias("token"), F.col(id_col).alias("id")).where("token != ''")


class TextIndex:
    """A posting table ``name`` in ``store``. Ids are unique in each load, and a later load's row replaces an earlier one with its id."""

    def __init__(self, store: VersionedStore, name: str = "postings"):
        self.store, self.name, self.owners = store, name, f"{name}_rows"

    @staticmethod
    def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
        keys = ["token", "id"]
        usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(ranges, *keys) if ranges > usual else rows.repartitionByRange(*keys)
        return dealt.sortWithinPartitions(*keys)

    def _tables(self, rows: DataFrame, texts: list[Column], id_col: str) -> dict[str, DataFrame]:
        load = F.lit(self.store.version() + 1).cast("long").alias("load")
        chars = rows.agg(F.sum(F.length(F.concat_ws(" ", *texts)))).first()[0] or 0
        return {self.name: self._ranged(postings(rows, texts, id_col), -(-chars // RANGE_CHARS)).select("token", "id", load), self.owners: rows.select(F.col(id_col).alias("id"), load)}

    def build(self, rows: DataFrame, texts: list[Column], id_col: str = "id", batch: tuple[str, int] | None = None) -> int:
        """The postings of ``rows`` alone. Rows without text have no posting; a null id is never found."""
        return self.store.commit(replaced=self._tables(rows, texts, id_col), batch=batch)

    def update(self, rows: DataFrame, texts: list[Column], id_col: str = "id", batch: tuple[str, int] | None = None) -> int:
        """Adds a load: new rows, and rows whose texts have changed. Of the older rows only these are no longer found by their old words."""
        return self.store.commit(appended=self._tables(rows, texts, id_col), batch=batch)

    def compact(self) -> int:
        """All loads as one."""
        kept, owners = self.store.read(self.name), self.store.read(self.owners)
        rows, ranges = self._current(kept), -(-kept.count() // RANGE_ROWS)
        load = F.lit(self.store.version() + 1).cast("long").alias("load")
        return self.store.commit(replaced={self.name: self._ranged(rows.select("token", "id"), ranges).select("token", "id", load), self.owners: owners.select("id").distinct().select("id", load)})

    def _current(self, found: DataFrame) -> DataFrame:
        """Rows (id, load, ...) of ``found`` that no later load has replaced. The first load can't have replaced anything and isn't read."""
        later = self.store.read(self.owners, first=1)
        if later is None:
            return found
        last = later.groupBy(F.col("id").alias("_id")).agg(F.max("load").alias("_last"))
        return found.join(last, (F.col("id") == F.col("_id")) & (F.col("_last") > F.col("load")), "left_anti")

    def search(self, query: str) -> DataFrame | None:
        """(id) of the rows where every word of the query (three characters or more) begins some word; None if it has no such word."""
        tokens = T.query_tokens(query)
        if not tokens:
            return None
        prefixes = [F.lit(T.fold_plain(t)) for t in dict.fromkeys(tokens)]
        hits = [F.startswith("token", p) for p in prefixes]
        parts = [range(k, min(k + _BITS, len(hits))) for k in range(0, len(hits), _BITS)]
        masks = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(hits[i], 1 << (i - p.start)).otherwise(0).cast("long") for i in p]) for p in parts]
        read = self.store.read(self.name).where(reduce(lambda a, b: a | b, hits))
        seen = read.groupBy("id", "load").agg(*(F.bit_or(m).alias(f"m{k}") for k, m in enumerate(masks)))
        whole = reduce(lambda a, b: a & b, [F.col(f"m{k}") == (1 << len(p)) - 1 for k, p in enumerate(parts)])
        return self._current(seen.where(whole)).select("id")
