"""Portal records that arrive as files, upserted batch by batch into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from actlake.operators.store import upsert
from actlake.sources import schemas as S


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The latest version of a table that ``ingest`` keeps, or None before the first batch."""
    names = _versions(spark, table)
    return spark.read.parquet(f"{table}/v={names[-1]}") if names else None


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Complete versions: those with the mark that a finished write leaves."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(table)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(hadoop.Path(f"{table}/{n}/_SUCCESS")))


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, key: str = "id", schema: str = S.PORTAL) -> StreamingQuery:
    """Load all files of ``source`` not seen before, then stop. A batch that is tried again writes the same version again."""

    def load(batch: DataFrame, number: int) -> None:
        earlier = [v for v in _versions(spark, table) if v < number]
        new = batch.dropDuplicates([key])
        rows = upsert(spark.read.parquet(f"{table}/v={earlier[-1]}"), new, [key]) if earlier else new
        rows.write.mode("overwrite").parquet(f"{table}/v={number}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.where(F.col(key).isNotNull()).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
