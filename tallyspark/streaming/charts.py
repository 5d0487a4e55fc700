"""Weekly files as they land: an extension for growing archives, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.sources import files


def landed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over the parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_new(stream: DataFrame, keys: list[str], event_time: str, lateness: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose keys weren't seen within the lateness; exactly once, and resumable.

    The state of seen keys is bounded by the lateness, counted in event time.
    """
    seen = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)
    return seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, event_time: str, width: str, lateness: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums per event-time window; late rows beyond the lateness are left out."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, event_time: str, gap: str, lateness: str, by: list[str]) -> DataFrame:
    """Runs of events with no pause longer than the gap."""
    return stream.withWatermark(event_time, lateness).groupBy(F.session_window(event_time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def keep_latest(stream: DataFrame, keys: list[str], order: str, table: str, checkpoint: str, parts: int = 16) -> StreamingQuery:
    """Upserts every batch into a table: of each key the row with the greatest order stays, ties by the other columns.

    The table is kept in parts by a hash of the keys, and a batch rewrites only the parts that it touches. A batch that
    is tried again gives the same table, since its rows win or lose against the table as before.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        touched = [r[0] for r in batch.select("part").distinct().collect()]  # at most parts
        rest = [c for c in batch.columns if c not in (*keys, "part")]
        for part in sorted(touched):
            new, path = batch.where(F.col("part") == part).drop("part"), f"{table}/part={part}"
            if files.table_exists(spark, path):
                new = new.unionByName(files.read_current(spark, path))
            best = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *(F.col(c).cast("string") for c in rest if c != order))).alias("x")).select(*keys, "x.*")
            files.replace_table(best, path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table: str, parts: int = 16) -> DataFrame | None:
    """The table that keep_latest keeps; None before its first batch."""
    out = None
    for part in range(parts):
        path = f"{table}/part={part}"
        if files.table_exists(spark, path):
            x = files.read_current(spark, path)
            out = x if out is None else out.unionByName(x)
    return out
