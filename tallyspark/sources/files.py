"""Readers and writers of files: nested archive, CSV, parquet; append, atomic replace, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources import schemas


def read_archive(spark: SparkSession, path: str, multi_line: bool = True, last_day: str | None = None, keep_missing: bool = False) -> DataFrame:
    """Flat rows (chart_date, title, artist, this_week, last_week) of a nested JSON archive of weekly charts.

    Rows without a place are skipped unless keep_missing; a week whose date can't be read gives none; a week without
    entries gives none. With multi_line the file is one JSON array, else one week per line, which
    Spark can split.
    """
    df = spark.read.schema(schemas.ARCHIVE).json(path, multiLine=multi_line)
    rows = df.select(F.try_to_date("date", "yyyy-MM-dd").alias("chart_date"), F.explode("data").alias("e")).where("chart_date IS NOT NULL")
    if last_day:
        rows = rows.where(F.col("chart_date") <= F.lit(last_day).cast("date"))
    out = rows.select("chart_date", F.col("e.song").alias("title"), F.col("e.artist").alias("artist"), F.col("e.this_week").alias("this_week"), F.col("e.last_week").alias("last_week"))
    return out if keep_missing else out.where("this_week IS NOT NULL")


def write_archive(weekly: DataFrame, path: str) -> None:
    """Weekly rows as an archive, one week per line."""
    entry = F.struct(F.col("title").alias("song"), "artist", "this_week", "last_week")
    weekly.groupBy(F.date_format("chart_date", "yyyy-MM-dd").alias("date")).agg(F.collect_list(entry).alias("data")).write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, bad_rows: str = "fail", columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema; texts may hold line ends and doubled quotes.

    bad_rows: fail, skip (rows that don't fit are dropped) or keep (nulls where they don't fit).
    """
    opts = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    if bad_rows == "skip":
        # the reader itself judges a row only by the columns that a query needs, so rows are cast here
        fields = T._parse_datatype_string(schema).fields
        raw = spark.read.csv(path, schema=T.StructType([*(T.StructField(f.name, T.StringType()) for f in fields), T.StructField("_corrupt", T.StringType())]), mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", **opts)
        fits = F.col("_corrupt").isNull()
        for f in fields:
            fits = fits & (F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull())
        df = raw.where(fits).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields))
    else:
        df = spark.read.csv(path, schema=schema, mode={"fail": "FAILFAST", "keep": "PERMISSIVE"}[bad_rows], **opts)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def load_columns(spark: SparkSession, path: str, columns: Sequence[str], keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The listed columns that exist, one row per key: the first in the given order."""
    from pyspark.sql import Window

    df = read_current(spark, path)
    have = [c for c in columns if c in df.columns]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*have)


def append_batch(df: DataFrame, path: str) -> None:
    """Adds a batch to a table, or to the version of it that holds; a failed job leaves no part of it."""
    df.write.mode("append").parquet(_version(df.sparkSession, path) or path)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of work whose keys aren't done; only the keys of done are read. Null keys stay pending."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


#: Name of the file that says which version of a table holds.
POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that holds. The pointer is a file whose name ends in the version, the greatest one counting."""
    hadoop, fs = _fs(spark, path)
    found = fs.globStatus(hadoop.Path(f"{path}/{POINTER}-*"))
    names = sorted(x.getPath().getName() for x in (found or []))
    return f"{path}/v-{names[-1].rpartition('-')[2]}" if names else None


def table_exists(spark: SparkSession, path: str) -> bool:
    return _version(spark, path) is not None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """A table as replace_table or append_batch left it."""
    return spark.read.parquet(_version(spark, path) or path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table whole: a new version is written beside the old one, then one small file makes it hold.

    Readers see the old version or the new one, and a crash at any point leaves one of them. df may read the
    table it replaces. The version before the replaced one is deleted, the replaced one stays for its readers.
    """
    spark = df.sparkSession
    hadoop, fs = _fs(spark, path)
    now = _version(spark, path)
    n = int(now.rpartition("-")[2]) + 1 if now else 1
    df.write.mode("overwrite").parquet(f"{path}/v-{n:09d}")
    if not fs.createNewFile(hadoop.Path(f"{path}/{POINTER}-{n:09d}")):
        raise OSError(f"{path} was replaced by another writer")
    for old in (n - 2,):
        fs.delete(hadoop.Path(f"{path}/{POINTER}-{old:09d}"), False)
        fs.delete(hadoop.Path(f"{path}/v-{old:09d}"), True)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with the rows of changes in place of those with the same keys, and new ones added."""
    return table.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)
