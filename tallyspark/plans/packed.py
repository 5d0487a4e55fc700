"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.packed import explode_packed, protected_names
from tallyspark.session import read_table

FIELDS = {"artist": "acts", "genres": "labels", "artist_mbids": "ids"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(read_table(spark, d, "mb_songs"), "row_id", FIELDS, protected_names(read_table(spark, d, "protected_acts")))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many values each field holds, over all rows."""
    n = p1_found(spark, d).groupBy("row_id", "field_name").agg(F.count(F.lit(1)).alias("n_items"))
    return n.groupBy("field_name", "n_items").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
SQL: dict[str, str] = {}
