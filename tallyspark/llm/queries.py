"""Queries over the tables of the chart corpus, one group per problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import encode, leakage, matching, offensive, subjects, truncated, variants
from tallyspark.operators.packed import protected_names
from tallyspark.session import read_table


def _protected(spark: SparkSession, d: str) -> tuple[str, ...]:
    return protected_names(read_table(spark, d, "protected_acts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched_rows(read_table(spark, d, "mb_songs"), _protected(spark, d)).select("row_id_1", "row_id_2")


def p2_scored(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched_rows(read_table(spark, d, "mb_songs"), _protected(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return matching.song_classes(read_table(spark, d, "mb_songs"), _protected(spark, d))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return truncated.score_cuts(read_table(spark, d, "lyrics"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("is_cut").select("lyric_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncated.cut_rates(_cuts(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.linked_spellings(read_table(spark, d, "mb_songs"), _protected(spark, d))


def p4_acts(spark: SparkSession, d: str) -> DataFrame:
    return variants.cluster(variants.act_names(read_table(spark, d, "mb_songs"), _protected(spark, d)))


def _language(spark: SparkSession, d: str) -> DataFrame:
    return offensive.score_texts(read_table(spark, d, "songs_analysis"), read_table(spark, d, "content_labels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _language(spark, d).where("offensive").select("song_id")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return _language(spark, d).select("song_id", "score")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return offensive.rates(read_table(spark, d, "songs_analysis"), _language(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(read_table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "eval_items")
    n = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
    return items.select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("docs", F.lit(0)).alias("docs"))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_shares(read_table(spark, d, "documents"), read_table(spark, d, "subject_labels"), read_table(spark, d, "subject_areas"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.found(_shares(spark, d))


def p8_make_up(spark: SparkSession, d: str) -> DataFrame:
    return subjects.make_up(_shares(spark, d), read_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_scored, p2_classes, p3_found, p3_rates, p4_found, p4_acts, p5_found, p5_scores, p5_rates, p6_ids, p7_found, p7_items, p8_found, p8_make_up)}


def oracle_sql() -> dict[str, str]:
    """None of these can be said in SQL; tests hold them against brute force, round trips and held-out labels."""
    return {}
