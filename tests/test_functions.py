"""Scalar functions on the small cases that define them."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import genres
from tallyspark.functions import text as tx


def one(spark, expr, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]) if values[0] is not None else spark.createDataFrame([(None,)], "c0 string")
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (tx.cell_text, "nan", ""),
        (tx.cell_text, None, ""),
        (tx.cell_text, "  a ", "a"),
        (tx.normalize_text, "Señor Ñandú (Live) feat. X!", "señor ñandú x"),
        (tx.normalize_text, None, ""),
        (tx.split_credit, "Cardi B Featuring 21 Savage", ["cardi b", "21 savage"]),
        (tx.split_credit, "Lil Nas X & Jack Harlow", ["lil nas-x", "jack harlow"]),
        (tx.lead_artist, "A Duet With B", "a"),
        (tx.has_feature, "A Feauring B", True),
        (tx.has_feature, "A & B", False),
        (tx.title_key, "Song (Do It)", "song"),
        (tx.title_key, "Song (Interlude)", "song (interlude)"),
        (tx.is_version, "Song (1947)", True),
        (tx.labels, "a| b||", ["a", "b"]),
        (tx.labels, None, []),
        (tx.counts, "1|2", [1, 2]),
        (tx.counts, "1|x", []),
        (tx.drop_tags, "[Verse 2:\nDrake] hi [open", " hi [open"),
        (tx.unique_word_ratio, "baby baby baby oh", 0.5),
        (tx.word_count, "  ", None),
        (tx.repetition_score, "a\nb\na\nc", 0.5),
        (tx.repetition_score, "", None),
        (tx.has_strong_word, "a shoe fits", False),
        (tx.has_strong_word, "two hoes", True),
        (tx.has_strong_word, "", None),
        (tx.expand_repeats, "hey\nsay (x3)", ["hey", "say", "say", "say"]),
        (tx.full_date, "2019", None),
        (tx.holiday_title, "My Xmas Song", True),
        (tx.holiday_title, None, False),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f("c0"), value) == want


@pytest.mark.parametrize("label,want", [("latin pop", "Latin"), ("country pop", "country"), ("pop rap", "hip-hop/rap"), ("dance-pop", "pop"), ("trap soul", "R&B"), ("dancehall", "other"), ("grape", "other"), ("Hip-Hop", "hip-hop/rap"), ("indie rock", "rock/alternative"), (None, None)])
def test_genre(spark, label, want):
    assert one(spark, genres.broad_genre(F.col("c0")), label) == want


@pytest.mark.parametrize("v,want", [(1, "1"), (2, "2-4"), (4, "2-4"), (9, "5-9"), (10, "10+"), (0, None)])
def test_bands(spark, v, want):
    assert one(spark, tx.bands("c0", [0, 1, 4, 9, 1e9], ["1", "2-4", "5-9", "10+"]), v) == want


def test_seasons(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.date(2020, 12, 5),), (dt.date(2021, 1, 2),), (dt.date(2021, 6, 1),)], "d date")
    assert [r[0] for r in df.select(tx.season_year("d")).collect()] == [2020, 2020, None]
