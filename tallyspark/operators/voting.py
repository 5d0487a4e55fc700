"""Votes of packed labels for broad groups, with ties broken by a second voter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import genres, text as tx


def label_votes(df: DataFrame, id_col: str, labels: str, counts: str, missing: str = "one") -> DataFrame:
    """(id, genre, votes, first_seen): votes per broad genre.

    Counts that are missing or don't line up with the labels give every label one vote, or, with
    missing="rank", n..1 votes in their order; with missing="drop" such rows have no vote.
    """
    one = df.select(F.col(id_col), tx.labels(labels).alias("l"), tx.counts(counts).alias("c")).where(F.size("l") > 0)
    weight = F.transform("l", lambda x, i: F.size("l") - i) if missing == "rank" else F.transform("l", lambda x: F.lit(1))
    if missing == "drop":
        one = one.where(F.size("l") == F.size("c"))
    c = F.when(F.size("l") == F.size("c"), F.col("c")).otherwise(weight)
    return (
        one.select(id_col, F.posexplode(F.arrays_zip(F.col("l").alias("l"), c.alias("n"))).alias("pos", "x"))
        .select(id_col, "pos", genres.broad_genre(F.col("x.l")).alias("genre"), F.col("x.n").cast("long").alias("n"))
        .groupBy(id_col, "genre")
        .agg(F.sum("n").alias("votes"), F.min("pos").alias("first_seen"))
    )


def winners(votes: DataFrame, id_col: str) -> DataFrame:
    """(id, leaders, top): the genres with the most votes, in order of name."""
    w = Window.partitionBy(id_col)
    return votes.withColumn("top", F.max("votes").over(w)).where("votes = top").groupBy(id_col, "top").agg(F.array_sort(F.collect_list("genre")).alias("leaders"))


def vote_genre(songs: DataFrame, second: DataFrame, id_col: str, second_id: str) -> DataFrame:
    """(id, genre, step): a song's own votes; without any the second voter's; a tie goes to the leader with
    the most second votes if it is alone, else "mixed"; no label anywhere gives null.

    songs: id, second_id, genres, genre_counts; second: second_id, genres, genre_counts.
    """
    sv = label_votes(songs, id_col, "genres", "genre_counts")
    av = label_votes(second.dropDuplicates([second_id]), second_id, "genres", "genre_counts")
    top = winners(sv, id_col)
    atop = winners(av, second_id).select(second_id, F.col("leaders").alias("a_leaders"))
    tie = top.where(F.size("leaders") > 1).select(id_col, F.explode("leaders").alias("genre")).join(songs.select(id_col, second_id), id_col).join(av.select(second_id, "genre", F.col("votes").alias("a_votes")), [second_id, "genre"])
    broken = winners(tie.select(id_col, "genre", F.col("a_votes").alias("votes")).where("votes > 0"), id_col).where(F.size("leaders") == 1).select(id_col, F.col("leaders")[0].alias("tie_genre"))
    j = songs.select(id_col, second_id).join(top, id_col, "left").join(broken, id_col, "left").join(atop, second_id, "left")
    own, tied, sec = F.size("leaders"), F.col("tie_genre"), F.size("a_leaders")
    genre = F.when(own == 1, F.col("leaders")[0]).when(own > 1, F.coalesce(tied, F.lit("mixed"))).when(sec == 1, F.col("a_leaders")[0]).when(sec > 1, "mixed")
    step = F.when(own == 1, "votes").when((own > 1) & tied.isNotNull(), "artist").when(own > 1, "tie").when(sec == 1, "artist only").when(sec > 1, "tie").otherwise("none")
    return j.select(id_col, genre.alias("genre"), step.alias("step"))


def vote_in_steps(songs: DataFrame, second: DataFrame, id_col: str, second_id: str, missing: str = "rank") -> DataFrame:
    """(id, genre, multi_genre, step): the most voted genre by "counts"; a tie goes to the leader with the most second
    votes by "artist", else is left a "tie"; without labels "none". multi_genre lists all genres, most voted first.
    """
    sv = label_votes(songs, id_col, "genres", "genre_counts", missing)
    av = label_votes(second.dropDuplicates([second_id]), second_id, "genres", "genre_counts", missing)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "first_seen", "genre")))
    multi = sv.groupBy(id_col).agg(F.array_join(F.transform(listed, lambda x: x["genre"]), "|").alias("multi_genre"))
    top = winners(sv, id_col)
    tie = top.where(F.size("leaders") > 1).select(id_col, F.explode("leaders").alias("genre")).join(songs.select(id_col, second_id), id_col).join(av.select(second_id, "genre", F.col("votes").alias("a_votes")), [second_id, "genre"])
    broken = winners(tie.select(id_col, "genre", F.col("a_votes").alias("votes")).where("votes > 0"), id_col).where(F.size("leaders") == 1).select(id_col, F.col("leaders")[0].alias("tie_genre"))
    own, tied = F.size("leaders"), F.col("tie_genre")
    j = songs.select(id_col).join(top, id_col, "left").join(multi, id_col, "left").join(broken, id_col, "left")
    genre = F.when(own == 1, F.col("leaders")[0]).when(own > 1, F.coalesce(tied, F.lit("tie")))
    step = F.when(own == 1, "counts").when((own > 1) & tied.isNotNull(), "artist").when(own > 1, "tie").otherwise("none")
    return j.select(id_col, genre.alias("genre"), F.coalesce("multi_genre", F.lit("")).alias("multi_genre"), step.alias("step"))


def vote_overall(songs: DataFrame, second: DataFrame, id_col: str, second_id: str) -> DataFrame:
    """(id, genre): a song's winner; where it has none or several, the second voter's own overall winner; several winners are "mixed"."""
    one = lambda v, k: winners(v, k).select(k, F.when(F.size("leaders") == 1, F.col("leaders")[0]).otherwise("mixed").alias("won"))
    sv = one(label_votes(songs, id_col, "genres", "genre_counts"), id_col)
    av = one(label_votes(second.dropDuplicates([second_id]), second_id, "genres", "genre_counts"), second_id).withColumnRenamed("won", "a_won")
    j = songs.select(id_col, second_id).join(sv, id_col, "left").join(av, second_id, "left")
    return j.select(id_col, F.when(F.col("won").isNull() | (F.col("won") == "mixed"), F.coalesce("a_won", "won")).otherwise(F.col("won")).alias("genre"))
