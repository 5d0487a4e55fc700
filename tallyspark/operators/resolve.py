"""Same thing under several names: pairs in blocks, groups, rename maps, fuzzy scores and cascades."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators.components import connected_components

#: Scores that count as a match, and that need no second try; the pairs' largest gap.
TRUSTED, RETRY_BELOW, TITLE_ONLY_FLOOR, MERGE_GAP_DAYS, WITHIN = 72, 90, 70, 35, 15
PENALTY = 25


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & at.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def token_sort(a: str | None, b: str | None) -> float:
    """Similarity 0-100 of two texts whose words are sorted: twice the common subsequence over both
    lengths; an empty or missing side gives 0."""
    x, y = " ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))
    if not x or not y:
        return 0.0
    return 200.0 * common_subsequence(x, y) / (len(x) + len(y))


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def artist_similarity(candidate: Column, credit: Column) -> Column:
    """Best whole-number score of a candidate against a credit and each of its names, raw and normalised."""

    @F.pandas_udf("int")
    def best(raw: pd.Series, norm: pd.Series, options: pd.Series) -> pd.Series:
        return pd.Series([max([int(token_sort(r if k % 2 == 0 else n, o)) for k, o in enumerate(os) if o], default=0) if r else 0 for r, n, os in zip(raw, norm, options, strict=True)], dtype="int32")

    names = F.concat(F.array(F.lower(tx.cell_text(credit))), F.coalesce(tx.split_credit(credit), F.array().cast("array<string>")))
    options = F.flatten(F.transform(names, lambda x: F.array(F.trim(x), tx.normalize_text(x))))
    return best(F.lower(tx.cell_text(candidate)), tx.normalize_text(candidate), options)


def match_score(title: Column, credit: Column, cand_title: Column, cand_credit: Column, penalised: Column | None = None) -> Column:
    """Rounded 0.6 title + 0.4 artist, the artist being the credit or its lead, less a penalty, at least 0."""
    t = token_sort_ratio(tx.normalize_text(title), tx.normalize_text(cand_title))
    ca = tx.normalize_text(cand_credit)
    a = F.greatest(token_sort_ratio(tx.normalize_text(credit), ca), token_sort_ratio(tx.normalize_text(tx.lead_artist(credit)), ca))
    score = 0.6 * t + 0.4 * a
    if penalised is not None:
        score = score - F.when(penalised, PENALTY).otherwise(0)
    return F.bround(F.greatest(score, F.lit(0.0)), 0).cast("int")


def best_of_cascade(candidates: DataFrame, key: Sequence[str], stage: str = "stage", score: str = "score", full: str = "full_score", text: str | None = None, instrumental: str | None = None, date: str | None = None) -> DataFrame:
    """The best candidate of the first stage that has any, per key.

    candidates have a stage number from 1 on. Within a stage the highest score wins, then the full
    credit's score, then the earliest date if there is such a column (unknown ones last), then the least candidate id (column cand). With a text column, candidates with text within WITHIN
    points of the best and trusted are preferred, and a best one without text falls back to the
    first stage's.
    """
    k = list(key)
    top = Window.partitionBy(*k, stage)
    c = candidates.withColumn("__top", F.max(score).over(top))
    good = F.lit(True)
    if text:
        good = (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0) & (F.col(score) >= F.greatest(F.col("__top") - WITHIN, F.lit(TRUSTED)))
        if instrumental:
            good = good & ~F.coalesce(F.col(instrumental), F.lit(False))
    c = c.withColumn("__good", good)
    first = Window.partitionBy(*k).orderBy(F.desc("__good"), F.asc(stage), F.desc(score), F.desc(full), *([F.asc_nulls_last(F.nullif(date, F.lit("")))] if date else []), F.asc("cand"))
    return c.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__top", "__good")


def retry_reason(method: Column, score: Column, text: Column, artist_score: Column, odd_separator: Column, stale: Column) -> Column:
    """First reason to fetch a row again, or null."""
    return (
        F.when(F.coalesce(method == "none", F.lit(False)), "unmatched")
        .when(F.coalesce(score < RETRY_BELOW, F.lit(True)), f"score<{RETRY_BELOW}")
        .when(tx.cell_text(text) == "", "no lyrics")
        .when(F.coalesce((method == "title_only") & (artist_score < TITLE_ONLY_FLOOR), F.lit(False)), "weak title-only artist")
        .when(F.coalesce(odd_separator, F.lit(False)), "separator variant")
        .when(F.coalesce(stale, F.lit(False)), "old splitter")
    )


#: Acts that changed their name, and a pair that passes every rule but is two songs (title, credits).
RENAMED = (("kanye west", "ye"), ("puff daddy", "p diddy", "diddy"), ("tekashi 6ix9ine", "6ix9ine"), ("machine gun kelly", "mgk"))
TWO_SONGS = (("special", "Lizzo Featuring SZA", "SZA"),)


def merge_pairs(credits: DataFrame, gap_days: int = MERGE_GAP_DAYS, renamed: Sequence[Sequence[str]] = RENAMED, two_songs: Sequence[tuple[str, str, str]] = TWO_SONGS, mutual_lead: bool = False) -> DataFrame:
    """(a, b): credits of one song inside a block of equal normalised titles.

    credits: id, title, artist, debut_date, last_date, weeks (array of dates). Two are one song if their
    names overlap or are names of one renamed act, their runs are at most gap_days apart, they share no week, neither
    is a version when their titles differ, and they aren't listed as two songs. With mutual_lead each
    one's lead must be on the other's credit. The block join also carries an act, so a common
    title doesn't bring together all acts that ever used it.
    """
    names = F.filter(F.array_distinct(F.transform(tx.split_credit("artist"), lambda x: tx.normalize_text(x))), lambda x: x != "")
    groups = {n: f"#{k}" for k, g in enumerate(renamed) for n in g}
    if groups:
        known = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
        names = F.array_distinct(F.concat(names, F.filter(F.transform(names, lambda x: known[x]), lambda x: x.isNotNull())))
    c = credits.select("id", "title", "artist", "debut_date", "last_date", "weeks", tx.normalize_text("title").alias("block"), tx.normalize_text(tx.lead_artist("artist")).alias("lead"), names.alias("names")).where("block <> ''")
    c = c.withColumn("name", F.explode("names"))
    l, r = c.alias("l"), c.alias("r")
    apart = F.datediff(F.greatest("l.debut_date", "r.debut_date"), F.least("l.last_date", "r.last_date"))
    version = tx.is_version(F.col("l.title")) | tx.is_version(F.col("r.title"))
    ok = (apart <= gap_days) & ~F.arrays_overlap("l.weeks", "r.weeks") & ((F.col("l.title") == F.col("r.title")) | ~version)
    if mutual_lead:
        ok = ok & F.array_contains("l.names", F.col("r.lead")) & F.array_contains("r.names", F.col("l.lead"))
    for t, x, y in two_songs:
        ok = ok & ~((F.col("l.block") == t) & (((F.col("l.artist") == x) & (F.col("r.artist") == y)) | ((F.col("l.artist") == y) & (F.col("r.artist") == x))))
    return l.join(r, (F.col("l.block") == F.col("r.block")) & (F.col("l.name") == F.col("r.name")) & (F.col("l.id") < F.col("r.id"))).where(ok).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def merge_groups(credits: DataFrame, gap_days: int = MERGE_GAP_DAYS, **rules: object) -> DataFrame:
    """(id, component) of credits that belong to groups of two or more."""
    return connected_components(merge_pairs(credits, gap_days, **rules))


def reduce_groups(credits: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per song: first and last day, best place, distinct weeks and their sum over credits, debut and final credit, merged names."""
    c = credits.join(groups, "id", "left").withColumn("song", F.coalesce("component", "id"))
    first = F.struct("debut_date", "title", "artist")
    listed = F.array_sort(F.collect_list(F.struct("debut_date", "title", "artist", F.concat_ws(" :: ", "title", "artist").alias("name"))))
    return (
        c.groupBy("song")
        .agg(
            F.min_by("title", first).alias("title"),
            F.min_by("artist", first).alias("artist"),
            F.max_by("artist", first).alias("final_artist"),
            F.min("debut_date").alias("debut_date"),
            F.max("last_date").alias("last_date"),
            F.min("peak_position").alias("peak_position"),
            F.size(F.array_distinct(F.flatten(F.collect_list("weeks")))).alias("weeks_on_chart"),
            F.sum(F.size("weeks")).alias("weeks_summed"),
            F.when(F.count(F.lit(1)) > 1, F.array_join(F.transform(listed, lambda x: x["name"]), "|")).alias("merged_from"),
        )
    )


def fuller_version(current: DataFrame, candidates: DataFrame, ratio: float = 1.2, floor: int = TITLE_ONLY_FLOOR) -> DataFrame:
    """(id, cand, chars): for each row of current (id, title, artist, chars) the longest candidate text of an equal
    title and a similar act that is at least ratio times as long; rows without one are left out.

    candidates: cand, title, artist, text, instrumental. Ties go to the least candidate.
    """
    c = candidates.where(~F.coalesce("instrumental", F.lit(False)) & (F.length(F.trim("text")) > 0)).select("cand", F.col("artist").alias("other"), F.length(F.trim("text")).alias("long"), tx.normalize_text("title").alias("block"))
    j = current.select("id", "artist", "chars", tx.normalize_text("title").alias("block")).where("block <> ''").join(c, "block").where(F.col("long") >= ratio * F.col("chars"))
    j = j.withColumn("like", artist_similarity(F.col("other"), F.col("artist"))).where(F.col("like") >= floor)
    return j.groupBy("id").agg(F.min_by("cand", F.struct(-F.col("long"), "cand")).alias("cand"), F.max("long").alias("chars"))


def rename(df: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with its keys replaced where mapping (old_<key>, new_<key>) names them; a small fixed map."""
    m = mapping
    on = [df[k] == m[f"old_{k}"] for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    rest = [df[c] for c in df.columns if c not in keys]
    return df.join(m, cond, "left").select(*(F.coalesce(m[f"new_{k}"], df[k]).alias(k) for k in keys), *rest)
