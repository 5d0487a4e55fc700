"""Queries through sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import contracts
from tallyspark.plans.relational import LAST_CHART
from tallyspark.session import read_table as T
from tallyspark.session import scratch
from tallyspark.sources import files
from tallyspark.streaming import charts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT chart_date, title, artist, this_week, last_week FROM weekly WHERE this_week IS NOT NULL AND chart_date <= DATE '{LAST_CHART}'")
def archive_scan(s, d):
    """Charts written as a nested archive and read back flat."""
    path = scratch(s, "archive")
    files.write_archive(T(s, d, "weekly"), path)
    return files.read_archive(s, path, multi_line=False, last_day=LAST_CHART)


@query("SELECT chart_date, title, artist, this_week, last_week FROM weekly WHERE chart_date <= DATE '2020-12-31'")
def archive_scan_all(s, d):
    """The archive up to a day, rows without a place kept."""
    path = scratch(s, "archive")
    files.write_archive(T(s, d, "weekly"), path)
    return files.read_archive(s, path, multi_line=False, last_day="2020-12-31", keep_missing=True)


@query("SELECT row_id, match_score FROM mb_songs WHERE match_score IS NULL OR match_score % 5 <> 0")
def csv_skips_bad_rows(s, d):
    """A file in which some scores are no numbers: those rows are skipped."""
    path = scratch(s, "csv")
    bad = F.when(F.col("match_score") % 5 == 0, F.concat(F.col("match_score").cast("string"), F.lit("?"))).otherwise(F.col("match_score").cast("string"))
    files.write_csv(T(s, d, "mb_songs").select("row_id", bad.alias("match_score")), path)
    return files.read_csv(s, path, "row_id BIGINT, match_score INT", "skip")


@query("SELECT chart_date, this_week FROM weekly")
def csv_dates_and_columns(s, d):
    """Days and a few columns of a file."""
    path = scratch(s, "csv")
    files.write_csv(T(s, d, "weekly").select("chart_date", "title", "artist", "this_week"), path)
    return files.read_csv(s, path, "chart_date DATE, title STRING, artist STRING, this_week INT", columns=["chart_date", "this_week"])


@query("SELECT title, artist, match_score, fetched_at FROM mb_songs QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY fetched_at DESC NULLS LAST, row_id) = 1")
def columns_by_key(s, d):
    """Listed columns, as far as they exist, of the first row per key."""
    return files.load_columns(s, f"{d}/mb_songs.parquet", ["title", "artist", "match_score", "fetched_at", "no_such_column"], ["title", "artist"], [F.desc_nulls_last("fetched_at"), F.col("row_id")])


@query("SELECT column_name, (SELECT count(*) FROM mb_artists) AS agree FROM (VALUES ('artist_mbid'), ('artist_name'), ('artist_type'), ('country'), ('gender'), ('begin_date'), ('genres'), ('genre_counts')) v(column_name)")
def round_trip(s, d):
    """A table written as CSV, read back and compared column by column with what was written."""
    cols = ["artist_mbid", "artist_name", "artist_type", "country", "gender", "begin_date", "genres", "genre_counts"]
    path = scratch(s, "csv")
    w = Window.partitionBy(*cols).orderBy(F.lit(1))
    number = lambda t: t.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in cols)).withColumn("copy", F.row_number().over(w)).withColumn("key", F.xxhash64(*cols, "copy"))
    t = number(T(s, d, "mb_artists"))
    files.write_csv(t.select(*cols), path)
    back = number(files.read_csv(s, path, ", ".join(f"{c} STRING" for c in cols)))
    return contracts.reconcile(t, back, ["key"], cols).select("column_name", "agree")


@query("SELECT row_id, mb_title, mb_artist, first_release_date, nullif(replace(coalesce(genres, ''), ' ', ''), '') AS genres FROM mb_songs WHERE recording_mbid IS NOT NULL AND mb_title IS NOT NULL AND mb_artist IS NOT NULL AND regexp_full_match(first_release_date, '\\d{4}-\\d{2}-\\d{2}') AND (genres IS NULL OR regexp_full_match(genres, '[a-z]+'))")
def recording_rows(s, d):
    """Responses of a recording service made into rows: credit line of names and join phrases, earliest release, genres by votes."""
    from tallyspark.sources import search

    t = T(s, d, "mb_songs").where("recording_mbid IS NOT NULL AND mb_title IS NOT NULL AND mb_artist IS NOT NULL").where(F.col("first_release_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("genres").isNull() | F.col("genres").rlike("^[a-z]+$")))
    part = F.split("mb_artist", " & ")
    credit = F.transform(part, lambda x, i: F.struct(x.alias("name"), F.when(i < F.size(part) - 1, " & ").otherwise("").alias("joinphrase"), F.struct(F.lit("a").alias("id")).alias("artist")))
    genre = F.when(F.col("genres").isNotNull(), F.array(F.struct(F.col("genres").alias("name"), F.lit(3).alias("count"))))
    late = F.struct(F.lit("2999-01-01").alias("date"), F.struct(F.lit("g2").alias("id"), F.lit("Album").alias("primary-type")).alias("release-group"))
    release = F.array(late, F.struct(F.col("first_release_date").alias("date"), F.struct(F.lit("g").alias("id"), F.lit("Single").alias("primary-type")).alias("release-group")))
    body = F.struct(F.col("recording_mbid").alias("id"), F.col("mb_title").alias("title"), credit.alias("artist-credit"), genre.alias("genres"), release.alias("releases"))
    rows = search.song_rows(t.select(F.col("row_id").cast("string").alias("query"), F.lit(0).alias("rank"), F.to_json(body).alias("response")))
    return rows.select(F.col("query").cast("long").alias("row_id"), "mb_title", "mb_artist", "first_release_date", F.nullif("genres", F.lit("")).alias("genres"))


def work_list(s, d, kind: str = "lyrics", retry: bool = False, part: tuple[int, int] | None = None) -> DataFrame:
    """(title, artist, reason): credits on the chart that a service is still to be asked for; with retry also those whose
    answer was poor. part (k, n) takes the k-th of n disjoint shares."""
    table, score, text = ("lyrics", "match_score", "plain_lyrics") if kind == "lyrics" else ("mb_songs", "match_score", "mb_title")
    done = T(s, d, table).groupBy("title", "artist").agg(F.max(score).alias("score"), F.bool_or(F.col(text).isNotNull()).alias("has"))
    w = T(s, d, "weekly").where("title IS NOT NULL AND artist IS NOT NULL").select("title", "artist").distinct().join(done.withColumn("known", F.lit(True)), ["title", "artist"], "left")
    reason = F.when(F.col("known").isNull(), "new")
    if retry:
        reason = reason.when(F.coalesce(F.col("score") < 90, F.lit(True)), "score").when(~F.col("has"), "empty")
    out = w.select("title", "artist", reason.alias("reason")).where("reason IS NOT NULL")
    return out if part is None else out.where(F.pmod(F.xxhash64("title", "artist"), F.lit(part[1])) == part[0])


def _work_sql(table: str, text: str, retry: str) -> str:
    return f"SELECT * FROM (SELECT w.title, w.artist, CASE WHEN l.title IS NULL THEN 'new' {retry} END AS reason FROM (SELECT DISTINCT title, artist FROM weekly WHERE title IS NOT NULL AND artist IS NOT NULL) w LEFT JOIN (SELECT title, artist, max(match_score) AS score, bool_or({text} IS NOT NULL) AS has FROM {table} GROUP BY ALL) l ON l.title = w.title AND l.artist = w.artist) WHERE reason IS NOT NULL"


@query(_work_sql("lyrics", "plain_lyrics", "WHEN coalesce(score < 90, true) THEN 'score' WHEN NOT has THEN 'empty'"))
def lyrics_work_list(s, d):
    """Credits to ask the lyrics service for, poor answers included."""
    return work_list(s, d, "lyrics", retry=True)


@query(_work_sql("mb_songs", "mb_title", ""))
def recordings_work_list(s, d):
    """Credits to ask the recording service for, taken together from three disjoint shares."""
    out = work_list(s, d, "recordings", part=(0, 3))
    return out.unionByName(work_list(s, d, "recordings", part=(1, 3))).unionByName(work_list(s, d, "recordings", part=(2, 3)))


@query("SELECT lyric_id, title, artist, nullif(replace(replace(plain_lyrics, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') AS plain_lyrics, match_score FROM lyrics")
def csv_scan(s, d):
    """Texts with line ends and quotes, written as CSV and read back by a declared schema; line ends made alike."""
    path = scratch(s, "csv")
    t = T(s, d, "lyrics").select("lyric_id", "title", "artist", F.regexp_replace("plain_lyrics", "\r\n?", "\n").alias("plain_lyrics"), "match_score")
    files.write_csv(t, path)
    return files.read_csv(s, path, "lyric_id BIGINT, title STRING, artist STRING, plain_lyrics STRING, match_score INT").withColumn("plain_lyrics", F.nullif("plain_lyrics", F.lit("")))


@query("SELECT title, artist, max(loaded_at) AS loaded_at, count(*) AS n FROM weekly GROUP BY 1, 2")
def append_and_resume(s, d):
    """Credits appended in two batches, the second holding only what the first did not."""
    path = scratch(s, "append")
    work = T(s, d, "weekly").groupBy("title", "artist").agg(F.max("loaded_at").alias("loaded_at"), F.count(F.lit(1)).alias("n"))
    files.append_batch(work.where(F.pmod(F.xxhash64("title"), F.lit(2)) == 0), path)
    files.append_batch(files.pending(work, s.read.parquet(path), ["title", "artist"]), path)
    return s.read.parquet(path)


@query("SELECT lyric_id, title, artist, CASE WHEN match_score < 90 THEN 100 ELSE match_score END AS match_score FROM lyrics")
def replace_in_place(s, d):
    """Rows fetched again take the place of the old ones, the table being replaced whole."""
    path = scratch(s, "lyrics")
    t = T(s, d, "lyrics").select("lyric_id", "title", "artist", "match_score")
    files.replace_table(t, path)
    now = files.read_current(s, path)
    files.replace_table(files.upsert(now, now.where("match_score < 90").withColumn("match_score", F.lit(100)), ["lyric_id"]), path)
    return files.read_current(s, path)


@query("SELECT DISTINCT title, artist, chart_date FROM weekly WHERE this_week IS NOT NULL")
def stream_append(s, d):
    """Weekly rows as they stand, repeated ones included, streamed in over several batches; each key is appended once."""
    src, out, ck = scratch(s, "landed"), scratch(s, "out"), scratch(s, "ck")
    rows = T(s, d, "weekly").where("this_week IS NOT NULL").select("title", "artist", "chart_date", F.col("chart_date").cast("timestamp").alias("at"))
    # files by month, older ones first, as a chart grows; some keys come back in the next file
    rows.repartitionByRange(6, "chart_date").sortWithinPartitions("chart_date").write.parquet(src)
    rows.where(F.pmod(F.xxhash64("title"), F.lit(7)) == 0).coalesce(1).write.mode("append").parquet(src)
    charts.append_new(charts.landed(s, src, "title STRING, artist STRING, chart_date DATE, at TIMESTAMP", 3), ["title", "artist", "chart_date"], "at", "36500 days", out, ck).awaitTermination()
    return s.read.parquet(out).select("title", "artist", "chart_date")


@query("SELECT user_id, first_ts, last_ts, n FROM (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN CAST(ts AS TIMESTAMP) - lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k)")
def stream_sessions(s, d):
    """Runs of a user's events with less than two days between them, over a stream."""
    src, out, ck = scratch(s, "events"), scratch(s, "sessions"), scratch(s, "ck")
    T(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(src)
    w = charts.landed(s, src, "user_id BIGINT, ts TIMESTAMP", 2).withWatermark("ts", "10000 days").groupBy(F.session_window("ts", "2 days"), "user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))

    def put(batch, _):
        batch.write.mode("overwrite").parquet(out)

    w.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    """Events per day and type, counted over a stream."""
    src, out, ck = scratch(s, "events"), scratch(s, "windows"), scratch(s, "ck")
    T(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(src)
    w = charts.windowed_counts(charts.landed(s, src, "ts TIMESTAMP, event_type STRING, value DOUBLE"), "ts", "1 day", "1 hour", ["event_type"], "value")

    def put(batch, _):
        batch.write.mode("overwrite").parquet(out)

    w.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT title, artist, row_id, mb_title FROM mb_songs WHERE title IS NOT NULL AND artist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1")
def stream_upsert(s, d):
    """Fetched rows streamed in over several batches; of each credit the row fetched last stays, whichever batch brought it."""
    src, table, ck = scratch(s, "rows"), scratch(s, "table"), scratch(s, "ck")
    rows = T(s, d, "mb_songs").where("title IS NOT NULL AND artist IS NOT NULL").select("title", "artist", F.struct(F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), "row_id").alias("o"), "row_id", "mb_title")
    rows.repartition(6).write.parquet(src)
    charts.keep_latest(charts.landed(s, src, "title STRING, artist STRING, o STRUCT<at: BIGINT, row_id: BIGINT>, row_id BIGINT, mb_title STRING", 2), ["title", "artist"], "o", table, ck, parts=4).awaitTermination()
    return charts.read_latest(s, table, parts=4).drop("o")
