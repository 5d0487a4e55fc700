"""Scans, filters, joins, aggregates, sets, sorts and pivots, each with SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import contracts, history
from tallyspark.session import read_table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Fixed value: the last chart that counts.
LAST_CHART = "2026-09-19"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chart(s: SparkSession, d: str) -> DataFrame:
    """Chart rows with a place, up to the last chart that counts."""
    return T(s, d, "weekly").where(F.col("this_week").isNotNull() & (F.col("chart_date") <= F.lit(LAST_CHART).cast("date")))


def credits_of(s: SparkSession, d: str) -> DataFrame:
    """One row per printed credit: first and last day, best and first place, weeks, first top-10 day."""
    w = chart(s, d)
    return w.groupBy("title", "artist").agg(
        F.min("chart_date").alias("debut_date"),
        F.max("chart_date").alias("last_date"),
        F.min("this_week").alias("peak_position"),
        F.min_by("this_week", F.struct("chart_date", "this_week")).alias("debut_position"),
        F.countDistinct("chart_date").alias("weeks_on_chart"),
        F.min(F.when(F.col("this_week") <= 10, F.col("chart_date"))).alias("first_top10_date"),
    )


CHART_SQL = f"SELECT * FROM weekly WHERE this_week IS NOT NULL AND chart_date <= DATE '{LAST_CHART}'"
CREDITS_SQL = f"""SELECT title, artist, min(chart_date) AS debut_date, max(chart_date) AS last_date, min(this_week) AS peak_position,
 arg_min(this_week, (chart_date, this_week)) AS debut_position, count(DISTINCT chart_date) AS weeks_on_chart,
 min(CASE WHEN this_week <= 10 THEN chart_date END) AS first_top10_date
 FROM ({CHART_SQL}) w GROUP BY title, artist"""


@query(CREDITS_SQL)
def credits_collapse(s, d):
    return credits_of(s, d)


@query(f"SELECT * FROM ({CREDITS_SQL}) c WHERE debut_date >= DATE '2018-01-01'")
def filter_after_agg(s, d):
    """The window of study cuts songs by their first day, after the whole history is collapsed."""
    return credits_of(s, d).where(F.col("debut_date") >= F.lit("2018-01-01").cast("date"))


@query("""SELECT band, count(*) AS n, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large, round(avg(CASE WHEN o_totalprice > 200000 THEN 100.0 ELSE 0 END), 6) AS rate FROM (
 SELECT o_totalprice, CASE WHEN k = 1 THEN '1' WHEN k <= 4 THEN '2-4' WHEN k <= 9 THEN '5-9' ELSE '10+' END AS band FROM (
 SELECT o_totalprice, count(*) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)) AS k FROM orders)) GROUP BY band""")
def debut_burst_bucket(s, d):
    """Orders banded by how many their customer placed in the month; share of large ones per band."""
    o = T(s, d, "orders").select("o_custkey", "o_totalprice", F.date_trunc("month", F.to_date("o_orderdate")).alias("m"))
    # counting per customer and month first keeps the shuffle at one row per pair
    k = o.groupBy("o_custkey", "m").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    band = F.when(F.col("k") == 1, "1").when(F.col("k") <= 4, "2-4").when(F.col("k") <= 9, "5-9").otherwise("10+")
    return k.groupBy(band.alias("band")).agg(F.sum("k").alias("n"), F.sum("large").alias("large")).withColumn("rate", F.round(100.0 * F.col("large") / F.col("n"), 6))


@query("""SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, max(value) AS peak, arg_min(value, (ts, event_id)) AS first_value, count(*) AS n FROM events GROUP BY user_id, event_type""")
def collapse_first_last_peak(s, d):
    return T(s, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("value").alias("peak"), F.min_by("value", F.struct("ts", "event_id")).alias("first_value"), F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, title AS song, artist AS act, coalesce(release_type, 'unknown') AS kind, recording_length_ms / 1000 AS seconds FROM mb_songs WHERE match_score >= 72 AND (release_type IS NULL OR release_type IN ('Single', 'Album')) AND coalesce(recording_length_ms BETWEEN 30000 AND 600000, false)")
def project_filter(s, d):
    return (
        T(s, d, "mb_songs")
        .where((F.col("match_score") >= 72) & (F.col("release_type").isNull() | F.col("release_type").isin("Single", "Album")) & F.coalesce(F.col("recording_length_ms").between(30000, 600000), F.lit(False)))
        .withColumnsRenamed({"title": "song", "artist": "act"})
        .select("row_id", "song", "act", F.coalesce("release_type", F.lit("unknown")).alias("kind"), (F.col("recording_length_ms") / 1000).alias("seconds"))
    )


@query("SELECT song_id, CASE WHEN duration_used IS NULL THEN 'none' WHEN duration_used < 150 THEN 'short' WHEN duration_used < 240 THEN 'usual' ELSE 'long' END AS size, CASE WHEN peak_position <= 10 THEN 'top 10' WHEN peak_position <= 40 THEN 'top 40' ELSE 'rest' END AS place, least(greatest(debut_position, 11), 100) AS clipped FROM songs_analysis")
def conditional_columns(s, d):
    c = F.col
    return T(s, d, "songs_analysis").select(
        "song_id",
        F.when(c("duration_used").isNull(), "none").when(c("duration_used") < 150, "short").when(c("duration_used") < 240, "usual").otherwise("long").alias("size"),
        F.when(c("peak_position") <= 10, "top 10").when(c("peak_position") <= 40, "top 40").otherwise("rest").alias("place"),
        F.least(F.greatest(c("debut_position"), F.lit(11)), F.lit(100)).alias("clipped"),
    )


@query("SELECT song_id, CASE WHEN debut_position > 0 AND debut_position <= 10 THEN '1-10' WHEN debut_position > 10 AND debut_position <= 25 THEN '11-25' WHEN debut_position > 25 AND debut_position <= 50 THEN '26-50' WHEN debut_position > 50 AND debut_position <= 75 THEN '51-75' WHEN debut_position > 75 AND debut_position <= 100 THEN '76-100' END AS band FROM songs_analysis")
def right_closed_bands(s, d):
    return T(s, d, "songs_analysis").select("song_id", tx.bands("debut_position", [0, 10, 25, 50, 75, 100], ["1-10", "11-25", "26-50", "51-75", "76-100"]).alias("band"))


@query("SELECT o.o_orderkey, c.c_name, CASE WHEN c.c_custkey IS NULL THEN 'left_only' ELSE 'both' END AS merged FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def left_join_indicator(s, d):
    """Many-to-one join whose right keys are proved unique, with where each row came from."""
    c = T(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return contracts.checked_join(T(s, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "many_to_one", "merged").select("o_orderkey", "c_name", "merged")


@query("SELECT s.song_id, s.title, l.n_fetched, l.best_score FROM songs_analysis s LEFT JOIN (SELECT title, artist, count(*) AS n_fetched, max(match_score) AS best_score FROM lyrics GROUP BY ALL) l ON s.title = l.title AND s.artist = l.artist")
def left_join_aggregate(s, d):
    l = T(s, d, "lyrics").groupBy("title", "artist").agg(F.count(F.lit(1)).alias("n_fetched"), F.max("match_score").alias("best_score"))
    return T(s, d, "songs_analysis").select("song_id", "title", "artist").join(l, ["title", "artist"], "left").select("song_id", "title", "n_fetched", "best_score")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(s, d):
    return T(s, d, "customer").join(T(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT w.title, w.artist FROM weekly w WHERE NOT EXISTS (SELECT 1 FROM lyrics l WHERE l.title = w.title AND l.artist = w.artist AND l.match_score >= 90)")
def anti_join(s, d):
    """Work list of credits that have no well-matched lyrics row yet."""
    return T(s, d, "weekly").select("title", "artist").distinct().join(T(s, d, "lyrics").where("match_score >= 90").select("title", "artist"), ["title", "artist"], "left_anti")


@query("""WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 j AS (SELECT a.k AS ak, b.k AS bk, a.qty AS aq, b.qty AS bq, a.n AS an, b.n AS bn FROM a FULL OUTER JOIN b ON a.k = b.k)
 SELECT column_name, count(*) FILTER (bk IS NULL) AS only_left, count(*) FILTER (ak IS NULL) AS only_right, count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL) AS both, count(*) FILTER (ak IS NOT NULL AND bk IS NOT NULL AND CASE column_name WHEN 'qty' THEN abs(aq - bq) <= 1e-8 + 1e-5 * abs(bq) ELSE an = bn END) AS agree
 FROM j, (VALUES ('qty'), ('n')) v(column_name) GROUP BY column_name""")
def full_outer_reconcile(s, d):
    """Column by column agreement of two tables that should match."""
    l = T(s, d, "lineitem").withColumnRenamed("l_suppkey", "k")
    agg = lambda x: x.groupBy("k").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    return contracts.reconcile(agg(l.where("l_returnflag <> 'R'")), agg(l.where("l_linestatus = 'F'")), ["k"], ["qty", "n"])


@query("SELECT n.n_nationkey, CASE n.n_name WHEN 'CHINA' THEN 'PRC' WHEN 'UNITED STATES' THEN 'USA' WHEN 'UNITED KINGDOM' THEN 'UK' ELSE n.n_name END AS n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def rename_map_update(s, d):
    m = F.create_map(*(F.lit(x) for x in ("CHINA", "PRC", "UNITED STATES", "USA", "UNITED KINGDOM", "UK")))
    n = T(s, d, "nation")
    return n.join(F.broadcast(T(s, d, "region")), n.n_regionkey == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce(m[F.col("n_name")], F.col("n_name")).alias("n_name"), "r_name")


@query("SELECT a.o_orderkey AS later_key, count(b.o_orderkey) AS earlier FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(b.o_orderdate AS DATE) < CAST(a.o_orderdate AS DATE) GROUP BY 1")
def theta_join_pairs(s, d):
    """Earlier orders of the same customer, where the day is compared by inequality: counted per customer and day and
    added up over earlier days, so that a busy customer is no square."""
    o = T(s, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    before = history.prior_by_day(o, ["o_custkey"], "day", {"earlier": F.lit(1)})
    return o.join(before, ["o_custkey", "day"]).select(F.col("o_orderkey").alias("later_key"), "earlier")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def crosstab_counts(s, d):
    return T(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS row_share, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS column_share FROM orders GROUP BY 1, 2")
def crosstab_shares(s, d):
    c = T(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    share = lambda k: F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(k)), 6)
    return c.withColumns({"row_share": share("o_orderpriority"), "column_share": share("o_orderstatus")})


@query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS \"F\", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS \"O\", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS \"P\" FROM orders GROUP BY 1")
def pivot_mean(s, d):
    return T(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("SELECT p_brand, p_type, median(p_retailprice) AS median_price, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3, count(*) AS n FROM part GROUP BY 1, 2")
def median_by_two_keys(s, d):
    """Exact quartiles, as for box plots."""
    return T(s, d, "part").groupBy("p_brand", "p_type").agg(F.median("p_retailprice").alias("median_price"), F.percentile("p_retailprice", 0.25).alias("q1"), F.percentile("p_retailprice", 0.75).alias("q3"), F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT primary_genre, quantile_cont(word_count, 0.02) AS cut, count(word_count) AS n FROM songs_analysis WHERE primary_genre IS NOT NULL GROUP BY 1), g AS (SELECT quantile_cont(word_count, 0.02) AS cut FROM songs_analysis)
 SELECT s.song_id, CASE WHEN q.n >= 30 THEN q.cut ELSE g.cut END AS cut, coalesce(s.word_count < CASE WHEN q.n >= 30 THEN q.cut ELSE g.cut END, false) AS suspect FROM songs_analysis s LEFT JOIN q USING (primary_genre), g""")
def group_quantile_flag(s, d):
    """Songs below the 2 % quantile of their own genre, or of all songs where the genre is small."""
    t = T(s, d, "songs_analysis").select("song_id", "primary_genre", "word_count")
    q = t.where("primary_genre IS NOT NULL").groupBy("primary_genre").agg(F.percentile("word_count", 0.02).alias("q"), F.count("word_count").alias("n"))
    g = t.agg(F.percentile("word_count", 0.02).alias("g"))
    cut = F.when(F.col("n") >= 30, F.col("q")).otherwise(F.col("g"))
    return t.join(F.broadcast(q), "primary_genre", "left").crossJoin(F.broadcast(g)).select("song_id", cut.alias("cut"), F.coalesce(F.col("word_count") < cut, F.lit(False)).alias("suspect"))


@query("SELECT column_name, missing, round(missing / n, 6) AS share FROM (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("title", "artist", "plain_lyrics", "instrumental", "duration", "match_score")) + " FROM lyrics) UNPIVOT INCLUDE NULLS (missing FOR column_name IN (title, artist, plain_lyrics, instrumental, duration, match_score))")
def null_profile(s, d):
    return contracts.null_profile(T(s, d, "lyrics").select("title", "artist", "plain_lyrics", "instrumental", "duration", "match_score")).withColumn("share", F.round("share", 6))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(s, d):
    return T(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(s, d):
    return T(s, d, "events").select("event_id", "event_type", F.from_json("props", "k INT")["k"].alias("k")).where("k IS NOT NULL")


@query("SELECT event_type, count(*) AS n, count(value) AS with_value, count(DISTINCT user_id) AS users, CAST(count(*) - count(DISTINCT (user_id, CAST(ts AS DATE))) AS BIGINT) AS repeats FROM events GROUP BY 1")
def counts_and_distinct(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"), F.countDistinct("user_id").alias("users"), (F.count(F.lit(1)) - F.countDistinct("user_id", F.to_date("ts"))).alias("repeats"))


@query("SELECT count(*) AS n, count(DISTINCT (chart_date, title, artist)) AS distinct_keys, (SELECT count(*) FROM (SELECT chart_date, title, artist FROM weekly GROUP BY ALL HAVING count(*) > 1)) AS repeated_keys, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT chart_date, title, artist, this_week, last_week, loaded_at FROM weekly)) AS distinct_rows FROM weekly")
def duplicate_report(s, d):
    """Whole-row and key duplicates in one pass over counted keys."""
    w = T(s, d, "weekly")
    rows = w.groupBy(*w.columns).agg(F.count(F.lit(1)).alias("k"))
    keys = rows.groupBy("chart_date", "title", "artist").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("r"))
    return keys.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("k") > 1).alias("repeated_keys"), F.sum("r").alias("distinct_rows"))


@query("SELECT release_type, count(*) AS n FROM mb_songs GROUP BY 1")
def value_counts(s, d):
    """Counts with the null group kept."""
    return T(s, d, "mb_songs").groupBy("release_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, string_agg(kind, '|' ORDER BY first_ts, kind) AS kinds FROM (SELECT user_id, event_type AS kind, min(ts) AS first_ts FROM events GROUP BY 1, 2) GROUP BY 1")
def string_aggregate(s, d):
    e = T(s, d, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.min("ts").alias("first_ts"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_ts", "kind"))), lambda x: x["kind"]), "|").alias("kinds"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n FROM orders GROUP BY 1")
def year_resample(s, d):
    return T(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT y.year, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(year(chart_date)) FROM weekly), (SELECT max(year(chart_date)) FROM weekly)))::INTEGER AS year) y LEFT JOIN (SELECT year(chart_date) AS year, count(*) AS n FROM weekly GROUP BY 1) c USING (year)")
def year_gaps_filled(s, d):
    """Every calendar year in the range, with zero where it has no row."""
    c = T(s, d, "weekly").groupBy(F.year("chart_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    y = c.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    return y.join(c, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_mktsegment, n, total, round(100.0 * n / (SELECT count(*) FROM customer), 6) AS share FROM (SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1)")
def share_of_total(s, d):
    c = T(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("all"))), how="cross").select("c_mktsegment", "n", "total", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("share"))


@query("(SELECT 'largest' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) UNION ALL (SELECT 'smallest' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)")
def top_and_bottom(s, d):
    c = T(s, d, "customer").select("c_custkey", "c_acctbal")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select(F.lit("largest").alias("side"), "*")
    return top.unionByName(c.orderBy("c_acctbal", "c_custkey").limit(10).select(F.lit("smallest").alias("side"), "*"))


@query("SELECT k.band, coalesce(n, 0) AS n FROM (VALUES ('1'), ('2-4'), ('5-9'), ('10+'), ('none')) k(band) LEFT JOIN (SELECT CASE WHEN weeks_on_chart = 1 THEN '1' WHEN weeks_on_chart <= 4 THEN '2-4' WHEN weeks_on_chart <= 9 THEN '5-9' ELSE '10+' END AS band, count(*) AS n FROM songs_analysis WHERE weeks_on_chart IS NOT NULL GROUP BY 1) c USING (band)")
def fixed_order_groups(s, d):
    """A fixed list of groups, those without rows included."""
    w = F.col("weeks_on_chart")
    c = T(s, d, "songs_analysis").where(w.isNotNull()).groupBy(F.when(w == 1, "1").when(w <= 4, "2-4").when(w <= 9, "5-9").otherwise("10+").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    k = s.createDataFrame([(x,) for x in ("1", "2-4", "5-9", "10+", "none")], "band string")
    return k.join(c, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT DISTINCT title FROM mb_songs INTERSECT SELECT DISTINCT title FROM lyrics")
def set_intersect(s, d):
    return T(s, d, "mb_songs").select("title").intersect(T(s, d, "lyrics").select("title"))


@query("SELECT title, artist FROM songs_analysis EXCEPT SELECT mb_title, mb_artist FROM mb_songs")
def set_except(s, d):
    return T(s, d, "songs_analysis").select("title", "artist").subtract(T(s, d, "mb_songs").select(F.col("mb_title").alias("title"), F.col("mb_artist").alias("artist")))


@query("SELECT source_table, count(*) AS n, count(DISTINCT title) AS titles FROM (SELECT 'mb_songs' AS source_table, title FROM mb_songs UNION ALL SELECT 'lyrics', title FROM lyrics UNION ALL SELECT 'songs_analysis', title FROM songs_analysis) GROUP BY 1")
def union_all(s, d):
    one = [T(s, d, t).select(F.lit(t).alias("source_table"), "title") for t in ("mb_songs", "lyrics", "songs_analysis")]
    return one[0].unionByName(one[1]).unionByName(one[2]).groupBy("source_table").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"))


@query("SELECT song_id, measure, value FROM (SELECT song_id, CAST(word_count AS DOUBLE) AS word_count, unique_word_ratio, repetition_score FROM songs_analysis) UNPIVOT (value FOR measure IN (word_count, unique_word_ratio, repetition_score))")
def unpivot_measures(s, d):
    t = T(s, d, "songs_analysis").select("song_id", F.col("word_count").cast("double").alias("word_count"), "unique_word_ratio", "repetition_score")
    return t.unpivot("song_id", ["word_count", "unique_word_ratio", "repetition_score"], "measure", "value").where("value IS NOT NULL")


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.9) AS q90, max(o_totalprice) AS max FROM orders")
def describe(s, d):
    c = F.col("o_totalprice")
    return T(s, d, "orders").agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.5).alias("q50"), F.percentile(c, 0.9).alias("q90"), F.max(c).alias("max"))


@query()
def seeded_sample(s, d):
    """A sample of 200 without replacement that is the same on any cluster: the least hashes of the key."""
    return T(s, d, "songs_analysis").select("song_id", "title").orderBy(F.xxhash64("song_id", F.lit(42)), "song_id").limit(200)


@query("SELECT row_id, first_release_date, CASE WHEN regexp_full_match(first_release_date, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(first_release_date AS DATE) END AS released, TRY_CAST(substr(first_release_date, 1, 4) AS INTEGER) AS release_year FROM mb_songs")
def partial_dates(s, d):
    return T(s, d, "mb_songs").select("row_id", "first_release_date", tx.full_date("first_release_date").alias("released"), F.substring("first_release_date", 1, 4).try_cast("int").alias("release_year"))


@query("SELECT season, title, artist, count(*) AS weeks FROM (SELECT title, artist, CASE month(chart_date) WHEN 12 THEN year(chart_date) WHEN 1 THEN year(chart_date) - 1 END::INTEGER AS season FROM weekly) WHERE season IS NOT NULL GROUP BY 1, 2, 3")
def season_weeks(s, d):
    return T(s, d, "weekly").select("title", "artist", tx.season_year("chart_date").alias("season")).where("season IS NOT NULL").groupBy("season", "title", "artist").agg(F.count(F.lit(1)).alias("weeks"))


@query("""SELECT title, artist, count(*) AS weeks, count(season) AS season_weeks, count(DISTINCT season) AS seasons, round(count(season) / count(*), 6) AS share, (count(season) / count(*) >= 0.7 AND count(DISTINCT season) >= 2) OR (regexp_matches(title, '(?i)\\b(christmas|xmas|santa|holiday|jingle|sleigh|rudolph|frosty|mistletoe|noel|navidad|auld lang syne|winter wonderland|silent night|drummer boy|deck the halls|let it snow|snowman|hanukkah|new year|grinch|scrooge|wonderful time)\\b') AND count(season) > 0) AS is_holiday
 FROM (SELECT title, artist, CASE month(chart_date) WHEN 12 THEN year(chart_date) WHEN 1 THEN year(chart_date) - 1 END AS season FROM weekly) GROUP BY title, artist""")
def season_fold(s, d):
    """Share of a credit's weeks in December and January, and in how many winters."""
    w = T(s, d, "weekly").select("title", "artist", tx.season_year("chart_date").alias("season"))
    g = w.groupBy("title", "artist").agg(F.count(F.lit(1)).alias("weeks"), F.count("season").alias("season_weeks"), F.countDistinct("season").alias("seasons"))
    share = F.col("season_weeks") / F.col("weeks")
    return g.select("*", F.round(share, 6).alias("share"), (((share >= 0.7) & (F.col("seasons") >= 2)) | (tx.holiday_title("title") & (F.col("season_weeks") > 0))).alias("is_holiday"))
