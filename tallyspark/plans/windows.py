"""Window operators, each with SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import history, stats
from tallyspark.session import read_table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(s, d):
    return T(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))


@query("SELECT a.o_orderkey, count(b.o_orderkey) AS prior_entries, count(b.o_orderkey) FILTER (b.o_totalprice > 200000) AS prior_large, max(CAST(b.o_orderdate AS DATE)) AS last_day FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(b.o_orderdate AS DATE) < CAST(a.o_orderdate AS DATE) GROUP BY 1")
def strict_prior_counts(s, d):
    """Orders, large orders and the last day strictly before each order's day."""
    o = history.strict_prior(_orders(s, d), ["o_custkey"], "day", {"prior_entries": F.count(F.lit(1)), "prior_large": F.count_if(F.col("o_totalprice") > 200000), "last_day": F.max("day")})
    return o.select("o_orderkey", F.coalesce("prior_entries", F.lit(0)).alias("prior_entries"), F.coalesce("prior_large", F.lit(0)).alias("prior_large"), "last_day")


@query("SELECT artist, chart_date, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_rows, CAST(coalesce(sum(t) OVER w, 0) AS BIGINT) AS prior_top10 FROM (SELECT artist, chart_date, count(*) AS n, count(*) FILTER (this_week <= 10) AS t FROM weekly GROUP BY 1, 2) WINDOW w AS (PARTITION BY artist ORDER BY chart_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prior_by_day(s, d):
    """The same for a key that holds a large part of all rows: added up per day before any sort."""
    return history.prior_by_day(T(s, d, "weekly"), ["artist"], "chart_date", {"prior_rows": F.lit(1), "prior_top10": F.coalesce((F.col("this_week") <= 10).cast("int"), F.lit(0))})


@query("""WITH v AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events WHERE event_type = 'view' GROUP BY 1)
 SELECT v.user_id, v.day, count(p.user_id) AS known FROM v LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.day < v.day GROUP BY 1, 2""")
def known_at_debut(s, d):
    """Purchases known on the day of a user's first view."""
    e = T(s, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    debut = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("day").alias("day"))
    return history.known_events(debut, e.where("event_type = 'purchase'").select("user_id", "day"), ["user_id"], "day", "known").select("user_id", "day", "known")


@query("SELECT o_orderkey, CAST(floor(date_diff('day', max(day) OVER w, day) / 7) AS INTEGER) AS weeks_since_last, max(day) OVER w IS NULL AS is_first FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def weeks_since_last(s, d):
    o = history.strict_prior(_orders(s, d), ["o_custkey"], "day", {"last": F.max("day")})
    return o.select("o_orderkey", F.floor(F.datediff("day", "last") / 7).cast("int").alias("weeks_since_last"), F.col("last").isNull().alias("is_first"))


@query("""SELECT user_id, island, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM (SELECT user_id, day, CAST(sum(CASE WHEN prev IS NULL OR date_diff('day', prev, day) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
 FROM (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'))) GROUP BY 1, 2""")
def gaps_and_islands(s, d):
    """Runs of days with a purchase, where more than two days without end a run."""
    e = T(s, d, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")).distinct()
    return history.islands(e, ["user_id"], "day", 2).groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("SELECT title, artist, min(this_week) AS peak, min(chart_date) FILTER (this_week = p) AS peak_date FROM (SELECT *, min(this_week) OVER (PARTITION BY title, artist) AS p FROM weekly WHERE this_week IS NOT NULL) GROUP BY 1, 2")
def peak_row(s, d):
    """First day at a credit's best place."""
    return T(s, d, "weekly").where("this_week IS NOT NULL").groupBy("title", "artist").agg(F.min("this_week").alias("peak"), F.min_by("chart_date", F.struct("this_week", "chart_date")).alias("peak_date"))


@query("SELECT row_id, title, artist, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY title, artist ORDER BY fetched_at DESC NULLS LAST, row_id) AS r FROM mb_songs) WHERE r = 1")
def first_per_key(s, d):
    """The latest fetch of every credit."""
    w = Window.partitionBy("title", "artist").orderBy(F.desc_nulls_last("fetched_at"), "row_id")
    return T(s, d, "mb_songs").withColumn("r", F.row_number().over(w)).where("r = 1").select("row_id", "title", "artist", "fetched_at")


@query("SELECT row_id, count(*) OVER (PARTITION BY title, artist) > 1 AS repeated, CAST(row_number() OVER (PARTITION BY title, artist ORDER BY row_id) - 1 AS INTEGER) AS nth FROM mb_songs")
def key_repeats(s, d):
    k = Window.partitionBy("title", "artist")
    return T(s, d, "mb_songs").select("row_id", (F.count(F.lit(1)).over(k) > 1).alias("repeated"), (F.row_number().over(k.orderBy("row_id")) - 1).alias("nth"))


@query("SELECT o_custkey, n, rank_no, round(CAST(sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER (), 9) AS running_share FROM (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank_no FROM orders GROUP BY 1)")
def cumulative_share_topk(s, d):
    """Customers from the busiest on, with the share of all orders that they and those before them hold."""
    c = T(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("one"))
    r = stats.running_sum(c, [F.desc("n"), F.col("o_custkey")], {"upto": "n", "rank_no": "one"})
    return r.join(F.broadcast(c.agg(F.sum("n").alias("total"))), how="cross").select("o_custkey", "n", "rank_no", F.round(F.col("upto") / F.col("total"), 9).alias("running_share"))


@query("SELECT song_id, CAST(count(*) OVER (PARTITION BY primary_artist, first_chart_date) AS BIGINT) AS same_week, n_genres FROM songs_analysis LEFT JOIN (SELECT primary_artist, count(DISTINCT primary_genre) AS n_genres FROM songs_analysis GROUP BY 1) USING (primary_artist) WHERE primary_artist IS NOT NULL")
def partition_sizes(s, d):
    """Debuts by the same act in the same week, and the act's number of genres, on every row."""
    t = T(s, d, "songs_analysis").where("primary_artist IS NOT NULL").select("song_id", "primary_artist", "first_chart_date", "primary_genre")
    same = t.groupBy("primary_artist", "first_chart_date").agg(F.count(F.lit(1)).alias("same_week"))
    g = t.groupBy("primary_artist").agg(F.countDistinct("primary_genre").alias("n_genres"))
    x, y = t.alias("x"), same.alias("y")
    both = (F.col("x.primary_artist") == F.col("y.primary_artist")) & F.col("x.first_chart_date").eqNullSafe(F.col("y.first_chart_date"))
    return x.join(y, both).select("song_id", "x.primary_artist", "same_week").join(g, "primary_artist").select("song_id", "same_week", "n_genres")


@query("SELECT vec_id, label, CAST(rank() OVER (PARTITION BY label ORDER BY round(x, 3)) AS DOUBLE) + (count(*) OVER (PARTITION BY label, round(x, 3)) - 1) / 2 AS mid_rank FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def mid_ranks(s, d):
    """Mid-ranks within labels: values are counted first, then a running count over all labels starts anew at each label."""
    t = T(s, d, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 3).alias("x"))
    c = t.groupBy("label", "x").agg(F.count(F.lit(1)).alias("k"))
    r = stats.running_sum(c, ["label", "x"], {"upto": "k"})
    start = r.groupBy("label").agg(F.min(F.col("upto") - F.col("k")).alias("start"))
    r = r.join(start, "label").select("label", "x", (F.col("upto") - F.col("start") - F.col("k") + 1 + (F.col("k") - 1) / 2).alias("mid_rank"))
    a, b = t.alias("a"), r.alias("b")
    return a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")) & F.col("a.x").eqNullSafe(F.col("b.x"))).select("vec_id", "a.label", "mid_rank")


@query("SELECT song_id, quantile_cont(unique_word_ratio, 0.02) OVER (PARTITION BY primary_genre) AS cut FROM songs_analysis WHERE primary_genre IS NOT NULL")
def partition_quantile(s, d):
    """A group's quantile on every row: aggregated once and joined, not gathered per row."""
    t = T(s, d, "songs_analysis").where("primary_genre IS NOT NULL").select("song_id", "primary_genre", "unique_word_ratio")
    return t.join(F.broadcast(t.groupBy("primary_genre").agg(F.percentile("unique_word_ratio", 0.02).alias("cut"))), "primary_genre").select("song_id", "cut")


@query("SELECT l_orderkey, l_linenumber, l_partkey, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS previous, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS running FROM lineitem")
def lag_and_running(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lag("l_quantity").over(w).alias("previous"), F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
