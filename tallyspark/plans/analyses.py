"""Features of songs and the study's questions, over the chart tables.

Every predictor uses only what was known in a song's first week: history counts look at strictly
earlier days, and the split into training and test rows follows time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import history, stats
from tallyspark.plans.relational import CREDITS_SQL, credits_of
from tallyspark.plans.texts import CREDIT_SQL
from tallyspark.session import cut, read_table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# songs_analysis with a hit mark and the bands of the study; in SQL the same as a view
_SONGS = """SELECT *, coalesce(top10, false) AS hit, year(first_chart_date)::INTEGER AS debut_year,
 CASE WHEN prior_entries = 0 THEN '0' WHEN prior_entries <= 2 THEN '1-2' WHEN prior_entries <= 5 THEN '3-5' WHEN prior_entries <= 10 THEN '6-10' WHEN prior_entries > 10 THEN '11+' END AS entries_band,
 CASE WHEN debut_position BETWEEN 11 AND 25 THEN '11-25' WHEN debut_position BETWEEN 26 AND 50 THEN '26-50' WHEN debut_position BETWEEN 51 AND 75 THEN '51-75' WHEN debut_position BETWEEN 76 AND 100 THEN '76-100' END AS debut_band FROM songs_analysis"""


def songs(s, d) -> DataFrame:
    p, q = F.col("prior_entries"), F.col("debut_position")
    return T(s, d, "songs_analysis").withColumns(
        {
            "hit": F.coalesce("top10", F.lit(False)),
            "debut_year": F.year("first_chart_date"),
            "entries_band": F.when(p == 0, "0").when(p <= 2, "1-2").when(p <= 5, "3-5").when(p <= 10, "6-10").when(p > 10, "11+"),
            "debut_band": F.when(q.between(11, 25), "11-25").when(q.between(26, 50), "26-50").when(q.between(51, 75), "51-75").when(q.between(76, 100), "76-100"),
        }
    )


def _rates_sql(by: str, where: str = "true", src: str = _SONGS) -> str:
    return f"SELECT {by}, count(*) AS n, count(*) FILTER (hit) AS hits, round(100.0 * count(*) FILTER (hit) / count(*), 6) AS rate FROM ({src}) x WHERE {' AND '.join(c + ' IS NOT NULL' for c in by.split(', '))} AND {where} GROUP BY {by}"


def _rates(df: DataFrame, *by: str) -> DataFrame:
    return stats.rate_table(df, by, "hit").withColumn("rate", F.round("rate", 6))


def _chi_sql(a: str, b: str, where: str = "true", strata: str = "", src: str = _SONGS) -> str:
    """Statistic, degrees of freedom and effect size, each stratum by itself."""
    g = f"{strata}, " if strata else ""
    on = f"USING ({strata})" if strata else "ON true"
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""WITH cell AS (SELECT {g}{a} AS a, {b} AS b, count(*) AS o FROM ({src}) x WHERE {where} AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
 ra AS (SELECT {g}a, sum(o) AS ra FROM cell GROUP BY ALL), rb AS (SELECT {g}b, sum(o) AS rb FROM cell GROUP BY ALL), t AS (SELECT {g}sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM cell {('GROUP BY ' + strata) if strata else ''}),
 e AS (SELECT {('ra.' + strata + ', ') if strata else ''}n, r, c, coalesce(o, 0) AS o, ra * rb / n::DOUBLE AS e FROM ra JOIN rb {on} JOIN t {on} LEFT JOIN cell ON cell.a = ra.a AND cell.b = rb.b {('AND cell.' + strata + ' = ra.' + strata) if strata else ''})
 SELECT {g}CAST(n AS BIGINT) AS n, CASE WHEN (r-1)*(c-1) > 0 THEN round(x, 6) END AS chi2, ((r-1)*(c-1))::INTEGER AS dof, CASE WHEN (r-1)*(c-1) > 0 THEN round(sqrt(x / (n * (least(r, c) - 1))), 6) END AS cramers_v FROM (SELECT {g}n, r, c, sum(power(abs(o - e) - CASE WHEN r = 2 AND c = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS x FROM e GROUP BY ALL)"""


def _chi(df: DataFrame, a: str, b: str = "hit", strata: tuple[str, ...] = ()) -> DataFrame:
    return stats.chi_square(df, a, b, strata).select(*strata, "n", F.round("chi2", 6).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"))


# --- features from the chart itself -------------------------------------------------------------
_CREDITS = f"SELECT *, trim(string_split({CREDIT_SQL}, '|')[1]) AS lead FROM ({CREDITS_SQL}) c WHERE artist IS NOT NULL"


def credits_with_lead(s, d) -> DataFrame:
    """Collapsed credits with their lead act."""
    return credits_of(s, d).where("artist IS NOT NULL").withColumn("lead", tx.lead_artist("artist"))


_NAMED = f"SELECT DISTINCT title, artist, debut_date, first_top10_date, peak_position, trim(unnest(string_split({CREDIT_SQL}, '|'))) AS name FROM ({CREDITS_SQL}) c WHERE artist IS NOT NULL"
_HISTORY = f"""WITH c AS ({_CREDITS}), e AS (SELECT * FROM ({_NAMED}) WHERE name <> ''),
 h AS (SELECT a.title, a.artist, count(*) FILTER (b.debut_date < a.debut_date) AS prior_entries, count(*) FILTER (b.first_top10_date < a.debut_date) AS prior_top10s, count(*) FILTER (b.debut_date < a.debut_date AND b.first_top10_date IS NOT NULL) AS eventual_top10s,
 count(*) FILTER (b.debut_date < a.debut_date AND b.peak_position = 1) AS prior_number1s, CAST(floor(date_diff('day', max(b.debut_date) FILTER (b.debut_date < a.debut_date), a.debut_date) / 7) AS INTEGER) AS weeks_since_last FROM c a LEFT JOIN e b ON a.lead = b.name GROUP BY a.title, a.artist, a.debut_date),
 n AS (SELECT a.title, a.artist, a.name, count(*) FILTER (b.debut_date < a.debut_date AND b.first_top10_date IS NOT NULL) AS t FROM e a JOIN e b ON a.name = b.name GROUP BY ALL), best AS (SELECT title, artist, max(t) AS best_prior_top10s FROM n GROUP BY ALL)
 SELECT h.*, coalesce(best_prior_top10s, 0) AS best_prior_top10s, coalesce(best_prior_top10s, 0) > eventual_top10s AS guest_bigger FROM h LEFT JOIN best USING (title, artist)"""


@query(_HISTORY)
def artist_history(s, d):
    """Earlier songs and hits of the lead act, in whichever place they were credited, as known on the day of the
    debut, weeks since the last, and whether someone else on the credit had more hits."""
    c = credits_with_lead(s, d)
    named = cut(c.select("title", "artist", F.col("debut_date").alias("day"), "first_top10_date", "peak_position", F.explode(F.array_distinct(tx.split_credit("artist"))).alias("name")).where("name <> ''"))
    debuts = named.groupBy("name", "day").agg(F.count(F.lit(1)).alias("k"), F.count("first_top10_date").alias("ever"), F.count_if(F.col("peak_position") == 1).alias("n1"), F.lit(0).cast("long").alias("hit"))
    hits = named.where("first_top10_date IS NOT NULL").groupBy("name", F.col("first_top10_date").alias("day")).agg(F.count(F.lit(1)).alias("hit"))
    none = F.lit(0).cast("long")
    both = debuts.unionByName(hits.select("name", "day", none.alias("k"), none.alias("ever"), none.alias("n1"), "hit")).groupBy("name", "day").agg(*(F.sum(x).alias(x) for x in ("k", "ever", "n1", "hit")))
    w = history.earlier(["name"], "day")
    before = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    h = cut(both.select("name", "day", before("k").alias("prior_entries"), before("hit").alias("prior_top10s"), before("ever").alias("eventual_top10s"), before("n1").alias("prior_number1s"), F.max(F.when(F.col("k") > 0, F.col("day"))).over(w).alias("last_day")))
    best = named.select("title", "artist", "name", "day").join(h, ["name", "day"]).groupBy("title", "artist").agg(F.max("eventual_top10s").alias("best_prior_top10s"))
    lead = c.select("title", "artist", F.col("lead").alias("name"), F.col("debut_date").alias("day")).join(h, ["name", "day"], "left").join(best, ["title", "artist"], "left")
    n = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    out = lead.select("title", "artist", n("prior_entries"), n("prior_top10s"), n("eventual_top10s"), n("prior_number1s"), F.floor(F.datediff("day", "last_day") / 7).cast("int").alias("weeks_since_last"), n("best_prior_top10s"))
    return out.withColumn("guest_bigger", F.col("best_prior_top10s") > F.col("eventual_top10s"))


@query(f"SELECT count(*) FILTER (prior_entries > 0 AND weeks_since_last < 0) AS negative_gaps, count(*) FILTER (prior_top10s > eventual_top10s) AS known_beyond_eventual, count(*) FILTER (prior_entries = 0 AND eventual_top10s > 0) AS hits_without_entries FROM ({SQL['artist_history']})")
def leak_checks(s, d):
    """Counts of rows that would break the rule that nothing later is known; all must be 0."""
    h = artist_history(s, d)
    return h.agg(F.count_if((F.col("prior_entries") > 0) & (F.col("weeks_since_last") < 0)).alias("negative_gaps"), F.count_if(F.col("prior_top10s") > F.col("eventual_top10s")).alias("known_beyond_eventual"), F.count_if((F.col("prior_entries") == 0) & (F.col("eventual_top10s") > 0)).alias("hits_without_entries"))


@query(f"SELECT title, artist, debut_date, k AS same_week_debuts, CASE WHEN k = 1 THEN '1' WHEN k <= 4 THEN '2-4' WHEN k <= 9 THEN '5-9' ELSE '10+' END AS drop_band FROM (SELECT *, count(*) OVER (PARTITION BY lead, debut_date) AS k FROM ({_CREDITS}))")
def drop_size(s, d):
    """How many songs the lead act put on the chart in the same week."""
    c = credits_with_lead(s, d)
    k = c.groupBy("lead", "debut_date").agg(F.count(F.lit(1)).alias("same_week_debuts"))
    band = F.when(F.col("same_week_debuts") == 1, "1").when(F.col("same_week_debuts") <= 4, "2-4").when(F.col("same_week_debuts") <= 9, "5-9").otherwise("10+")
    return c.join(k, ["lead", "debut_date"]).select("title", "artist", "debut_date", "same_week_debuts", band.alias("drop_band"))


@query(f"SELECT title, artist, last_date >= (SELECT max(chart_date) FROM weekly) AS still_charting, CASE WHEN last_date >= (SELECT max(chart_date) FROM weekly) THEN 'excluded' WHEN year(debut_date) <= 2024 THEN 'train' ELSE 'test' END AS split FROM ({CREDITS_SQL})")
def temporal_split(s, d):
    """Rows by time: songs still on the last chart have no final outcome."""
    c = credits_of(s, d)
    last = T(s, d, "weekly").agg(F.max("chart_date").alias("m"))
    on = F.col("last_date") >= F.col("m")
    return c.join(F.broadcast(last), how="cross").select("title", "artist", on.alias("still_charting"), F.when(on, "excluded").when(F.year("debut_date") <= 2024, "train").otherwise("test").alias("split"))


@query(f"SELECT m.row_id, date_diff('day', CASE WHEN regexp_full_match(m.first_release_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(m.first_release_date AS DATE) END, c.debut_date) AS days_to_chart, month(c.debut_date)::INTEGER AS debut_month FROM mb_songs m JOIN ({CREDITS_SQL}) c ON m.title = c.title AND m.artist = c.artist")
def days_to_chart(s, d):
    """Days from a full release date to the first chart; negative where the chart came first."""
    c = credits_of(s, d).select("title", "artist", "debut_date")
    return T(s, d, "mb_songs").join(c, ["title", "artist"]).select("row_id", F.datediff("debut_date", tx.full_date("first_release_date")).cast("long").alias("days_to_chart"), F.month("debut_date").alias("debut_month"))


@query(f"""WITH p AS (SELECT title, artist, arg_min(chart_date, (this_week, chart_date)) AS peak_date FROM weekly WHERE this_week IS NOT NULL GROUP BY 1, 2) SELECT c.title, c.artist, CAST(floor(date_diff('day', c.debut_date, p.peak_date) / 7) AS INTEGER) AS weeks_to_peak, p.peak_date = c.debut_date AS debut_at_peak, CASE WHEN year(c.debut_date) <= 2021 THEN 'early' ELSE 'late' END AS era FROM ({CREDITS_SQL}) c JOIN p USING (title, artist)""")
def weeks_to_peak(s, d):
    p = T(s, d, "weekly").where("this_week IS NOT NULL").groupBy("title", "artist").agg(F.min_by("chart_date", F.struct("this_week", "chart_date")).alias("peak_date"))
    return credits_of(s, d).join(p, ["title", "artist"]).select("title", "artist", F.floor(F.datediff("peak_date", "debut_date") / 7).cast("int").alias("weeks_to_peak"), (F.col("peak_date") == F.col("debut_date")).alias("debut_at_peak"), F.when(F.year("debut_date") <= 2021, "early").otherwise("late").alias("era"))


@query(f"SELECT week_no, era, median(this_week) AS median_position, count(*) AS n FROM (SELECT w.this_week, CAST(floor(date_diff('day', c.debut_date, w.chart_date) / 7) AS INTEGER) AS week_no, CASE WHEN year(c.debut_date) <= 2021 THEN 'early' ELSE 'late' END AS era FROM weekly w JOIN ({CREDITS_SQL}) c USING (title, artist) WHERE c.first_top10_date IS NOT NULL AND w.this_week IS NOT NULL) WHERE week_no BETWEEN 0 AND 20 GROUP BY 1, 2")
def median_path(s, d):
    """Median place of hits by week since the debut and era."""
    c = credits_of(s, d).where("first_top10_date IS NOT NULL").select("title", "artist", "debut_date")
    w = T(s, d, "weekly").where("this_week IS NOT NULL").join(c, ["title", "artist"]).select("this_week", F.floor(F.datediff("chart_date", "debut_date") / 7).cast("int").alias("week_no"), F.when(F.year("debut_date") <= 2021, "early").otherwise("late").alias("era"))
    return w.where(F.col("week_no").between(0, 20)).groupBy("week_no", "era").agg(F.median("this_week").alias("median_position"), F.count(F.lit(1)).alias("n"))


@query("SELECT artist, chart_date, count(*) AS n FROM (SELECT title, artist, min(chart_date) AS chart_date FROM weekly GROUP BY 1, 2) GROUP BY 1, 2 ORDER BY n DESC, artist, chart_date LIMIT 10")
def biggest_drops(s, d):
    """The ten largest weeks of debuts by one credit."""
    c = T(s, d, "weekly").groupBy("title", "artist").agg(F.min("chart_date").alias("chart_date"))
    return c.groupBy("artist", "chart_date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "artist", "chart_date").limit(10)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1000000 AS b FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND user_id IS NOT NULL), n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
 r(u, c) AS (SELECT u, u FROM n UNION SELECT n.v, r.c FROM r JOIN n ON n.u = r.u) SELECT u AS id, min(c) AS component FROM r GROUP BY 1""")
def components(s, d):
    """Users that share a key, directly or through others."""
    from tallyspark.operators.components import connected_components

    e = T(s, d, "events").select(F.col("user_id").alias("a"), (F.get_json_object("props", "$.k").cast("long") + 1000000).alias("b"))
    return connected_components(e)


# --- rates and tests over finished songs --------------------------------------------------------
for _name, _by, _where, _doc in (
    ("rate_by_debut_year", "debut_year", "true", "Songs and share of hits by year of debut."),
    ("rate_by_genre", "primary_genre", "model_split = 'train'", "Share of hits by genre."),
    ("rate_by_entries_band", "entries_band", "model_split = 'train'", "Share of hits by the act's earlier entries."),
    ("rate_by_debut_month", "debut_month", "model_split = 'train'", "Share of hits by month of debut."),
    ("rate_by_feature", "has_feature", "model_split = 'train'", "Share of hits with and without a featured act."),
    ("rate_by_debut_band", "debut_band", "debut_position > 10 AND model_split = 'train'", "Share of later hits by first place, songs that start in the top 10 left out."),
    ("rate_by_split", "model_split", "true", "Share of hits in training and test rows."),
    ("rate_by_genre_and_entries", "primary_genre, entries_band", "model_split = 'train'", "Share of hits by genre and earlier entries."),
):

    def _f(s, d, by=_by, where=_where):
        return _rates(songs(s, d).where(where), *by.split(", "))

    _f.__name__, _f.__doc__ = _name, _doc
    QUERIES[_name], SQL[_name] = _f, _rates_sql(_by, _where)

for _name, _a, _where, _strata, _doc in (
    ("chi_square_rxc", "primary_genre", "model_split = 'train'", "", "Genre against hits."),
    ("chi_square_2x2", "has_feature", "model_split = 'train'", "", "Feature against hits: a 2x2 table, with the continuity correction."),
    ("chi_square_month", "debut_month", "model_split = 'train'", "", "Month of debut against hits."),
    ("chi_square_entries", "entries_band", "model_split = 'train'", "", "Earlier entries against hits."),
    ("stratified_chi_square", "has_feature", "primary_genre IS NOT NULL AND model_split = 'train'", "primary_genre", "Feature against hits inside each genre."),
):

    def _g(s, d, a=_a, where=_where, strata=_strata):
        return _chi(songs(s, d).where(where), a, "hit", (strata,) if strata else ())

    _g.__name__, _g.__doc__ = _name, _doc
    QUERIES[_name], SQL[_name] = _g, _chi_sql(_a, "hit", _where, _strata)


@query()
def chi_square_p(s, d):
    """The tests above with p-values."""
    t = songs(s, d).where("model_split = 'train'")
    out = None
    for a in ("primary_genre", "has_feature", "debut_month", "entries_band"):
        x = stats.with_p(stats.chi_square(t, a, "hit")).withColumn("question", F.lit(a))
        out = x if out is None else out.unionByName(x)
    return out


_MW = [(c, f"SELECT '{c}' AS measure, CAST({c} AS DOUBLE) AS v, hit AS g FROM ({_SONGS}) x WHERE {c} IS NOT NULL AND model_split = 'train'") for c in ("unique_word_ratio", "repetition_score", "avg_line_length", "word_count")]


@query(
    "WITH x AS (" + " UNION ALL ".join(q for _, q in _MW) + """), r AS (SELECT *, rank() OVER (PARTITION BY measure ORDER BY v) + (count(*) OVER (PARTITION BY measure, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY measure, v) AS t FROM x),
 a AS (SELECT measure, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, median(v) FILTER (g) AS median1, median(v) FILTER (NOT g) AS median2, sum(rk) FILTER (g) AS r1, sum(t * t - 1) AS ties FROM r GROUP BY 1),
 b AS (SELECT *, CAST(n1 AS DOUBLE) AS d1, CAST(n2 AS DOUBLE) AS d2, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u FROM a)
 SELECT measure, n1, n2, round(median1, 9) AS median1, round(median2, 9) AS median2, round(CAST(u AS DOUBLE), 4) AS u, round(greatest(abs(u - d1 * d2 / 2) - 0.5, 0) / sqrt(d1 * d2 / 12 * ((d1 + d2 + 1) - ties / ((d1 + d2) * (d1 + d2 - 1)))), 6) AS z, round(2 * u / (d1 * d2) - 1, 6) AS rank_biserial FROM b"""
)
def mann_whitney_u(s, d):
    """Lyric measures of hits against the rest."""
    t = songs(s, d).where("model_split = 'train'")
    out = None
    for c, _ in _MW:
        x = stats.mann_whitney(t, c, "hit").select(F.lit(c).alias("measure"), "n1", "n2", F.round("median1", 9).alias("median1"), F.round("median2", 9).alias("median2"), F.round("u", 4).alias("u"), F.round("z", 6).alias("z"), F.round("rank_biserial", 6).alias("rank_biserial"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"SELECT primary_artist, hits, rank_no, round(CAST(sum(hits) OVER (ORDER BY hits DESC, primary_artist ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(hits) OVER (), 9) AS running_share FROM (SELECT primary_artist, count(*) AS hits, row_number() OVER (ORDER BY count(*) DESC, primary_artist) AS rank_no FROM ({_SONGS}) x WHERE hit AND primary_artist IS NOT NULL GROUP BY 1)")
def hit_concentration(s, d):
    """Which share of all hits the top acts hold."""
    c = songs(s, d).where("hit AND primary_artist IS NOT NULL").groupBy("primary_artist").agg(F.count(F.lit(1)).alias("hits"), F.lit(1).cast("long").alias("one"))
    r = stats.running_sum(c, [F.desc("hits"), F.col("primary_artist")], {"upto": "hits", "rank_no": "one"})
    return r.join(F.broadcast(c.agg(F.sum("hits").alias("total"))), how="cross").select("primary_artist", "hits", "rank_no", F.round(F.col("upto") / F.col("total"), 9).alias("running_share"))


@query(f"SELECT debut_year, median(duration_used) FILTER (hit) AS hit_median, median(duration_used) FILTER (NOT hit) AS other_median, round(100 * (median(duration_used) FILTER (hit) / median(duration_used) FILTER (NOT hit) - 1), 6) AS difference FROM ({_SONGS}) x WHERE duration_used IS NOT NULL AND debut_year IS NOT NULL GROUP BY 1")
def length_by_year(s, d):
    t = songs(s, d).where("duration_used IS NOT NULL AND debut_year IS NOT NULL")
    g = t.groupBy("debut_year").agg(F.median(F.when(F.col("hit"), F.col("duration_used"))).alias("hit_median"), F.median(F.when(~F.col("hit"), F.col("duration_used"))).alias("other_median"))
    return g.withColumn("difference", F.round(100 * (F.col("hit_median") / F.col("other_median") - 1), 6))


_ORIGIN = "SELECT x.song_id, x.hit, CASE WHEN a.country = 'US' THEN 'US' WHEN a.country IS NOT NULL THEN 'outside' END AS origin, a.country FROM (" + _SONGS + ") x LEFT JOIN (SELECT lower(artist_name) AS k, min(country) AS country FROM mb_artists WHERE artist_name IS NOT NULL GROUP BY 1) a ON lower(x.primary_artist) = a.k"


@query(_rates_sql("origin", src=_ORIGIN))
def rate_by_origin(s, d):
    """Share of hits of acts from the US and from elsewhere; an unknown country stays unknown."""
    a = T(s, d, "mb_artists").where("artist_name IS NOT NULL").groupBy(F.lower("artist_name").alias("k")).agg(F.min("country").alias("country"))
    j = songs(s, d).join(a, F.lower("primary_artist") == F.col("k"), "left").withColumn("origin", F.when(F.col("country") == "US", "US").when(F.col("country").isNotNull(), "outside"))
    return _rates(j, "origin")


@query(f"SELECT primary_genre, count(*) FILTER (has_feature) AS with_n, count(*) FILTER (NOT has_feature) AS without_n, round(100.0 * count(*) FILTER (has_feature AND hit) / nullif(count(*) FILTER (has_feature), 0) - 100.0 * count(*) FILTER (NOT has_feature AND hit) / nullif(count(*) FILTER (NOT has_feature), 0), 6) AS gap FROM ({_SONGS}) x WHERE primary_genre IS NOT NULL AND has_feature IS NOT NULL GROUP BY 1")
def stratified_rates(s, d):
    """Gap of the hit rates with and without a feature, inside each genre."""
    f, h = F.col("has_feature"), F.col("hit")
    g = songs(s, d).where("primary_genre IS NOT NULL AND has_feature IS NOT NULL").groupBy("primary_genre").agg(F.count_if(f).alias("with_n"), F.count_if(~f).alias("without_n"), F.count_if(f & h).alias("a"), F.count_if(~f & h).alias("b"))
    zero = F.lit(0)
    return g.select("primary_genre", "with_n", "without_n", F.round(100.0 * F.col("a") / F.nullif("with_n", zero) - 100.0 * F.col("b") / F.nullif("without_n", zero), 6).alias("gap"))


@query(f"SELECT primary_genre, debut_year, n, round(100.0 * n / sum(n) OVER (PARTITION BY debut_year), 6) AS share FROM (SELECT primary_genre, debut_year, count(*) AS n FROM ({_SONGS}) x WHERE hit AND primary_genre IS NOT NULL AND debut_year IS NOT NULL GROUP BY 1, 2)")
def genre_mix_over_time(s, d):
    g = songs(s, d).where("hit AND primary_genre IS NOT NULL AND debut_year IS NOT NULL").groupBy("primary_genre", "debut_year").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("debut_year")), 6))


@query(f"SELECT debut_year, model_split, count(*) AS n, count(*) FILTER (hit) AS hits FROM ({_SONGS}) x GROUP BY GROUPING SETS ((debut_year, model_split), (model_split), ())")
def sample_totals(s, d):
    """Songs and hits per year and split, with subtotals."""
    t = songs(s, d).select("debut_year", "model_split", F.col("hit").cast("int").alias("h"))
    # one pass to small groups, then the subtotals from those
    g = t.groupBy("debut_year", "model_split").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("hits"))
    sub = g.groupBy("model_split").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit(None).cast("int").alias("debut_year"), "model_split", "n", "hits")
    every = g.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit(None).cast("int").alias("debut_year"), F.lit(None).cast("string").alias("model_split"), "n", "hits")
    return g.unionByName(sub).unionByName(every)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / sd, 6) AS scaled FROM (SELECT * FROM lineitem WHERE year(l_shipdate) >= 1997), (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem WHERE year(l_shipdate) < 1997)")
def train_stats_scale(s, d):
    """Later rows scaled by the mean and deviation of earlier ones only."""
    l = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.year("l_shipdate").alias("y"))
    st = l.where("y < 1997").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd"))
    return l.where("y >= 1997").crossJoin(F.broadcast(st)).select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_quantity") - F.col("m")) / F.col("sd"), 6).alias("scaled"))


@query("SELECT count(*) AS n, count(*) FILTER (n_charted IS NULL) AS not_charted, count(*) FILTER (coalesce(top10, false) <> (best <= 10)) AS differing_hits FROM songs_analysis LEFT JOIN (SELECT title, artist, count(*) AS n_charted, min(this_week) AS best FROM weekly GROUP BY 1, 2) USING (title, artist)")
def consistency_checks(s, d):
    """The analysis table against the chart it was made from."""
    w = T(s, d, "weekly").groupBy("title", "artist").agg(F.count(F.lit(1)).alias("n_charted"), F.min("this_week").alias("best"))
    j = T(s, d, "songs_analysis").join(w, ["title", "artist"], "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_charted").isNull()).alias("not_charted"), F.count_if(F.coalesce("top10", F.lit(False)) != (F.col("best") <= 10)).alias("differing_hits"))
