"""The study's questions over finished songs: training rows only, and only what was known at the debut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import contracts, model, stats
from tallyspark.plans.analyses import _CREDITS, _HISTORY, _NAMED, _SONGS, _chi, _chi_sql, _rates, _rates_sql, artist_history, credits_with_lead, songs
from tallyspark.plans.relational import CREDITS_SQL, season_fold
from tallyspark.plans.relational import SQL as _RELATIONAL
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


TRAIN = "model_split = 'train'"
_STRONG = f"(^|\\s)((({'|'.join(tx.STRONG_STARTS)})[^\\s]*)|({'|'.join(tx.STRONG_WORDS)}))(\\s|$)"
_WORDS = "regexp_replace(lower(lyrics_clean), '[^a-z0-9''\\s]', ' ', 'g')"
_DATE = "CASE WHEN regexp_full_match(first_release_date, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(first_release_date AS DATE) END"
_BASE = f"""SELECT x.*, coalesce(h.prior_top10s, 0) AS prior_hits, coalesce(h.eventual_top10s, 0) AS eventual_hits, coalesce(h.prior_entries, 0) AS entries_before, coalesce(h.guest_bigger, false) AS guest_bigger, k.same_week, r.release_format, date_diff('day', r.released, x.first_chart_date) AS days_to_chart,
 CASE WHEN regexp_matches({_WORDS}, '[a-z0-9'']') THEN regexp_matches({_WORDS}, '{_STRONG}') END AS has_strong, o.country FROM ({_SONGS}) x LEFT JOIN ({_HISTORY}) h USING (title, artist) LEFT JOIN (SELECT primary_artist, first_chart_date, count(*) AS same_week FROM songs_analysis GROUP BY ALL) k ON k.primary_artist = x.primary_artist AND k.first_chart_date = x.first_chart_date
 LEFT JOIN (SELECT title, artist, min_by(release_type, row_id) AS release_format, min({_DATE}) AS released FROM mb_songs WHERE release_type IS NOT NULL GROUP BY ALL) r USING (title, artist) LEFT JOIN (SELECT lower(artist_name) AS act, min(country) AS country FROM mb_artists WHERE artist_name IS NOT NULL GROUP BY 1) o ON o.act = lower(x.primary_artist)"""
_STUDY = f"""SELECT *, CASE WHEN prior_hits = 0 THEN '0' WHEN prior_hits <= 4 THEN '1-4' WHEN prior_hits <= 9 THEN '5-9' ELSE '10+' END AS hits_band, CASE WHEN eventual_hits = 0 THEN '0' WHEN eventual_hits <= 4 THEN '1-4' WHEN eventual_hits <= 9 THEN '5-9' ELSE '10+' END AS eventual_band,
 CASE WHEN same_week = 1 THEN '1' WHEN same_week <= 4 THEN '2-4' WHEN same_week <= 9 THEN '5-9' WHEN same_week > 9 THEN '10+' END AS drop_band, CASE WHEN prior_hits > 0 THEN 'established' ELSE 'newcomer' END AS status, n_credited_artists >= 2 AS collaboration,
 CASE WHEN country = 'US' THEN 'US' WHEN country IS NOT NULL THEN 'outside' END AS origin, CASE WHEN release_format IN ('Single', 'Album') THEN release_format END AS single_or_album, CASE WHEN same_week = 1 THEN 'alone' WHEN same_week >= 5 THEN 'drop of 5+' END AS released_in,
 CASE WHEN entries_before = 0 THEN 'first entry' WHEN entries_before <= 2 THEN '1-2' WHEN entries_before <= 5 THEN '3-5' WHEN entries_before <= 10 THEN '6-10' ELSE '11+' END AS entries_group,
 CASE WHEN entries_before < 3 THEN NULL WHEN prior_hits = 0 THEN '0%' WHEN prior_hits / entries_before <= 0.1 THEN '1-10%' WHEN prior_hits / entries_before <= 0.25 THEN '11-25%' ELSE 'over 25%' END AS ratio_group FROM ({_BASE})"""


def study(s, d) -> DataFrame:
    """One row per analysed song with its history, drop size, release and origin."""
    c = F.col
    x = songs(s, d)
    h = artist_history(s, d).select("title", "artist", c("prior_top10s").alias("prior_hits"), c("eventual_top10s").alias("eventual_hits"), c("prior_entries").alias("entries_before"), "guest_bigger")
    k = x.where("primary_artist IS NOT NULL AND first_chart_date IS NOT NULL").groupBy("primary_artist", "first_chart_date").agg(F.count(F.lit(1)).alias("same_week"))
    r = T(s, d, "mb_songs").where("release_type IS NOT NULL").groupBy("title", "artist").agg(F.min_by("release_type", "row_id").alias("release_format"), F.min(tx.full_date("first_release_date")).alias("released"))
    o = T(s, d, "mb_artists").where("artist_name IS NOT NULL").groupBy(F.lower("artist_name").alias("act")).agg(F.min("country").alias("country"))
    t = x.join(h, ["title", "artist"], "left").join(k, ["primary_artist", "first_chart_date"], "left").join(r, ["title", "artist"], "left").join(o, F.lower("primary_artist") == c("act"), "left")
    zero = F.lit(0)
    t = t.withColumns(
        {
            "prior_hits": F.coalesce("prior_hits", zero),
            "eventual_hits": F.coalesce("eventual_hits", zero),
            "entries_before": F.coalesce("entries_before", zero),
            "guest_bigger": F.coalesce("guest_bigger", F.lit(False)),
            "days_to_chart": F.datediff("first_chart_date", "released").cast("long"),
            "has_strong": tx.has_strong_word(tx.lyric_text("lyrics_clean")),
        }
    )
    band = lambda v: F.when(v == 0, "0").when(v <= 4, "1-4").when(v <= 9, "5-9").otherwise("10+")
    w, e, ratio = c("same_week"), c("entries_before"), c("prior_hits") / c("entries_before")
    return t.withColumns(
        {
            "hits_band": band(c("prior_hits")),
            "eventual_band": band(c("eventual_hits")),
            "drop_band": F.when(w == 1, "1").when(w <= 4, "2-4").when(w <= 9, "5-9").when(w > 9, "10+"),
            "status": F.when(c("prior_hits") > 0, "established").otherwise("newcomer"),
            "collaboration": c("n_credited_artists") >= 2,
            "origin": F.when(c("country") == "US", "US").when(c("country").isNotNull(), "outside"),
            "single_or_album": F.when(c("release_format").isin("Single", "Album"), c("release_format")),
            "released_in": F.when(w == 1, "alone").when(w >= 5, "drop of 5+"),
            "entries_group": F.when(e == 0, "first entry").when(e <= 2, "1-2").when(e <= 5, "3-5").when(e <= 10, "6-10").otherwise("11+"),
            "ratio_group": F.when(e < 3, None).when(c("prior_hits") == 0, "0%").when(ratio <= 0.1, "1-10%").when(ratio <= 0.25, "11-25%").otherwise("over 25%"),
        }
    )


# name, groups, which training rows, what it says
for _name, _by, _where, _doc in (
    ("rate_by_prior_hits", "hits_band", "true", "Share of hits by the act's hits before the debut."),
    ("rate_by_hit_ratio", "ratio_group", "true", "Share of hits by the share of the act's earlier entries that were hits by then, from three entries on."),
    ("rate_by_hit_ratio_and_hits", "hits_band, ratio_group", "prior_hits > 0", "The hit ratio among acts with alike numbers of hits."),
    ("never_hit", "entries_group", "prior_hits = 0", "Share of hits of acts without an earlier one, by their earlier entries."),
    ("never_hit_alone", "entries_group", "prior_hits = 0 AND drop_band = '1'", "The same for songs that came alone."),
    ("genre_rate_alone", "primary_genre", "drop_band = '1'", "Share of hits by genre, songs that came alone."),
    ("rate_by_drop", "drop_band", "true", "Share of hits by the number of the act's debuts that week."),
    ("rate_by_drop_and_status", "drop_band, status", "true", "The same for newcomers and established acts."),
    ("rate_by_drop_and_genre", "primary_genre, drop_band", "true", "Drop size within each genre."),
    ("rate_by_format", "single_or_album", "true", "Singles against album tracks."),
    ("rate_by_format_alone", "single_or_album", "drop_band = '1'", "Singles against album tracks that came alone."),
    ("rate_by_collaboration", "collaboration", "true", "Two or more credited acts against one."),
    ("rate_by_strong_words", "has_strong", "true", "Share of hits with and without strong words."),
    ("rate_by_strong_words_and_genre", "primary_genre, has_strong", "true", "The same within each genre."),
    ("rate_by_guest_bigger", "guest_bigger", "has_feature", "Featured songs whose guest had more hits than the lead, against the others."),
    ("rate_by_origin_and_hits", "hits_band, origin", "true", "Acts from the US and elsewhere with alike numbers of hits."),
    ("debut_band_naive", "debut_position_band", "true", "Share of hits by first place, songs that start in the top 10 included."),
    ("rate_by_month_small_drops", "debut_month", "same_week < 5", "Share of hits by month of debut without drops of five and more."),
):
    _src = _STUDY if _name != "debut_band_naive" else f"SELECT *, CASE WHEN debut_position <= 10 THEN '1-10' ELSE debut_band END AS debut_position_band FROM ({_STUDY})"

    def _f(s, d, by=_by, where=_where):
        t = study(s, d).where(TRAIN).where(where)
        return _rates(t.withColumn("debut_position_band", F.when(F.col("debut_position") <= 10, "1-10").otherwise(F.col("debut_band"))), *by.split(", "))

    _f.__name__, _f.__doc__ = _name, _doc
    QUERIES[_name], SQL[_name] = _f, _rates_sql(_by, f"{TRAIN} AND {_where}", _src)

CHI = (
    ("chi_prior_hits", "hits_band", "hit", "true", ""),
    ("chi_hit_ratio", "ratio_group", "hit", "true", ""),
    ("chi_hit_ratio_within", "ratio_group", "hit", "prior_hits > 0 AND entries_before >= 3", "hits_band"),
    ("chi_never_hit", "entries_group", "hit", "prior_hits = 0", ""),
    ("chi_status_by_genre", "status", "hit", "primary_genre IS NOT NULL", "primary_genre"),
    ("chi_drop", "drop_band", "hit", "true", ""),
    ("chi_drop_by_status", "drop_band", "hit", "true", "status"),
    ("chi_drop_by_genre", "drop_band", "hit", "primary_genre IS NOT NULL", "primary_genre"),
    ("chi_format", "single_or_album", "hit", "true", ""),
    ("chi_format_alone", "single_or_album", "hit", "drop_band = '1'", ""),
    ("chi_collaboration", "collaboration", "hit", "true", ""),
    ("chi_strong_words", "has_strong", "hit", "true", ""),
    ("chi_strong_words_by_genre", "has_strong", "hit", "primary_genre IS NOT NULL", "primary_genre"),
    ("chi_genre_mix", "debut_year", "primary_genre", "hit", ""),
    ("chi_origin", "origin", "hit", "true", ""),
    ("chi_origin_by_hits", "origin", "hit", "true", "hits_band"),
    ("chi_debut_band", "debut_band", "hit", "debut_position > 10", ""),
    ("chi_guest_bigger", "guest_bigger", "hit", "has_feature", ""),
)
for _name, _a, _b, _where, _strata in CHI:

    def _g(s, d, a=_a, b=_b, where=_where, strata=_strata):
        return _chi(study(s, d).where(TRAIN).where(where), a, b, (strata,) if strata else ())

    _g.__name__, _g.__doc__ = _name, f"Test of {_a} against {_b}" + (f" within each {_strata}." if _strata else ".")
    QUERIES[_name], SQL[_name] = _g, _chi_sql(_a, _b, f"{TRAIN} AND {_where}", _strata, _STUDY)


@query()
def study_p_values(s, d):
    """The p-values of all tests above: (question, stratum, n, chi2, dof, p, cramers_v, strength)."""
    t = cut(study(s, d).where(TRAIN))
    out = None
    for name, a, b, where, strata in CHI:
        x = stats.with_p(stats.chi_square(t.where(where), a, b, (strata,) if strata else ()))
        x = x.select(F.lit(name).alias("question"), (F.col(strata) if strata else F.lit(None)).cast("string").alias("stratum"), "n", "chi2", "dof", "p", "cramers_v", "strength")
        out = x if out is None else out.unionByName(x)
    return out


@query(f"SELECT 'eventual' AS version, * FROM ({_chi_sql('eventual_band', 'hit', TRAIN, '', _STUDY)}) UNION ALL SELECT 'known' AS version, * FROM ({_chi_sql('hits_band', 'hit', TRAIN, '', _STUDY)})")
def eventual_against_known(s, d):
    """What the count of later hits would have made of the test, beside the honest one."""
    t = cut(study(s, d).where(TRAIN))
    one = lambda v, a: _chi(t, a).select(F.lit(v).alias("version"), "*")
    return one("eventual", "eventual_band").unionByName(one("known", "hits_band"))


@query(f"SELECT count(*) FILTER (eventual_hits > prior_hits) AS differing, count(*) AS n FROM ({_STUDY}) WHERE {TRAIN}")
def eventual_differs(s, d):
    return study(s, d).where(TRAIN).agg(F.count_if(F.col("eventual_hits") > F.col("prior_hits")).alias("differing"), F.count(F.lit(1)).alias("n"))


_GAP = f"SELECT primary_genre, count(*) FILTER (prior_hits = 0) AS n_without, count(*) FILTER (prior_hits > 0) AS n_with, count(*) FILTER (hit AND prior_hits = 0) AS a, count(*) FILTER (hit AND prior_hits > 0) AS b FROM ({_STUDY}) WHERE {TRAIN} AND primary_genre IS NOT NULL GROUP BY 1"


@query(f"SELECT primary_genre, n_without, n_with, round(100.0 * a / nullif(n_without, 0), 6) AS rate_without, round(100.0 * b / nullif(n_with, 0), 6) AS rate_with, round(100.0 * b / nullif(n_with, 0) - 100.0 * a / nullif(n_without, 0), 6) AS gap FROM ({_GAP})")
def genre_by_previous_hit(s, d):
    """Gap of the hit rates of acts with and without an earlier hit, inside each genre."""
    old, h, zero = F.col("prior_hits") > 0, F.col("hit"), F.lit(0)
    g = study(s, d).where(TRAIN).where("primary_genre IS NOT NULL").groupBy("primary_genre").agg(F.count_if(~old).alias("n_without"), F.count_if(old).alias("n_with"), F.count_if(h & ~old).alias("a"), F.count_if(h & old).alias("b"))
    lo, hi = 100.0 * F.col("a") / F.nullif("n_without", zero), 100.0 * F.col("b") / F.nullif("n_with", zero)
    return g.select("primary_genre", "n_without", "n_with", F.round(lo, 6).alias("rate_without"), F.round(hi, 6).alias("rate_with"), F.round(hi - lo, 6).alias("gap"))


_BOTH = f"SELECT primary_artist, released_in, count(*) AS n, count(*) FILTER (hit) AS h FROM ({_STUDY}) WHERE {TRAIN} AND released_in IS NOT NULL AND primary_artist IS NOT NULL GROUP BY ALL"
_PAIR = f"SELECT primary_artist, a.n AS n_alone, b.n AS n_drop, round(a.h / a.n, 9) AS rate_alone, round(b.h / b.n, 9) AS rate_drop FROM (SELECT * FROM ({_BOTH}) WHERE released_in = 'alone') a JOIN (SELECT * FROM ({_BOTH}) WHERE released_in <> 'alone') b USING (primary_artist)"


@query(f"SELECT *, CASE WHEN rate_alone > rate_drop THEN 'better alone' WHEN rate_alone < rate_drop THEN 'better in drops' ELSE 'tie' END AS verdict FROM ({_PAIR})")
def within_artist(s, d):
    """Each act against itself: songs that came alone against songs in drops of five and more; drops of 2 to 4 are left out."""
    t = study(s, d).where(TRAIN).where("released_in IS NOT NULL AND primary_artist IS NOT NULL")
    alone, zero = F.col("released_in") == "alone", F.lit(0)
    g = t.groupBy("primary_artist").agg(F.count_if(alone).alias("n_alone"), F.count_if(~alone).alias("n_drop"), F.count_if(alone & F.col("hit")).alias("ha"), F.count_if(~alone & F.col("hit")).alias("hd")).where("n_alone > 0 AND n_drop > 0")
    g = g.select("primary_artist", "n_alone", "n_drop", F.round(F.col("ha") / F.nullif("n_alone", zero), 9).alias("rate_alone"), F.round(F.col("hd") / F.nullif("n_drop", zero), 9).alias("rate_drop"))
    return g.withColumn("verdict", F.when(F.col("rate_alone") > F.col("rate_drop"), "better alone").when(F.col("rate_alone") < F.col("rate_drop"), "better in drops").otherwise("tie"))


@query(_chi_sql("released_in", "hit", "true", "", f"SELECT y.released_in, y.hit FROM ({_STUDY}) y JOIN ({_PAIR}) p USING (primary_artist) WHERE {TRAIN} AND released_in IS NOT NULL"))
def within_artist_pooled(s, d):
    """The songs of the acts that did both, pooled."""
    t = cut(study(s, d).where(TRAIN).where("released_in IS NOT NULL").select("primary_artist", "released_in", "hit"))
    both = t.groupBy("primary_artist").agg(F.count_if(F.col("released_in") == "alone").alias("a"), F.count_if(F.col("released_in") != "alone").alias("b")).where("a > 0 AND b > 0").select("primary_artist")
    return _chi(t.join(both, "primary_artist"), "released_in")


@query(f"SELECT single_or_album, count(*) AS n, round(100.0 * count(*) FILTER (drop_band = '1') / count(*), 6) AS alone_share FROM ({_STUDY}) WHERE {TRAIN} AND single_or_album IS NOT NULL GROUP BY 1")
def alone_by_format(s, d):
    return study(s, d).where(TRAIN).where("single_or_album IS NOT NULL").groupBy("single_or_album").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("drop_band") == "1") / F.count(F.lit(1)), 6).alias("alone_share"))


@query(f"SELECT hit, count(*) AS n, quantile_cont(days_to_chart, 0.25) AS q1, median(days_to_chart) AS median_days, quantile_cont(days_to_chart, 0.75) AS q3 FROM ({_STUDY}) WHERE {TRAIN} AND days_to_chart IS NOT NULL GROUP BY 1")
def days_to_chart_quartiles(s, d):
    x = F.col("days_to_chart")
    return study(s, d).where(TRAIN).where(x.isNotNull()).groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.percentile(x, 0.25).alias("q1"), F.median(x).alias("median_days"), F.percentile(x, 0.75).alias("q3"))


_MW = """WITH x AS (SELECT CAST({v} AS DOUBLE) AS v, hit AS g FROM ({src}) WHERE {where} AND {v} IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY v) AS t FROM x),
 a AS (SELECT CAST(count(*) FILTER (g) AS DOUBLE) AS d1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS d2, sum(rk) FILTER (g) AS r1, sum(t * t - 1) AS ties FROM r), b AS (SELECT *, r1 - d1 * (d1 + 1) / 2 AS u FROM a)
 SELECT CAST(d1 AS BIGINT) AS n1, CAST(d2 AS BIGINT) AS n2, round(CAST(u AS DOUBLE), 4) AS u, round(greatest(abs(u - d1 * d2 / 2) - 0.5, 0) / sqrt(d1 * d2 / 12 * ((d1 + d2 + 1) - ties / ((d1 + d2) * (d1 + d2 - 1)))), 6) AS z, round(2 * u / (d1 * d2) - 1, 6) AS rank_biserial FROM b"""


@query(_MW.format(v="days_to_chart", src=_STUDY, where=TRAIN))
def days_to_chart_test(s, d):
    """Days from release to chart of hits against the rest."""
    m = stats.mann_whitney(study(s, d).where(TRAIN), "days_to_chart", "hit")
    return m.select("n1", "n2", F.round("u", 4).alias("u"), F.round("z", 6).alias("z"), F.round("rank_biserial", 6).alias("rank_biserial"))


@query()
def mann_whitney_p(s, d):
    """p-values of the lyric measures and of the days to chart: all rows, and without texts that look cut short."""
    t = cut(study(s, d).where(TRAIN).join(suspect_short(s, d).select("song_id", "suspect"), "song_id", "left"))
    out = None
    for label, rows in (("all", t), ("without suspects", t.where("NOT coalesce(suspect, false)"))):
        for v in ("unique_word_ratio", "repetition_score", "avg_line_length", "word_count", "days_to_chart"):
            x = stats.with_normal_p(stats.mann_whitney(rows, v, "hit")).select(F.lit(label).alias("rows"), F.lit(v).alias("measure"), "n1", "n2", "median1", "median2", "u", "z", "p", "rank_biserial")
            out = x if out is None else out.unionByName(x)
    return out


_STARS = f"SELECT primary_artist FROM ({_STUDY}) WHERE {TRAIN} AND origin = 'outside' AND hit GROUP BY 1 ORDER BY count(*) DESC, primary_artist LIMIT 3"


@query(_chi_sql("origin", "hit", f"{TRAIN} AND primary_artist NOT IN ({_STARS})", "", _STUDY))
def chi_origin_without_stars(s, d):
    """The origin test without the three acts from elsewhere that have the most hits."""
    t = cut(study(s, d).where(TRAIN).select("primary_artist", "origin", "hit"))
    stars = t.where("origin = 'outside' AND hit").groupBy("primary_artist").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "primary_artist").limit(3)
    return _chi(t.where("primary_artist IS NOT NULL").join(F.broadcast(stars.select("primary_artist")), "primary_artist", "left_anti"), "origin")


_BY_ID = "SELECT title, artist, min(regexp_extract(artist_mbids, '([0-9a-f]{8}-[0-9a-f-]{27})', 1)) AS artist_mbid FROM mb_songs WHERE regexp_matches(artist_mbids, '[0-9a-f]{8}-[0-9a-f-]{27}') GROUP BY ALL"


@query(_rates_sql("origin", TRAIN, f"SELECT x.*, CASE WHEN a.country = 'US' THEN 'US' WHEN a.country IS NOT NULL THEN 'outside' END AS origin FROM ({_SONGS}) x JOIN ({_BY_ID}) m USING (title, artist) JOIN (SELECT artist_mbid, min(country) AS country FROM mb_artists GROUP BY 1) a USING (artist_mbid)"))
def rate_by_origin_of_lead_id(s, d):
    """Origin by the id of the recording's first act, not by its name."""
    pattern = r"([0-9a-f]{8}-[0-9a-f-]{27})"
    m = T(s, d, "mb_songs").where(F.col("artist_mbids").rlike(pattern)).groupBy("title", "artist").agg(F.min(F.regexp_extract("artist_mbids", pattern, 1)).alias("artist_mbid"))
    a = T(s, d, "mb_artists").groupBy("artist_mbid").agg(F.min("country").alias("country"))
    t = songs(s, d).where(TRAIN).join(m, ["title", "artist"]).join(a, "artist_mbid")
    return _rates(t.withColumn("origin", F.when(F.col("country") == "US", "US").when(F.col("country").isNotNull(), "outside")), "origin")


#: Titles that hold a holiday word and are no holiday songs.
NO_HOLIDAY = (("Santa Fe", "Zach Bryan"), ("Holiday Road", "Kesha"))
_NO_HOLIDAY = " OR ".join(f"(title = '{t}' AND artist = '{a}')" for t, a in NO_HOLIDAY)


@query(f"SELECT title, artist, CASE WHEN share >= 0.7 AND seasons >= 2 THEN 'season' WHEN is_holiday AND NOT ({_NO_HOLIDAY}) THEN 'title' END AS reason FROM ({_RELATIONAL['season_fold']}) WHERE is_holiday")
def holiday_list(s, d):
    """Holiday songs and what shows it: the season of their weeks or their title."""
    listed = F.lit(False)
    for t, a in NO_HOLIDAY:
        listed = listed | ((F.col("title") == t) & (F.col("artist") == a))
    return season_fold(s, d).where("is_holiday").select("title", "artist", F.when((F.col("share") >= 0.7) & (F.col("seasons") >= 2), "season").when(~listed, "title").alias("reason"))


@query(f"SELECT country, count(*) AS n, count(*) FILTER (hit) AS hits, round(100.0 * count(*) FILTER (hit) / count(*), 6) AS rate FROM ({_STUDY}) WHERE {TRAIN} AND country IS NOT NULL GROUP BY 1 HAVING count(*) >= 40")
def rate_by_country(s, d):
    """Countries with at least 40 songs."""
    return _rates(study(s, d).where(TRAIN), "country").where("n >= 40")


_PEAK = f"SELECT title, artist, arg_min(chart_date, (this_week, chart_date)) AS peak_date FROM weekly WHERE this_week IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT debut_year, count(*) AS n, round(100.0 * count(*) FILTER (p.peak_date = c.debut_date) / count(*), 6) AS at_peak_share FROM (SELECT *, year(debut_date)::INTEGER AS debut_year FROM ({CREDITS_SQL})) c JOIN ({_PEAK}) p USING (title, artist) WHERE first_top10_date IS NOT NULL AND last_date < (SELECT max(chart_date) FROM weekly) GROUP BY 1")
def debut_at_peak_by_year(s, d):
    """Share of finished hits whose first week was their best, by year."""
    from tallyspark.plans.relational import credits_of

    p = T(s, d, "weekly").where("this_week IS NOT NULL").groupBy("title", "artist").agg(F.min_by("chart_date", F.struct("this_week", "chart_date")).alias("peak_date"))
    last = T(s, d, "weekly").agg(F.max("chart_date").alias("m"))
    c = credits_of(s, d).where("first_top10_date IS NOT NULL").crossJoin(F.broadcast(last)).where("last_date < m").join(p, ["title", "artist"])
    return c.groupBy(F.year("debut_date").alias("debut_year")).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("peak_date") == F.col("debut_date")) / F.count(F.lit(1)), 6).alias("at_peak_share"))


# --- leak checks -----------------------------------------------------------------------------------
FULL_FEATURES = ("prior_top10s", "prior_entries", "primary_genre", "album_debut_bucket", "n_credited_artists", "has_feature", "has_profanity", "duration_used", "days_release_to_chart", "word_count", "unique_word_ratio", "repetition_score", "avg_line_length")
LATE_COLUMNS = ("debut_position", "peak_position", "weeks_on_chart")


@query("SELECT f.name FROM (VALUES " + ", ".join(f"('{x}')" for x in FULL_FEATURES) + ") f(name) JOIN (VALUES " + ", ".join(f"('{x}')" for x in LATE_COLUMNS) + ") l(name) USING (name)")
def leaking_features(s, d):
    """Model inputs that are only known after the first week; must be none."""
    return s.createDataFrame([(x,) for x in FULL_FEATURES], "name string").join(s.createDataFrame([(x,) for x in LATE_COLUMNS], "name string"), "name")


@query(f"SELECT count(*) AS self_counted FROM ({_CREDITS}) c JOIN ({_NAMED}) e ON e.name = c.lead AND e.title = c.title AND e.artist = c.artist WHERE e.debut_date < c.debut_date")
def self_in_history(s, d):
    """Songs that count themselves among the earlier songs of their lead; must be none."""
    c = credits_with_lead(s, d)
    e = c.select("title", "artist", F.col("debut_date").alias("before"), F.explode(F.array_distinct(tx.split_credit("artist"))).alias("lead"))
    return c.select("title", "artist", "lead", "debut_date").join(e, ["title", "artist", "lead"]).where("before < debut_date").agg(F.count(F.lit(1)).alias("self_counted"))


# --- models --------------------------------------------------------------------------------------------------
BASELINE = ("prior_hits", "entries_before")
_NUMBERS = ("n_credited_artists", "has_feature", "has_strong", "duration_used", "days_to_chart", "word_count", "unique_word_ratio", "repetition_score", "avg_line_length")


def _inputs(s, d) -> tuple[DataFrame, list[str]]:
    """Finished songs with the inputs of the full model: numbers, and a column for each genre and drop size but the first."""
    t = study(s, d).where("model_split IN ('train', 'test')").withColumns({c: F.col(c).cast("double") for c in (*BASELINE, *_NUMBERS)})
    t, genres = model.one_hot(t, "primary_genre", ["Latin", "R&B", "country", "dance/electronic", "hip-hop/rap", "mixed", "other", "pop", "rock/alternative"], "genre")
    t, drops = model.one_hot(t, "drop_band", ["1", "10+", "2-4", "5-9"], "drop")
    keep = [*BASELINE, *_NUMBERS, *genres, *drops]
    return cut(t.select("song_id", "model_split", "hit", *keep)), keep


@query()
def model_predictions(s, d):
    """Chance of a hit for test rows by the full model."""
    t, cols = _inputs(s, d)
    return model.fit_predict(t, "model_split", "hit", cols, ["song_id"])[0]


@query()
def model_scores(s, d):
    """Precision and recall of the baseline with the two history inputs and of the full model."""
    t, cols = _inputs(s, d)
    out = None
    for name, use in (("baseline", BASELINE), ("full", cols)):
        x = model.precision_recall(model.fit_predict(t, "model_split", "hit", use, ["song_id"])[0]).withColumn("model", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


@query()
def model_coefficients(s, d):
    """Weights of the full model, the largest first."""
    t, cols = _inputs(s, d)
    got = sorted(model.fit_predict(t, "model_split", "hit", cols, ["song_id"])[1], key=lambda x: (-abs(x[1]), x[0]))
    return s.createDataFrame([(k + 1, n, v) for k, (n, v) in enumerate(got)], "rank int, predictor string, weight double")


@query()
def model_confusion(s, d):
    t, cols = _inputs(s, d)
    return model.confusion(model.fit_predict(t, "model_split", "hit", cols, ["song_id"])[0])


# --- lengths and texts that look cut short ----------------------------------------------------------------
_LYR = "SELECT title, artist, min_by(duration, lyric_id) FILTER (duration IS NOT NULL) AS duration, min_by(plain_lyrics, lyric_id) FILTER (plain_lyrics IS NOT NULL) AS plain_lyrics, coalesce(bool_or(instrumental), false) AS instrumental, bool_or(coalesce(match_method, 'none') NOT IN ('', 'none')) AS matched FROM lyrics GROUP BY ALL"
_MS = "SELECT title, artist, min_by(recording_length_ms, row_id) FILTER (recording_length_ms IS NOT NULL) AS ms FROM mb_songs GROUP BY ALL"
_LEN = f"""SELECT x.song_id, x.primary_genre, length(l.plain_lyrics) AS chars, l.instrumental, coalesce(l.matched, false) AS matched, CASE WHEN l.duration BETWEEN 30 AND 600 THEN l.duration WHEN ms / 1000 BETWEEN 30 AND 600 THEN ms / 1000 END AS used,
 CASE WHEN l.duration BETWEEN 30 AND 600 THEN 'lyrics' WHEN ms IS NOT NULL AND ms <> 0 THEN 'recording' ELSE 'none' END AS source FROM songs_analysis x LEFT JOIN ({_LYR}) l USING (title, artist) LEFT JOIN ({_MS}) m USING (title, artist)"""


def lengths(s, d) -> DataFrame:
    """Songs with a believable length from the first of two providers that has one, and the size of their text."""
    have = lambda v, o: F.min_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col(o)))
    l = T(s, d, "lyrics").groupBy("title", "artist").agg(have("duration", "lyric_id").alias("duration"), have("plain_lyrics", "lyric_id").alias("plain_lyrics"), F.coalesce(F.bool_or("instrumental"), F.lit(False)).alias("instrumental"), F.bool_or(~F.coalesce("match_method", F.lit("none")).isin("", "none")).alias("matched"))
    m = T(s, d, "mb_songs").groupBy("title", "artist").agg(have("recording_length_ms", "row_id").alias("ms"))
    t = T(s, d, "songs_analysis").select("song_id", "title", "artist", "primary_genre").join(l, ["title", "artist"], "left").join(m, ["title", "artist"], "left")
    first, second = F.col("duration").between(30, 600), (F.col("ms") / 1000).between(30, 600)
    return t.select(
        "song_id", "primary_genre", F.length("plain_lyrics").cast("long").alias("chars"), "instrumental", F.coalesce("matched", F.lit(False)).alias("matched"),
        F.when(first, F.col("duration")).when(second, F.col("ms") / 1000).alias("used"), F.when(first, "lyrics").when(F.coalesce(F.col("ms") != 0, F.lit(False)), "recording").otherwise("none").alias("source"),
    )


@query(f"SELECT song_id, used AS duration_used, source AS duration_source, used IS NOT NULL AS duration_reliable FROM ({_LEN})")
def duration_from_two(s, d):
    return lengths(s, d).select("song_id", F.col("used").alias("duration_used"), F.col("source").alias("duration_source"), F.col("used").isNotNull().alias("duration_reliable"))


@query(f"WITH t AS (SELECT *, chars / used AS cps FROM ({_LEN})), q AS (SELECT primary_genre, quantile_cont(cps, 0.02) AS q FROM t WHERE primary_genre IS NOT NULL GROUP BY 1), g AS (SELECT quantile_cont(cps, 0.02) AS g FROM t) SELECT song_id, round(cps, 6) AS chars_per_second, coalesce(cps < coalesce(q, g), false) AS suspect FROM t LEFT JOIN q USING (primary_genre), g")
def suspect_short(s, d):
    """Texts among the slowest 2 % of their genre by characters a second; songs without a genre by the cut of all."""
    t = cut(lengths(s, d).withColumn("cps", F.col("chars") / F.col("used")))
    q = t.where("primary_genre IS NOT NULL").groupBy("primary_genre").agg(F.percentile("cps", 0.02).alias("q"))
    g = t.agg(F.percentile("cps", 0.02).alias("g"))
    return t.join(q, "primary_genre", "left").crossJoin(F.broadcast(g)).select("song_id", F.round("cps", 6).alias("chars_per_second"), F.coalesce(F.col("cps") < F.coalesce("q", "g"), F.lit(False)).alias("suspect"))


@query(f"""WITH t AS (SELECT *, chars / used AS cps, matched AND NOT coalesce(instrumental, false) AND coalesce(chars, 0) > 0 AS judged FROM ({_LEN})), r AS (SELECT * FROM t WHERE judged AND used IS NOT NULL),
 q AS (SELECT primary_genre, quantile_cont(cps, 0.02) AS q FROM r WHERE primary_genre IS NOT NULL GROUP BY 1 HAVING count(*) >= 30), g AS (SELECT quantile_cont(cps, 0.02) AS g, quantile_cont(chars, 0.02) AS lc FROM r)
 SELECT song_id, coalesce(CASE WHEN NOT judged THEN false WHEN used IS NOT NULL THEN cps < coalesce(q, g) ELSE chars < lc END, false) AS suspect FROM t LEFT JOIN q USING (primary_genre), g""")
def suspect_short_judged(s, d):
    """The same for judged texts only: genres of at least 30 have a cut of their own, unreliable lengths are judged by characters alone."""
    t = cut(lengths(s, d).withColumns({"cps": F.col("chars") / F.col("used"), "judged": F.col("matched") & ~F.coalesce("instrumental", F.lit(False)) & (F.coalesce("chars", F.lit(0)) > 0)}))
    r = t.where("judged AND used IS NOT NULL")
    q = r.where("primary_genre IS NOT NULL").groupBy("primary_genre").agg(F.percentile("cps", 0.02).alias("q"), F.count(F.lit(1)).alias("n")).where("n >= 30").drop("n")
    g = r.agg(F.percentile("cps", 0.02).alias("g"), F.percentile("chars", 0.02).alias("lc"))
    flag = F.when(~F.col("judged"), False).when(F.col("used").isNotNull(), F.col("cps") < F.coalesce("q", "g")).otherwise(F.col("chars") < F.col("lc"))
    return t.join(q, "primary_genre", "left").crossJoin(F.broadcast(g)).select("song_id", F.coalesce(flag, F.lit(False)).alias("suspect"))


# --- the merged table ---------------------------------------------------------------------------------------
_ONE_LYRIC = "SELECT title, artist, min_by({'score': match_score, 'method': match_method, 'has_text': plain_lyrics IS NOT NULL}, lyric_id) AS l FROM lyrics GROUP BY ALL"
_ONE_REC = "SELECT title, artist, min_by({'mbid': recording_mbid, 'score': match_score}, row_id) AS m FROM mb_songs GROUP BY ALL"


@query(f"""SELECT x.song_id, x.title, x.artist, h.prior_entries, h.prior_top10s, q.suspect, u.duration_source, l.l.score AS lyrics_match_score, l.l.method AS lyrics_match_method, m.m.mbid AS recording_mbid, m.m.score AS mb_match_score FROM songs_analysis x
 LEFT JOIN ({_HISTORY}) h USING (title, artist) LEFT JOIN ({SQL['suspect_short']}) q USING (song_id) LEFT JOIN ({SQL['duration_from_two']}) u USING (song_id) LEFT JOIN ({_ONE_LYRIC}) l USING (title, artist) LEFT JOIN ({_ONE_REC}) m USING (title, artist)""")
def merged_songs(s, d):
    """Five left joins, each under the promise that it changes no row count."""
    key = ["title", "artist"]
    lyric = T(s, d, "lyrics").groupBy(*key).agg(F.min_by(F.struct("match_score", "match_method"), "lyric_id").alias("l")).select(*key, F.col("l.match_score").alias("lyrics_match_score"), F.col("l.match_method").alias("lyrics_match_method"))
    rec = T(s, d, "mb_songs").groupBy(*key).agg(F.min_by(F.struct("recording_mbid", "match_score"), "row_id").alias("m")).select(*key, F.col("m.recording_mbid").alias("recording_mbid"), F.col("m.match_score").alias("mb_match_score"))
    t = T(s, d, "songs_analysis").select("song_id", *key)
    for frame, on, kind in (
        (cut(artist_history(s, d).select(*key, "prior_entries", "prior_top10s")), key, "many_to_one"),
        (cut(suspect_short(s, d).select("song_id", "suspect")), ["song_id"], "one_to_one"),
        (duration_from_two(s, d).select("song_id", "duration_source"), ["song_id"], "one_to_one"),
        (lyric, key, "many_to_one"),
        (rec, key, "many_to_one"),
    ):
        t = contracts.checked_join(t, frame, on, kind)
    return t.select("song_id", *key, "prior_entries", "prior_top10s", "suspect", "duration_source", "lyrics_match_score", "lyrics_match_method", "recording_mbid", "mb_match_score")


@query(f"SELECT count(*) AS songs, count(*) FILTER (lyrics_match_score >= 72) AS lyrics_matched, count(*) FILTER (mb_match_score >= 72) AS recordings_matched, count(*) FILTER (duration_source = 'none') AS without_length, count(*) FILTER (suspect) AS suspects FROM ({SQL['merged_songs']})")
def coverage_report(s, d):
    """How many songs the two services cover, and how many lengths and texts are in doubt."""
    return merged_songs(s, d).agg(F.count(F.lit(1)).alias("songs"), F.count_if(F.col("lyrics_match_score") >= 72).alias("lyrics_matched"), F.count_if(F.col("mb_match_score") >= 72).alias("recordings_matched"), F.count_if(F.col("duration_source") == "none").alias("without_length"), F.count_if("suspect").alias("suspects"))
