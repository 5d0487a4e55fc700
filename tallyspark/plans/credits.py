"""Credits of one song brought together, and what follows from it: songs, their weeks, history and lyrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators import resolve
from tallyspark.plans.study import lengths, suspect_short
from tallyspark.plans.texts import _VERSION, CREDIT_SQL
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


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\\([^)]*\\)', ' ', 'g'), '\\bfeat\\.?\\b|\\bfeaturing\\b', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s\\p{{Z}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


_RENAMED = " UNION ALL ".join(f"SELECT '{n}' AS name, '#{k}' AS g" for k, names in enumerate(resolve.RENAMED) for n in names)
_TWO = " OR ".join(f"(x.block = '{t}' AND ((x.artist = '{a}' AND y.artist = '{b}') OR (x.artist = '{b}' AND y.artist = '{a}')))" for t, a, b in resolve.TWO_SONGS)


def groups_sql(gap: int = resolve.MERGE_GAP_DAYS, mutual_lead: bool = False) -> str:
    """Common tables c (credits) and s (credits with their song), as the start of a recursive query."""
    lead = " AND list_contains(x.names, y.lead) AND list_contains(y.names, x.lead)" if mutual_lead else ""
    return f"""WITH RECURSIVE c0 AS (SELECT row_number() OVER (ORDER BY title, artist) AS id, title, artist, min(chart_date) AS debut_date, max(chart_date) AS last_date, min(this_week) AS peak_position, list(DISTINCT chart_date) AS weeks FROM weekly WHERE this_week IS NOT NULL GROUP BY title, artist),
 n AS (SELECT DISTINCT id, {_norm('trim(piece)')} AS name FROM (SELECT id, unnest(string_split({CREDIT_SQL}, '|')) AS piece FROM c0)), nn AS (SELECT * FROM n WHERE name <> '' UNION SELECT id, g FROM n JOIN ({_RENAMED}) USING (name)), l AS (SELECT id, list(name) AS names FROM nn GROUP BY 1),
 c AS (SELECT c0.*, {_norm('title')} AS block, {_norm(f"trim(string_split({CREDIT_SQL}, '|')[1])")} AS lead, names FROM c0 LEFT JOIN l USING (id)),
 p AS (SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.block = y.block AND x.id < y.id AND x.block <> '' WHERE list_has_any(x.names, y.names) AND date_diff('day', least(x.last_date, y.last_date), greatest(x.debut_date, y.debut_date)) <= {gap} AND NOT list_has_any(x.weeks, y.weeks)
 AND (x.title = y.title OR NOT (regexp_matches(x.title, '{_VERSION}') OR regexp_matches(y.title, '{_VERSION}'))) AND NOT ({_TWO}){lead}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(u, k) AS (SELECT a, a FROM e UNION SELECT e.b, r.k FROM r JOIN e ON e.a = r.u), g AS (SELECT u AS id, min(k) AS song FROM r GROUP BY 1),
 s AS (SELECT c.*, coalesce(song, id) AS song FROM c LEFT JOIN g USING (id))"""


_REDUCED = """SELECT arg_min(title, (debut_date, title, artist)) AS title, arg_min(artist, (debut_date, title, artist)) AS artist, arg_max(artist, (debut_date, title, artist)) AS final_artist, min(debut_date) AS debut_date, max(last_date) AS last_date, min(peak_position) AS peak_position,
 len(list_distinct(flatten(list(weeks))))::INTEGER AS weeks_on_chart, CAST(sum(len(weeks)) AS BIGINT) AS weeks_summed, CASE WHEN count(*) > 1 THEN string_agg(concat_ws(' :: ', title, artist), '|' ORDER BY debut_date, title, artist) END AS merged_from"""


def chart_credits(s, d) -> DataFrame:
    w = T(s, d, "weekly").where("this_week IS NOT NULL")
    c = w.groupBy("title", "artist").agg(F.min("chart_date").alias("debut_date"), F.max("chart_date").alias("last_date"), F.min("this_week").alias("peak_position"), F.collect_set("chart_date").alias("weeks"))
    return cut(c.withColumn("id", F.xxhash64("title", "artist")))


@query(f"{groups_sql()} {_REDUCED} FROM s GROUP BY song")
def song_groups(s, d):
    """Credits of one song joined into components: linked or renamed acts, near runs, no shared week."""
    c = chart_credits(s, d)
    return resolve.reduce_groups(c, resolve.merge_groups(c)).drop("song")


@query(f"{groups_sql(28, True)} {_REDUCED} FROM s GROUP BY song")
def song_groups_mutual_lead(s, d):
    """The stricter rule: each one's lead is on the other's credit, and at most 28 days lie between the runs."""
    c = chart_credits(s, d)
    return resolve.reduce_groups(c, resolve.merge_groups(c, 28, mutual_lead=True)).drop("song")


def song_map(s, d) -> DataFrame:
    """(title, artist, song, song_title, song_artist, debut_date): every credit with the song it belongs to."""
    c = chart_credits(s, d)
    g = resolve.merge_groups(c)
    m = c.join(g, "id", "left").select("title", "artist", "debut_date", F.coalesce("component", "id").alias("song"))
    first = m.groupBy("song").agg(F.min_by(F.struct("title", "artist"), F.struct("debut_date", "title", "artist")).alias("f"), F.min("debut_date").alias("song_debut"))
    return cut(m.join(first, "song").select("title", "artist", "song", F.col("f.title").alias("song_title"), F.col("f.artist").alias("song_artist"), "debut_date", "song_debut"))


_SEASON = "CASE month(chart_date) WHEN 12 THEN year(chart_date) WHEN 1 THEN year(chart_date) - 1 END"


@query(f"{groups_sql()}, f AS (SELECT song, arg_min(title, (debut_date, title, artist)) AS song_title, arg_min(artist, (debut_date, title, artist)) AS song_artist FROM s GROUP BY 1) SELECT song_title, song_artist, count(*) AS rows_charted, count(DISTINCT chart_date) AS weeks, count({_SEASON}) AS season_weeks, count(DISTINCT {_SEASON}) AS seasons FROM weekly w JOIN s ON s.title = w.title AND s.artist = w.artist JOIN f USING (song) GROUP BY song, song_title, song_artist")
def weekly_to_song(s, d):
    """Weekly rows of all credits of a song pooled: rows, weeks, weeks in December and January, winters."""
    w = T(s, d, "weekly").select("title", "artist", "chart_date", tx.season_year("chart_date").alias("season"))
    j = w.join(song_map(s, d), ["title", "artist"])
    return j.groupBy("song", "song_title", "song_artist").agg(F.count(F.lit(1)).alias("rows_charted"), F.countDistinct("chart_date").alias("weeks"), F.count("season").alias("season_weeks"), F.countDistinct("season").alias("seasons")).drop("song")


@query(f"{groups_sql()}, t AS (SELECT song, arg_min(title, (debut_date, title, artist)) AS title, arg_min(artist, (debut_date, title, artist)) AS artist, arg_min(lead, (debut_date, title, artist)) AS lead, min(debut_date) AS debut_date FROM s GROUP BY 1), acts AS (SELECT DISTINCT s.song, name FROM s JOIN n USING (id) WHERE name <> '') SELECT a.title, a.artist, count(*) FILTER (b.debut_date < a.debut_date) AS prior_songs FROM t a LEFT JOIN (SELECT acts.name, t.song, t.debut_date FROM acts JOIN t USING (song)) b ON b.name = a.lead AND b.song <> a.song GROUP BY a.song, a.title, a.artist")
def history_of_merged(s, d):
    """Earlier songs of the lead, credits of one song counted once."""
    from tallyspark.operators import history

    m = song_map(s, d)
    named = m.select("song", F.col("song_debut").alias("day"), F.explode(F.array_distinct(F.transform(tx.split_credit("artist"), lambda x: tx.normalize_text(x)))).alias("name")).where("name <> ''").distinct()
    by_day = history.prior_by_day(named, ["name"], "day", {"prior_songs": F.lit(1)})
    t = m.select("song", F.col("song_title").alias("title"), F.col("song_artist").alias("artist"), F.col("song_debut").alias("day")).distinct().withColumn("name", tx.normalize_text(tx.lead_artist("artist")))
    return t.join(by_day, ["name", "day"], "left").select("title", "artist", F.coalesce("prior_songs", F.lit(0)).alias("prior_songs"))


_TEXT = "length(trim(coalesce(plain_lyrics, '')))"


@query(f"""{groups_sql()}, f AS (SELECT song, arg_min(title, (debut_date, title, artist)) AS song_title, arg_min(artist, (debut_date, title, artist)) AS song_artist FROM s GROUP BY 1), lyr AS (SELECT * FROM lyrics QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY lyric_id DESC) = 1),
 j AS (SELECT f.song, song_title, song_artist, lyric_id, lyr.artist AS used, coalesce(match_score, 0) AS score, {_TEXT} AS chars, s.title = song_title AND s.artist = song_artist AND coalesce(match_score, 0) >= 72 AND {_TEXT} > 0 AND NOT coalesce(instrumental, false) AS debut FROM s JOIN f USING (song) JOIN lyr ON lyr.title = s.title AND lyr.artist = s.artist)
 SELECT song_title AS title, song_artist AS artist, lyric_id, used AS lyrics_from_credit FROM j QUALIFY row_number() OVER (PARTITION BY song ORDER BY debut DESC, score DESC, chars DESC, lyric_id) = 1""")
def best_lyrics(s, d):
    """One text per song: that of the debut credit where it is usable, else the best scored, else the longest of its credits."""
    chars = F.length(F.trim(F.coalesce("plain_lyrics", F.lit(""))))
    l = T(s, d, "lyrics").groupBy("title", "artist").agg(F.max_by(F.struct("lyric_id", F.coalesce("match_score", F.lit(0)).alias("score"), chars.alias("chars"), F.coalesce("instrumental", F.lit(False)).alias("instrumental")), "lyric_id").alias("l")).select("title", "artist", "l.*")
    j = song_map(s, d).join(l, ["title", "artist"])
    debut = (F.col("title") == F.col("song_title")) & (F.col("artist") == F.col("song_artist")) & (F.col("score") >= resolve.TRUSTED) & (F.col("chars") > 0) & ~F.col("instrumental")
    best = F.min_by(F.struct("lyric_id", "artist"), F.struct((~debut).alias("a"), (-F.col("score")).alias("b"), (-F.col("chars")).alias("c"), "lyric_id"))
    return j.groupBy("song", "song_title", "song_artist").agg(best.alias("x")).select(F.col("song_title").alias("title"), F.col("song_artist").alias("artist"), "x.lyric_id", F.col("x.artist").alias("lyrics_from_credit"))


def _fuller(s, d) -> DataFrame:
    now = T(s, d, "songs_analysis").select(F.col("song_id").alias("id"), "title", "artist")
    flagged = lengths(s, d).select(F.col("song_id").alias("id"), "chars").join(suspect_short(s, d).where("suspect").select(F.col("song_id").alias("id")), "id")
    cand = T(s, d, "lyrics").select(F.col("lyric_id").alias("cand"), F.col("lrclib_title").alias("title"), F.col("lrclib_artist").alias("artist"), F.col("plain_lyrics").alias("text"), "instrumental")
    return resolve.fuller_version(now.join(flagged, "id"), cand)


@query()
def fuller_versions(s, d):
    """For texts that look cut short: a text of the same song that is at least 1.2 times as long, if there is one."""
    return _fuller(s, d).withColumnsRenamed({"id": "song_id", "cand": "lyric_id"})


@query()
def suspects_after_refetch(s, d):
    """The flags again after fuller texts took the place of the flagged ones, cuts worked out anew."""
    t = lengths(s, d).join(_fuller(s, d).select(F.col("id").alias("song_id"), F.col("chars").cast("long").alias("more")), "song_id", "left")
    t = cut(t.withColumn("replaced", F.col("more").isNotNull()).withColumn("cps", F.coalesce("more", "chars") / F.col("used")))
    q = t.where("primary_genre IS NOT NULL").groupBy("primary_genre").agg(F.percentile("cps", 0.02).alias("q"))
    g = t.agg(F.percentile("cps", 0.02).alias("g"))
    return t.join(q, "primary_genre", "left").crossJoin(F.broadcast(g)).select("song_id", "replaced", F.coalesce(F.col("cps") < F.coalesce("q", "g"), F.lit(False)).alias("suspect"))


@query("SELECT row_id, trim(regexp_replace(lower(artist), '[''’]', '', 'g')) AS act_key, url_encode(coalesce(title, '') || ' ' || coalesce(artist, '')) AS search_text FROM mb_songs")
def search_keys(s, d):
    """An act's name without apostrophes, and the text a search would be asked with."""
    return T(s, d, "mb_songs").select("row_id", tx.act_key("artist").alias("act_key"), tx.search_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("artist", F.lit("")))).alias("search_text"))


@query("SELECT title, artist, round(date_diff('day', min(chart_date), max(chart_date)) / 7.0, 6) AS weeks_between FROM weekly GROUP BY 1, 2")
def weeks_between(s, d):
    """Weeks from first to last chart with their fraction."""
    return T(s, d, "weekly").groupBy("title", "artist").agg(F.round(F.datediff(F.max("chart_date"), F.min("chart_date")) / 7.0, 6).alias("weeks_between"))
