"""Text, credit and genre queries, each with SQL that must agree where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import genres, text as tx
from tallyspark.operators import resolve, voting
from tallyspark.session import read_table as T

#: Credits of one title that a task compares with the lyrics of that title.
BLOCK_PART = 200
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _credit_sql(c: str) -> str:
    s = f"replace(replace(lower({c}), '\"', ''), ')', '')"
    for a, b in tx.ONE_ACT.items():
        s = f"replace({s}, {_quote(a)}, {_quote(b)})"
    for sep in tx.SEPARATORS:
        s = f"replace({s}, {_quote(sep)}, '|')"
    return s


def _squeeze_sql(s: str) -> str:
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


CREDIT_SQL = _credit_sql("artist")
_FEATURE_SQL = " OR ".join(f"contains(lower(artist), {_quote(w)})" for w in tx.FEATURE_WORDS)
# lyric measures, on texts whose letters lower() treats alike everywhere
_CLEAN = "regexp_replace(plain_lyrics, '\\[[^\\]]*\\]', '', 'g')"
_WORDS = f"regexp_replace(lower({_CLEAN}), '[^a-z0-9''\\s]', ' ', 'g')"
_LYRICS = f"SELECT lyric_id, {_WORDS} AS t FROM lyrics WHERE plain_lyrics IS NOT NULL AND NOT coalesce(instrumental, false)"
_LIST = "list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')"
_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"SELECT row_id, artist, CAST(len(p) AS INTEGER) AS n_artists, trim(p[1]) AS lead, ({_FEATURE_SQL}) AS has_feature FROM (SELECT row_id, artist, string_split({CREDIT_SQL}, '|') AS p FROM mb_songs WHERE artist IS NOT NULL)")
def credit_split(s, d):
    """Lead, number of acts and feature mark by ordered plain separators."""
    t = T(s, d, "mb_songs").where("artist IS NOT NULL")
    return t.select("row_id", "artist", F.size(tx.split_credit("artist")).alias("n_artists"), tx.lead_artist("artist").alias("lead"), tx.has_feature("artist").alias("has_feature"))


@query(f"SELECT row_id, pos, name FROM (SELECT row_id, unnest(range(1, len(p) + 1))::INTEGER AS pos, trim(unnest(p)) AS name FROM (SELECT row_id, string_split({CREDIT_SQL}, '|') AS p FROM mb_songs WHERE artist IS NOT NULL)) WHERE name <> ''")
def artist_bridge(s, d):
    """One row per song and named act."""
    t = T(s, d, "mb_songs").where("artist IS NOT NULL")
    return t.select("row_id", F.posexplode(tx.split_credit("artist")).alias("pos", "name")).where("name <> ''").select("row_id", (F.col("pos") + 1).alias("pos"), "name")


@query("SELECT row_id, x AS normal_title FROM (SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(mb_title, '')), '\\([^)]*\\)', ' ', 'g'), '\\bfeat\\.?\\b|\\bfeaturing\\b', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s\\p{Z}]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS x FROM mb_songs)")
def normalized_titles(s, d):
    return T(s, d, "mb_songs").select("row_id", tx.normalize_text("mb_title").alias("normal_title"))


_VERSION = "(?i)\\(\\s*(\\d{4}|[^)]*\\b(" + "|".join(w.replace(" ", "\\s*") for w in tx.VERSION_WORDS) + ")\\b[^)]*)\\s*\\)"


@query(f"SELECT row_id, CASE WHEN regexp_matches(mb_title, '{_VERSION}') THEN lower(mb_title) ELSE trim(regexp_replace(lower(regexp_replace(mb_title, '\\([^)]*\\)', ' ', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g')) END AS key, regexp_matches(mb_title, '{_VERSION}') AS is_version FROM mb_songs")
def title_keys(s, d):
    """Keys of titles, and whether a title names a version."""
    return T(s, d, "mb_songs").select("row_id", tx.title_key("mb_title").alias("key"), tx.is_version("mb_title").alias("is_version"))


@query(f"SELECT lyric_id, nullif(len({_LIST}), 0)::INTEGER AS word_count, round(len(list_distinct({_LIST})) / nullif(len({_LIST}), 0), 9) AS unique_word_ratio, len({_LINES})::INTEGER AS n_lines, round(nullif(len({_LIST}), 0) / nullif(len({_LINES}), 0), 9) AS avg_line_length FROM ({_LYRICS})")
def lyric_measures(s, d):
    """Words, their variety, lines and words per line; null, never 0, where there are no words."""
    t = T(s, d, "lyrics").where(F.col("plain_lyrics").isNotNull() & ~F.coalesce("instrumental", F.lit(False))).select("lyric_id", tx.lyric_text(tx.drop_tags("plain_lyrics")).alias("t"))
    n = F.nullif(F.size(tx.text_lines("t")), F.lit(0))
    return t.select("lyric_id", tx.word_count("t").alias("word_count"), F.round(tx.unique_word_ratio("t"), 9).alias("unique_word_ratio"), F.size(tx.text_lines("t")).alias("n_lines"), F.round(tx.word_count("t") / n, 9).alias("avg_line_length"))


@query(f"SELECT lyric_id, round(CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS DOUBLE) / sum(k), 9) AS repetition_score FROM (SELECT lyric_id, line, count(*) AS k FROM (SELECT lyric_id, unnest({_LINES}) AS line FROM ({_LYRICS})) GROUP BY 1, 2) GROUP BY 1")
def repetition(s, d):
    """Share of a song's lines that occur more than once."""
    t = T(s, d, "lyrics").where(F.col("plain_lyrics").isNotNull() & ~F.coalesce("instrumental", F.lit(False))).select("lyric_id", tx.lyric_text(tx.drop_tags("plain_lyrics")).alias("t"))
    return t.select("lyric_id", F.round(tx.repetition_score("t"), 9).alias("repetition_score")).where("repetition_score IS NOT NULL")


@query(f"SELECT lyric_id, CASE WHEN len({_LIST}) > 0 THEN regexp_matches(t, '(^|\\s)((({'|'.join(tx.STRONG_STARTS)})[^\\s]*)|({'|'.join(tx.STRONG_WORDS)}))(\\s|$)') END AS has_strong_word FROM ({_LYRICS})")
def strong_words(s, d):
    t = T(s, d, "lyrics").where(F.col("plain_lyrics").isNotNull() & ~F.coalesce("instrumental", F.lit(False))).select("lyric_id", tx.lyric_text(tx.drop_tags("plain_lyrics")).alias("t"))
    return t.select("lyric_id", tx.has_strong_word("t").alias("has_strong_word"))


_MARK = "\\s*[(\\[]?\\s*[xX]\\s?(\\d{1,2})\\s*[)\\]]?\\s*$"
_TIMES = f"TRY_CAST(regexp_extract(line, '{_MARK}', 1) AS INTEGER)"
_BODY = f"trim(regexp_replace(line, '{_MARK}', ''))"
_SUNG = f"SELECT lyric_id, i, CASE WHEN {_TIMES} BETWEEN 2 AND 20 AND {_BODY} <> '' THEN {_BODY} ELSE line END AS line, CASE WHEN {_TIMES} BETWEEN 2 AND 20 AND {_BODY} <> '' THEN {_TIMES} ELSE 1 END AS k FROM (SELECT lyric_id, i, l[i] AS line FROM (SELECT lyric_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT lyric_id, string_split(regexp_replace(regexp_replace(plain_lyrics, '\\r\\n?', chr(10), 'g'), '\\[[^\\]]*\\]', '', 'g'), chr(10)) AS l FROM lyrics WHERE plain_lyrics IS NOT NULL)))"


@query(f"SELECT lyric_id, CAST(row_number() OVER (PARTITION BY lyric_id ORDER BY i, j) - 1 AS INTEGER) AS line_no, line FROM (SELECT lyric_id, i, line, unnest(range(k)) AS j FROM ({_SUNG}))")
def repeats_written_out(s, d):
    """Lines marked (x3) and the like, one row per line sung."""
    return T(s, d, "lyrics").where("plain_lyrics IS NOT NULL").select("lyric_id", F.posexplode(tx.expand_repeats(tx.drop_tags(F.regexp_replace("plain_lyrics", "\r\n?", "\n")))).alias("line_no", "line"))


@query("SELECT lyric_id, length(plain_lyrics)::INTEGER AS chars, round(length(plain_lyrics) / duration, 6) AS chars_per_second, CASE WHEN duration BETWEEN 30 AND 600 THEN duration END AS duration_used FROM lyrics WHERE plain_lyrics IS NOT NULL AND duration > 0")
def text_rate(s, d):
    c = F.col("duration")
    return T(s, d, "lyrics").where(F.col("plain_lyrics").isNotNull() & (c > 0)).select("lyric_id", F.length("plain_lyrics").alias("chars"), F.round(F.length("plain_lyrics") / c, 6).alias("chars_per_second"), F.when(c.between(30, 600), c).alias("duration_used"))


@query(f"SELECT token, {genres.broad_genre_sql('token')} AS genre, n FROM (SELECT unnest(string_split(genres, '|')) AS token, count(*) AS n FROM mb_songs GROUP BY 1) WHERE trim(token) <> ''")
def ordered_rule_map(s, d):
    """Labels to broad genres by ordered rules, first match wins."""
    t = T(s, d, "mb_songs").select(F.explode(F.split("genres", r"\|")).alias("token")).where("trim(token) <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.select("token", genres.broad_genre(F.col("token")).alias("genre"), "n")


@query(f"SELECT token, {genres.genre_by_patterns_sql('token')} AS genre, n FROM (SELECT unnest(string_split(genres, '|')) AS token, count(*) AS n FROM mb_songs GROUP BY 1) WHERE trim(token) <> ''")
def ordered_pattern_map(s, d):
    """Labels to broad genres by the earlier rules, which are patterns."""
    t = T(s, d, "mb_songs").select(F.explode(F.split("genres", r"\|")).alias("token")).where("trim(token) <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.select("token", genres.genre_by_patterns(F.col("token")).alias("genre"), "n")


_HIDDEN = "lower(artist)"
_SHOWN = "x"
for _k, _n in enumerate(tx.ONE_ACT):
    _HIDDEN, _SHOWN = f"replace({_HIDDEN}, {_quote(_n)}, '\u00a7{_k}\u00a7')", f"replace({_SHOWN}, '\u00a7{_k}\u00a7', {_quote(_n)})"


@query(f"SELECT row_id, pos, name FROM (SELECT row_id, unnest(range(1, len(p) + 1))::INTEGER AS pos, unnest(p) AS name FROM (SELECT row_id, list_filter(list_transform(string_split_regex({_HIDDEN}, '{tx.CREDIT_PATTERN}'), lambda x: trim({_SHOWN})), lambda x: x <> '') AS p FROM mb_songs WHERE artist IS NOT NULL))")
def protected_split(s, d):
    """Acts of a credit by one pattern, names that hold a separator being hidden meanwhile."""
    t = T(s, d, "mb_songs").where("artist IS NOT NULL").select("row_id", F.posexplode(tx.split_protected("artist")).alias("pos", "name"))
    return t.select("row_id", (F.col("pos") + 1).alias("pos"), "name")


@query("SELECT lyric_id, length(t)::INTEGER AS chars, md5(t) AS digest FROM (SELECT lyric_id, regexp_replace(regexp_replace(regexp_replace(plain_lyrics, '\\[\\d{1,2}:\\d{2}(?:[.:]\\d{1,3})?\\]', '', 'g'), '(?i)\\[(?:ti|ar|al|by|offset|length|re|ve)\\s*:[^\\]]*\\]', '', 'g'), '\\[[^\\]]{0,60}\\]', '', 'g') AS t FROM lyrics WHERE plain_lyrics IS NOT NULL)")
def time_tags_dropped(s, d):
    """Texts without time stamps, file tags and short section labels."""
    t = T(s, d, "lyrics").where("plain_lyrics IS NOT NULL").select("lyric_id", tx.drop_time_tags("plain_lyrics").alias("t"))
    return t.select("lyric_id", F.length("t").alias("chars"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


def votes_sql(src: str, key: str, missing: str = "one") -> str:
    """Votes per broad genre of a table with genres and genre_counts, and the place where each was first seen."""
    weight = "len(l) - i + 1" if missing == "rank" else "1"
    keep = "AND same" if missing == "drop" else ""
    items = "SELECT *, len(l) = len(c) AND NOT list_contains(list_transform(c, lambda y: y IS NULL), true) AS same FROM (SELECT {k}, list_filter(list_transform(string_split(genres, '|'), lambda y: trim(y)), lambda y: y <> '') AS l, coalesce(list_transform(list_filter(list_transform(string_split(genre_counts, '|'), lambda y: trim(y)), lambda y: y <> ''), lambda y: TRY_CAST(y AS INTEGER)), []) AS c FROM {s} WHERE genres IS NOT NULL)".format(k=key, s=src)
    return f"SELECT {key}, {genres.broad_genre_sql('l[i]')} AS genre, CAST(sum(CASE WHEN same THEN c[i] ELSE {weight} END) AS BIGINT) AS votes, min(i) AS seen FROM (SELECT {key}, l, c, same, unnest(range(1, len(l) + 1)) AS i FROM ({items}) WHERE len(l) > 0 {keep}) GROUP BY 1, 2"


_ACTS = "(SELECT DISTINCT ON (artist_mbid) artist_mbid, genres, genre_counts FROM mb_artists)"
_ONE_MBID = "regexp_extract(artist_mbids, '([0-9a-f]{8}-[0-9a-f-]{27})', 1)"


def _won(v: str, key: str) -> str:
    return f"SELECT {key}, list_sort(list(genre)) AS leaders FROM (SELECT *, max(votes) OVER (PARTITION BY {key}) AS top FROM ({v})) WHERE votes = top GROUP BY 1"


def _steps_sql(missing: str, select: str) -> str:
    sv, av = votes_sql("mb_songs", "row_id", missing), votes_sql(_ACTS, "artist_mbid", missing)
    return f"""WITH m AS (SELECT row_id, {_ONE_MBID} AS artist_mbid FROM mb_songs), t AS ({_won(sv, "row_id")}), a AS ({_won(av, "artist_mbid")}), mg AS (SELECT row_id, string_agg(genre, '|' ORDER BY votes DESC, seen, genre) AS multi_genre FROM ({sv}) GROUP BY 1),
 b AS (SELECT row_id, leaders[1] AS tie_genre FROM ({_won(f"SELECT t.row_id, v.genre, v.votes FROM (SELECT row_id, unnest(leaders) AS genre FROM t WHERE len(leaders) > 1) t JOIN m USING (row_id) JOIN ({av}) v ON v.artist_mbid = m.artist_mbid AND v.genre = t.genre WHERE v.votes > 0", "row_id")}) WHERE len(leaders) = 1)
 SELECT m.row_id, {select} FROM m LEFT JOIN t USING (row_id) LEFT JOIN mg USING (row_id) LEFT JOIN b USING (row_id) LEFT JOIN a ON a.artist_mbid = m.artist_mbid"""


def _songs_and_acts(s, d):
    a = T(s, d, "mb_artists").select("artist_mbid", "genres", "genre_counts")
    return T(s, d, "mb_songs").select("row_id", F.regexp_extract("artist_mbids", r"([0-9a-f]{8}-[0-9a-f-]{27})", 1).alias("artist_mbid"), "genres", "genre_counts"), a


@query(f"SELECT row_id, genre, votes FROM ({votes_sql('mb_songs', 'row_id')})")
def token_votes(s, d):
    """Votes per broad genre; labels without counts that line up get one vote each."""
    return voting.label_votes(T(s, d, "mb_songs"), "row_id", "genres", "genre_counts").select("row_id", "genre", "votes")


@query(f"SELECT row_id, genre, votes FROM ({votes_sql('mb_songs', 'row_id', 'drop')})")
def counted_votes(s, d):
    """The same where counts are required."""
    return voting.label_votes(T(s, d, "mb_songs"), "row_id", "genres", "genre_counts", "drop").select("row_id", "genre", "votes")


_TIE = "WHEN len(leaders) = 1 THEN {one} WHEN len(leaders) > 1 AND tie_genre IS NOT NULL THEN {artist} WHEN len(leaders) > 1 THEN {tie}"


@query(_steps_sql("rank", f"CASE {_TIE.replace('len(leaders)', 'len(t.leaders)').format(one='t.leaders[1]', artist='tie_genre', tie=chr(39) + 'tie' + chr(39))} END AS genre, coalesce(multi_genre, '') AS multi_genre, CASE {_TIE.replace('len(leaders)', 'len(t.leaders)').format(one=chr(39) + 'counts' + chr(39), artist=chr(39) + 'artist' + chr(39), tie=chr(39) + 'tie' + chr(39))} ELSE 'none' END AS step"))
def genre_by_rank_votes(s, d):
    """Genre by votes, ranks standing in for missing counts, with the step that decided and all genres."""
    songs, a = _songs_and_acts(s, d)
    return voting.vote_in_steps(songs, a, "row_id", "artist_mbid")


@query(_steps_sql("one", f"CASE {_TIE.format(one='t.leaders[1]', artist='tie_genre', tie=chr(39) + 'mixed' + chr(39)).replace('len(leaders)', 'len(t.leaders)')} WHEN len(a.leaders) = 1 THEN a.leaders[1] WHEN len(a.leaders) > 1 THEN 'mixed' END AS genre, CASE {_TIE.format(one=chr(39) + 'votes' + chr(39), artist=chr(39) + 'artist' + chr(39), tie=chr(39) + 'tie' + chr(39)).replace('len(leaders)', 'len(t.leaders)')} WHEN len(a.leaders) = 1 THEN 'artist only' WHEN len(a.leaders) > 1 THEN 'tie' ELSE 'none' END AS step"))
def genre_vote(s, d):
    """A song's own votes, then its lead's; ties by the lead's votes among the leaders."""
    songs, a = _songs_and_acts(s, d)
    return voting.vote_genre(songs, a, "row_id", "artist_mbid")


@query(_steps_sql("one", "CASE WHEN len(t.leaders) = 1 THEN t.leaders[1] ELSE coalesce(CASE WHEN len(a.leaders) = 1 THEN a.leaders[1] WHEN len(a.leaders) > 1 THEN 'mixed' END, CASE WHEN len(t.leaders) > 1 THEN 'mixed' END) END AS genre"))
def genre_overall(s, d):
    """A song's winner, or else its act's own overall winner."""
    songs, a = _songs_and_acts(s, d)
    return voting.vote_overall(songs, a, "row_id", "artist_mbid")


@query("SELECT row_id, " + ", ".join(f"list_contains(list_transform(string_split(genres, '|'), lambda y: trim(y)), '{g}') AS is_{g.replace('-', '_').replace(' ', '_')}" for g in ("pop", "hip hop", "k-pop", "folk")) + " FROM mb_songs WHERE genres IS NOT NULL")
def label_flags(s, d):
    """One-hot flags from a multi-label list."""
    l = tx.labels("genres")
    return T(s, d, "mb_songs").where("genres IS NOT NULL").select("row_id", *(F.array_contains(l, g).alias("is_" + g.replace("-", "_").replace(" ", "_")) for g in ("pop", "hip hop", "k-pop", "folk")))


@query()
def fuzzy_match_score(s, d):
    """Score of every recording against its chart credit, with the penalty for other renditions."""
    t = T(s, d, "mb_songs").where("mb_title IS NOT NULL")
    return t.select("row_id", resolve.match_score(F.col("title"), F.col("artist"), F.col("mb_title"), F.col("mb_artist"), tx.non_original("mb_title")).alias("score"), resolve.artist_similarity(F.col("mb_artist"), F.col("artist")).alias("artist_score"))


@query()
def best_match_cascade(s, d):
    """Lyrics for each song: by full credit, else by lead act, else by title and a similar artist."""
    songs = T(s, d, "songs_analysis").select("song_id", "title", "artist")
    l = T(s, d, "lyrics").select(F.col("lyric_id").alias("cand"), "lrclib_title", "lrclib_artist", "plain_lyrics", "instrumental")
    # every credit of a title meets every other once; those of a busy title are spread over tasks
    ours = songs.select("title", "artist", tx.normalize_text("title").alias("block"), tx.normalize_text(tx.lead_artist("artist")).alias("lead")).where("block <> ''").distinct()
    parts = ours.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PART).cast("int").alias("parts"))
    theirs = l.select("lrclib_title", "lrclib_artist", tx.normalize_text("lrclib_title").alias("block")).where("block <> ''").distinct()
    theirs = theirs.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    ours = ours.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("title", "artist"), F.col("parts")).cast("int"))
    full = resolve.token_sort_ratio(tx.normalize_text("artist"), tx.normalize_text("lrclib_artist"))
    lead = resolve.token_sort_ratio(F.col("lead"), tx.normalize_text("lrclib_artist"))
    pairs = ours.join(theirs, ["block", "part"]).withColumns({"full_score": full, "lead_score": lead, "artist_score": resolve.artist_similarity(F.col("lrclib_artist"), F.col("artist"))})
    pairs = pairs.withColumn("stage", F.when(F.col("full_score") >= 90, 1).when(F.col("lead_score") >= 90, 2).when(F.col("artist_score") >= resolve.TITLE_ONLY_FLOOR, 3)).where("stage IS NOT NULL")
    pairs = pairs.withColumn("score", resolve.match_score(F.col("title"), F.col("artist"), F.col("lrclib_title"), F.col("lrclib_artist")))
    pairs = pairs.select(F.col("title").alias("t"), F.col("artist").alias("a"), F.col("lrclib_title").alias("lt"), F.col("lrclib_artist").alias("la"), "full_score", "stage", "score")
    j = songs.join(pairs, F.col("title").eqNullSafe(F.col("t")) & F.col("artist").eqNullSafe(F.col("a")))
    j = j.join(l, F.col("lt").eqNullSafe(F.col("lrclib_title")) & F.col("la").eqNullSafe(F.col("lrclib_artist")))
    best = resolve.best_of_cascade(j, ["song_id"], text="plain_lyrics", instrumental="instrumental")
    return best.select("song_id", "cand", "stage", "score")


@query("""SELECT lyric_id, CASE WHEN coalesce(match_method = 'none', false) THEN 'unmatched' WHEN coalesce(match_score < 90, true) THEN 'score<90' WHEN coalesce(trim(plain_lyrics), '') = '' OR lower(trim(plain_lyrics)) = 'nan' THEN 'no lyrics' WHEN coalesce(contains(lower(artist), 'feauring'), false) THEN 'separator variant' WHEN coalesce(match_rules_version < 4, true) AND coalesce(contains(artist, '&'), false) THEN 'old splitter' END AS reason FROM lyrics""")
def retry_reasons(s, d):
    """Why a row should be fetched again, first reason first."""
    c = F.col
    stale = F.coalesce(c("match_rules_version") < 4, F.lit(True)) & F.coalesce(c("artist").contains("&"), F.lit(False))
    reason = resolve.retry_reason(c("match_method"), c("match_score"), c("plain_lyrics"), F.lit(100), F.contains(F.lower("artist"), F.lit("feauring")), stale)
    return T(s, d, "lyrics").select("lyric_id", reason.alias("reason"))


@query("SELECT title, artist, arg_max(lyric_id, (length(plain_lyrics), -lyric_id)) AS lyric_id, max(length(plain_lyrics))::INTEGER AS chars FROM lyrics WHERE match_score >= 72 AND plain_lyrics IS NOT NULL GROUP BY 1, 2")
def fullest_text(s, d):
    """The longest trusted text of each credit."""
    return T(s, d, "lyrics").where((F.col("match_score") >= 72) & F.col("plain_lyrics").isNotNull()).groupBy("title", "artist").agg(F.max_by("lyric_id", F.struct(F.length("plain_lyrics"), -F.col("lyric_id"))).alias("lyric_id"), F.max(F.length("plain_lyrics")).alias("chars"))


@query("SELECT match_method, count(*) AS n, count(*) FILTER (match_score >= 72) AS trusted, count(plain_lyrics) AS with_text, round(avg(match_score), 6) AS mean_score FROM lyrics GROUP BY 1")
def match_quality(s, d):
    return T(s, d, "lyrics").groupBy("match_method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("match_score") >= 72).alias("trusted"), F.count("plain_lyrics").alias("with_text"), F.round(F.avg("match_score"), 6).alias("mean_score"))


@query("""WITH c AS (SELECT lower(artist) AS credit, count(*) AS n FROM mb_songs WHERE artist IS NOT NULL GROUP BY 1), p AS (SELECT credit, n, unnest(string_split_regex(credit, '\\s*[,&]\\s*')) AS part FROM c WHERE regexp_matches(credit, '[,&]') AND NOT regexp_matches(credit, '(feat|with | x |;|/|\\(|")'))
 SELECT credit, n FROM (SELECT p.credit, p.n, sum(coalesce(a.n, 0)) AS alone FROM p LEFT JOIN c a ON a.credit = p.part WHERE p.part <> '' GROUP BY 1, 2) WHERE n >= 2 AND alone = 0""")
def protected_by_data(s, d):
    """Names with a separator that the data show to be one act: the whole name leads credits, its parts never do."""
    c = T(s, d, "mb_songs").where("artist IS NOT NULL").groupBy(F.lower("artist").alias("credit")).agg(F.count(F.lit(1)).alias("n"))
    whole = c.where(F.col("credit").rlike(r"[,&]") & ~F.col("credit").rlike(r"(feat|with | x |;|/|\(|\")"))
    parts = whole.select("credit", "n", F.explode(F.split("credit", r"\s*[,&]\s*")).alias("part")).where("part <> ''")
    leads = c.select(F.col("credit").alias("part"), F.col("n").alias("alone"))
    return parts.join(leads, "part", "left").groupBy("credit", "n").agg(F.sum(F.coalesce("alone", F.lit(0))).alias("parts_alone")).where("n >= 2 AND parts_alone = 0").select("credit", "n")


@query("SELECT p_partkey, count(*) FILTER (t <> '') AS words, string_agg(t, ' ' ORDER BY t) AS sorted_words FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS t FROM part) GROUP BY 1")
def sorted_words(s, d):
    w = F.split(F.lower("p_name"), " ")
    return T(s, d, "part").select("p_partkey", F.size(F.filter(w, lambda x: x != "")).cast("long").alias("words"), F.array_join(F.array_sort(w), " ").alias("sorted_words"))
