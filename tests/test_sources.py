"""Files, the search source and streams: what is written comes back, failures leave the old."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import files, schemas, search
from tallyspark.streaming import charts


def test_archive(spark, tmp_path):
    week = [{"date": "2020-01-04", "data": [{"song": "A", "artist": "B", "this_week": 1}, {"song": "C", "artist": "D", "this_week": None}]}, {"date": "bad", "data": []}, {"date": "2020-01-11", "data": []}]
    p = tmp_path / "all.json"
    p.write_text(json.dumps(week))
    assert [(r.chart_date, r.title, r.this_week) for r in files.read_archive(spark, str(p)).collect()] == [(dt.date(2020, 1, 4), "A", 1)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line one\nsays "hi", twice'), (2, None), (3, "é")], "id int, text string")
    files.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "id INT, text STRING").collect()} == {tuple(r) for r in df.collect()}
    (tmp_path / "bad.csv").write_text("id,text\n1,a\nx,b\n")
    assert files.read_csv(spark, str(tmp_path / "bad.csv"), "id INT, text STRING", "skip").count() == 1
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "bad.csv"), "id INT, text STRING").collect()


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.replace_table(a, p)
    files.append_batch(files.pending(spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), files.read_current(spark, p), ["k"]), p)
    now = files.read_current(spark, p)
    files.replace_table(files.upsert(now, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"]), p)
    assert {tuple(r) for r in files.read_current(spark, p).collect()} == {(1, "z"), (2, "b"), (3, "c")}
    got = files.load_columns(spark, p, ["k", "v", "nothing"], ["k"], [F.col("v")])
    assert got.columns == ["k", "v"] and got.count() == 3


def test_retries():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert search.with_retries(flaky, 5, 2.0, pauses.append) == "ok" and pauses == [2.0, 4.0]

    def absent():
        raise search.NotFound

    assert search.with_retries(absent, 5, 2.0, pauses.append) is None
    with pytest.raises(OSError):
        search.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0, pauses.append)


def test_search(spark, tmp_path):
    r = {"id": "r1", "title": "T", "artist-credit": [{"name": "A", "joinphrase": " & ", "artist": {"id": "a1"}}, {"name": "B", "joinphrase": "", "artist": {"id": "b1"}}], "genres": [{"name": "pop", "count": 1}, {"name": "rock", "count": 4}], "releases": [{"date": "2020-05", "release-group": {"id": "g", "primary-type": "Single"}}, {"date": "2019-01-01", "release-group": {"id": "h", "primary-type": "Album"}}, {"date": ""}]}
    (tmp_path / "r.json").write_text(json.dumps({"q1": [r, {"id": "r2", "title": "U", "tags": [{"name": "x", "count": 2}]}]}))
    rows = search.song_rows(search.search(spark, ["q1", "q2"], str(tmp_path / "r.json"), parts="2")).orderBy("rank").collect()
    assert len(rows) == 2
    assert (rows[0].mb_artist, rows[0].genres, rows[0].genre_counts, rows[0].artist_mbids, rows[0].first_release_date, rows[0].release_type) == ("A & B", "rock|pop", "4|1", "a1|b1", "2019-01-01", "Album")
    assert rows[1].genre_source == "tags" and rows[1].genres == "x"


def test_stream_is_resumable(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "k int, at timestamp"
    row = lambda k: (k, dt.datetime(2020, 1, k))
    spark.createDataFrame([row(1), row(2), row(2)], schema).write.parquet(src)
    charts.append_new(charts.landed(spark, src, schema), ["k"], "at", "1000 days", out, ck).awaitTermination()
    spark.createDataFrame([row(2), row(3)], schema).write.mode("append").parquet(src)
    charts.append_new(charts.landed(spark, src, schema), ["k"], "at", "1000 days", out, ck).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_upsert_stream(spark, tmp_path):
    """Of each key the latest row stays, whichever batch brings it; a batch tried again changes nothing."""
    src, table, ck = (str(tmp_path / x) for x in ("src", "table", "ck"))
    kind = "k int, at int, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (3, 1, "x"), (3, 2, "y")], kind).write.parquet(src)
    charts.keep_latest(charts.landed(spark, src, kind), ["k"], "at", table, ck, parts=3).awaitTermination()
    spark.createDataFrame([(2, 6, "c"), (1, 0, "late")], kind).write.mode("append").parquet(src)
    want = {(1, 1, "a"), (2, 6, "c"), (3, 2, "y")}
    for again in (ck, ck + "2"):  # the second has forgotten what it saw
        charts.keep_latest(charts.landed(spark, src, kind), ["k"], "at", table, again, parts=3).awaitTermination()
        assert {(r.k, r.at, r.v) for r in charts.read_latest(spark, table, parts=3).collect()} == want


def test_replace_survives_a_crash(spark, tmp_path):
    """A version without its pointer was never finished: the old one holds, and the next replacement goes on."""
    p = str(tmp_path / "t")
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert not files.table_exists(spark, p)
    files.replace_table(one(1), p)
    one(99).write.parquet(f"{p}/v-000000002")  # written, but the writer died before the pointer
    assert files.read_current(spark, p).first().v == 1
    for k in (2, 3, 4):
        files.replace_table(files.read_current(spark, p).selectExpr("v + 1 AS v"), p)
        assert files.read_current(spark, p).first().v == k


def fake_client():
    """A client as a user would hand in, found by its name on the executors."""
    calls = {}

    def ask(q):
        calls[q] = calls.get(q, 0) + 1
        if q == "slow" and calls[q] == 1:
            raise OSError("try again")
        if q == "gone":
            raise search.NotFound
        return [{"id": q.upper()}]

    return ask


def test_search_with_a_client(spark):
    """A client that is handed in by module and name is asked, with another try after an error."""
    import sys
    import types

    mod = types.ModuleType("client_for_tests")
    mod.make = fake_client
    sys.modules["client_for_tests"] = mod
    reader = search.SearchReader({"queries": '["a", "slow", "gone"]', "client": "client_for_tests:make", "backoff": "0"})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert rows == [("a", 0, '{"id": "A"}'), ("slow", 0, '{"id": "SLOW"}')]


def test_artist_rows_and_group_genres(spark):
    import json

    act = {"id": "a1", "name": "Ann", "type": "Person", "country": "US", "gender": "female", "life-span": {"begin": "1970-06"}, "genres": [{"name": "pop", "count": 1}, {"name": "rock", "count": 4}], "tags": []}
    r = search.artist_rows(spark.createDataFrame([("q", 0, json.dumps(act))], "query string, rank int, response string")).first()
    assert (r.artist_mbid, r.artist_name, r.country, r.begin_date, r.genres, r.genre_counts, r.tags) == ("a1", "Ann", "US", "1970-06", "rock|pop", "4|1", "")
    rec = {"id": "r1", "title": "T", "genres": [], "tags": [], "artist-credit": [], "releases": [{"date": "2019", "release-group": {"id": "g1", "primary-type": "Album"}}]}
    groups = spark.createDataFrame([("g1", "folk", "3")], "group_id string, genres string, genre_counts string")
    row = search.song_rows(spark.createDataFrame([("q", 0, json.dumps(rec))], "query string, rank int, response string"), groups).first()
    assert (row.genres, row.genre_counts, row.genre_source) == ("folk", "3", "release-group")


def test_schemas_parse(spark):
    for s in (schemas.ARCHIVE, schemas.WEEKLY, schemas.LYRICS, schemas.RECORDINGS, schemas.ARTISTS, schemas.RECORDING_RESPONSE):
        assert spark.createDataFrame([], s).count() == 0


def test_command_line(spark, tmp_path):
    """Work lists in shares and with retries, through the command line."""
    from tallyspark import cli

    d = str(tmp_path / "data")
    spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x"), (None, "x")], "title string, artist string").withColumn("chart_date", F.lit("2020-01-04").cast("date")).write.parquet(f"{d}/weekly.parquet")
    spark.createDataFrame([("A", "x", 95, "la"), ("B", "x", 50, "la")], "title string, artist string, match_score int, plain_lyrics string").write.parquet(f"{d}/lyrics.parquet")

    def run(*args):
        out = str(tmp_path / ("out" + "-".join(args).replace("/", "_")))
        assert cli.main(["work", "lyrics", d, out, *args]) == 0
        return {(r.title, r.reason) for r in spark.read.parquet(out).collect()}

    assert run() == {("C", "new")} and run("--retry") == {("B", "score"), ("C", "new")} and run("--retry", "--limit", "1") == {("B", "score")}
    assert run("--retry", "--part", "1/2") | run("--retry", "--part", "2/2") == {("B", "score"), ("C", "new")}
