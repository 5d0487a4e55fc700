"""Joins with promises, history, components, statistics, votes, cascades: against plain versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import components, contracts, history, model, resolve, stats, voting

DAY = dt.date(2020, 1, 1)


def test_checked_join(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    r = spark.createDataFrame([(1, "x"), (None, "n")], "k int, w string")
    got = {(x.v, x.w, x.m) for x in contracts.checked_join(l, r, ["k"], indicator="m").collect()}
    assert got == {("a", "x", "both"), ("b", None, "left_only"), ("c", None, "left_only")}
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(l, r.union(r), ["k"])


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert {(r.column_name, r.missing, r.share) for r in contracts.null_profile(df).collect()} == {("a", 1, 0.5), ("b", 2, 1.0)}


def test_strict_history_three_ways(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), DAY + dt.timedelta(rng.randint(0, 20)), rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, day date, hit boolean")
    got = history.strict_prior(df, ["k"], "day", {"n": F.count(F.lit(1)), "h": F.count_if("hit")}).collect()
    plain = {i: (sum(1 for r in rows if r[1] == k and r[2] < d), sum(1 for r in rows if r[1] == k and r[2] < d and r[3])) for i, k, d, _ in rows}
    assert {r.id: (r.n or 0, r.h or 0) for r in got} == plain
    by_day = {(r.k, r.day): (r.n, r.h) for r in history.prior_by_day(df, ["k"], "day", {"n": F.lit(1), "h": F.col("hit").cast("int")}).collect()}
    assert all(by_day[(k, d)] == plain[i] for i, k, d, _ in rows)
    known = history.known_events(df.drop("hit"), df.where("hit").select("k", "day"), ["k"], "day", "known").collect()
    assert {r.id: r.known for r in known} == {i: p[1] for i, p in plain.items()}


@pytest.mark.parametrize("n,edges", [(60, 40), (300, 160), (40, 0)])
def test_components(spark, n, edges):
    rng = random.Random(n)
    e = [(rng.randrange(n), rng.randrange(n)) for _ in range(edges)] + ([(i, i + 1) for i in range(20)] if edges else []) + [(3, 3)] * bool(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*e, (None, 1)] if e else [], "a long, b long")
    got = {r.id: r.component for r in components.connected_components(df).collect()}
    want = {x: find(x) for x in parent}
    assert got == want


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    got = {r.i: r.s for r in stats.running_sum(spark.createDataFrame(rows, "i int, v int").repartition(7), ["i"], {"s": "v"}).collect()}
    total, want = 0, {}
    for i, v in sorted(rows):
        total += v
        want[i] = total
    assert got == want


def test_published_tests(spark):
    """Counts whose statistics are known: 126 of 800 against 309 of 3,422, with the correction."""
    rows = [("in", True)] * 126 + [("in", False)] * 674 + [("out", True)] * 309 + [("out", False)] * 3113
    r = stats.with_p(stats.chi_square(spark.createDataFrame(rows, "o string, hit boolean"), "o", "hit")).first()
    assert r.n == 4222 and r.dof == 1 and round(r.chi2, 2) == 30.96 and round(r.cramers_v, 4) == 0.0856 and math.isclose(r.p, 2.63e-8, rel_tol=0.01)
    assert stats.chi_square(spark.createDataFrame([("a", True)], "o string, hit boolean"), "o", "hit").first().chi2 is None


def test_chi2_tail():
    assert math.isclose(stats.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.chi2_tail(15.50731305586545, 8), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.chi2_tail(89.0, 8), 7.4e-16, rel_tol=0.05)
    assert stats.chi2_tail(0, 3) == 1


def test_mann_whitney(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(0, 8)), rng.random() < 0.4) for _ in range(120)] + [(None, True), (1.0, None)]
    r = stats.mann_whitney(spark.createDataFrame(rows, "v double, g boolean"), "v", "g").first()
    a, b = [v for v, g in rows if g and v is not None], [v for v, g in rows if g is False]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.n1 == len(a) and math.isclose(r.u, u) and math.isclose(r.rank_biserial, 2 * u / len(a) / len(b) - 1)
    assert stats.mann_whitney(spark.createDataFrame([], "v double, g boolean"), "v", "g").first().u is None


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_token_sort():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert resolve.common_subsequence(a, b) == lcs(a, b)
    assert resolve.token_sort("new york mets", "mets york new") == 100 and resolve.token_sort("", "") == 0 and resolve.token_sort(None, "a") == 0


def test_cascade_joined_and_typed_names(spark, tmp_path):
    """A candidate that passes a stage's threshold counts even if its credit shares no whole word."""
    from tallyspark.plans import texts

    songs = [(1, "Faded Quilt", "LilSimpbansimp"), (2, "Midnight Jacket", "Kathy Falflutthkrurr"), (3, "Other", "Bo Zornfeld"), (4, "Faded Quilt", "Cy Polmarket"), (5, None, "Bo Zornfeld")]
    lyrics = [(10, "Faded Quilt", "Lil Simpbansimp", "la", False), (11, "Midnight Jacket", "Katherine Falfluthkrurr", "la", False), (12, "Other", "Ann Kulkevtaz", "la", False), (13, "Faded Quilt", None, "la", False)]
    spark.createDataFrame(songs, "song_id long, title string, artist string").write.parquet(f"{tmp_path}/songs_analysis.parquet")
    spark.createDataFrame(lyrics, "lyric_id long, lrclib_title string, lrclib_artist string, plain_lyrics string, instrumental boolean").write.parquet(f"{tmp_path}/lyrics.parquet")
    assert {(r.song_id, r.cand) for r in texts.best_match_cascade(spark, str(tmp_path)).collect()} == {(1, 10), (2, 11)}


def test_cascade(spark):
    rows = [(1, 2, 1, 80, 80, None, True), (1, 2, 2, 75, 70, "words", False), (1, 3, 3, 99, 99, "words", False), (2, 1, 4, 50, 50, None, True), (2, 2, 5, 60, 50, None, True), (3, 1, 7, 80, 90, "b", False), (3, 1, 6, 80, 90, "a", False)]
    df = spark.createDataFrame(rows, "id int, stage int, cand int, score int, full_score int, text string, instrumental boolean")
    got = {r.id: r.cand for r in resolve.best_of_cascade(df, ["id"], text="text", instrumental="instrumental").collect()}
    # words of the first stage that has them; a fallback without words comes from the first stage; ties by id
    assert got == {1: 2, 2: 4, 3: 6}


def test_merge(spark):
    d = lambda n: DAY + dt.timedelta(7 * n)
    rows = [(1, "Song", "A", [0, 1]), (2, "Song (Do It)", "A Featuring B", [3, 4]), (3, "Song", "A & C", [1, 2]), (4, "Song (Interlude)", "A", [6]), (5, "Other", "A", [3]), (6, "Song", "A", [30])]
    df = spark.createDataFrame([(i, t, a, d(w[0]), d(w[-1]), 5, [d(x) for x in w]) for i, t, a, w in rows], "id long, title string, artist string, debut_date date, last_date date, peak_position int, weeks array<date>")
    pairs = {(r.a, r.b) for r in resolve.merge_pairs(df).collect()}
    assert pairs == {(1, 2), (2, 3)}  # 1 and 3 share a week, 4 is a version, 6 is too late
    songs = {r.song: r for r in resolve.reduce_groups(df, resolve.merge_groups(df)).collect()}
    assert songs[1].weeks_on_chart == 5 and songs[1].final_artist == "A Featuring B" and songs[4].merged_from is None


def test_votes(spark):
    songs = spark.createDataFrame([(1, "m1", "pop|hip hop", "1|3"), (2, "m1", "pop|hip hop", "2|2"), (3, "m2", None, None), (4, "m3", None, None), (5, "m3", "pop|rock", "x|1")], "id int, m string, genres string, genre_counts string")
    acts = spark.createDataFrame([("m1", "pop", "4"), ("m2", "house|trap", "5|1"), ("m2", "house|trap", "5|1")], "m string, genres string, genre_counts string")
    got = {r.id: (r.genre, r.step) for r in voting.vote_genre(songs, acts, "id", "m").collect()}
    assert got == {1: ("hip-hop/rap", "votes"), 2: ("pop", "artist"), 3: ("dance/electronic", "artist only"), 4: (None, "none"), 5: ("mixed", "tie")}


def test_model_against_a_plain_solver(spark):
    """The distributed fit reaches the weights that plain gradient descent on the same loss does."""
    import numpy as np

    rng = np.random.default_rng(4)
    m = np.column_stack([rng.normal(size=(300, 3)), np.ones(300)])
    y = (rng.random(300) < 1 / (1 + np.exp(-m @ [1.0, -0.5, 0.2, -0.3]))).astype(float)
    got = model.newton(spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(m, y, strict=True)], "x array<double>, y double").repartition(5), "x", "y", 4)
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.005 * (m.T @ (1 / (1 + np.exp(-m @ w)) - y) + w)
    assert np.allclose(got, w, atol=1e-5)


def test_cascade_ties_by_date(spark):
    rows = [(1, 1, 1, 90, 90, "2020-01-01"), (1, 1, 2, 90, 90, "1999"), (1, 1, 3, 90, 90, None), (2, 1, 5, 80, 80, ""), (2, 1, 6, 80, 80, None)]
    df = spark.createDataFrame(rows, "id int, stage int, cand int, score int, full_score int, released string")
    assert {r.id: r.cand for r in resolve.best_of_cascade(df, ["id"], date="released").collect()} == {1: 2, 2: 5}


def test_renamed_acts_and_listed_pairs(spark):
    d = lambda n: DAY + dt.timedelta(7 * n)
    rows = [(1, "Song", "Kanye West", [0, 1]), (2, "Song", "Ye", [3]), (3, "Special", "SZA", [0]), (4, "Special", "Lizzo Featuring SZA", [2]), (5, "Tune", "A Featuring B", [0]), (6, "Tune", "B", [2]), (7, "Tune", "B & A", [4])]
    df = spark.createDataFrame([(i, t, a, d(w[0]), d(w[-1]), 5, [d(x) for x in w]) for i, t, a, w in rows], "id long, title string, artist string, debut_date date, last_date date, peak_position int, weeks array<date>")
    pairs = lambda **k: {(r.a, r.b) for r in resolve.merge_pairs(df, **k).collect()}
    assert pairs() == {(1, 2), (5, 6), (6, 7), (5, 7)}
    assert pairs(renamed=(), two_songs=()) == {(3, 4), (5, 6), (6, 7), (5, 7)}
    assert pairs(mutual_lead=True) == {(6, 7), (5, 7)}


def test_fuller_version(spark):
    now = spark.createDataFrame([(1, "Song", "Ann Kulkev", 10), (2, "Song", "Bo Zorn", 10), (3, None, "Bo Zorn", 1)], "id int, title string, artist string, chars int")
    cand = spark.createDataFrame([(7, "song (live)", "ann kulkev", "x" * 11, False), (8, "Song", "Ann Kulkev", "x" * 12, False), (9, "Song", "Ann Kulkev", "x" * 30, True), (10, "Song", "Someone Else", "x" * 40, False), (11, None, None, None, None)], "cand int, title string, artist string, text string, instrumental boolean")
    assert [tuple(r) for r in resolve.fuller_version(now, cand).collect()] == [(1, 8, 12)]


def test_votes_in_steps(spark):
    songs = spark.createDataFrame([(1, "m1", "pop|rock", None), (2, "m1", "pop|rock", "1|1"), (3, "m2", "pop|rock", "1|1"), (4, "m2", None, None)], "id int, m string, genres string, genre_counts string")
    acts = spark.createDataFrame([("m1", "rock", "2"), ("m2", "house", "3")], "m string, genres string, genre_counts string")
    got = {r.id: (r.genre, r.multi_genre, r.step) for r in voting.vote_in_steps(songs, acts, "id", "m").collect()}
    assert got == {1: ("pop", "pop|rock/alternative", "counts"), 2: ("rock/alternative", "pop|rock/alternative", "artist"), 3: ("tie", "pop|rock/alternative", "tie"), 4: (None, "", "none")}
    assert {r.id: r.genre for r in voting.vote_overall(songs, acts, "id", "m").collect()} == {1: "rock/alternative", 2: "rock/alternative", 3: "dance/electronic", 4: "dance/electronic"}
    assert {r.id for r in voting.label_votes(songs, "id", "genres", "genre_counts", "drop").collect()} == {2, 3}


def test_components_that_do_not_settle(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.connected_components(df, max_rounds=1)


def test_model(spark):
    rng = random.Random(5)
    rows = [(i, "train" if i < 300 else "test", x := rng.gauss(0, 1), rng.gauss(0, 1) if i % 7 else None, x + rng.gauss(0, 0.5) > 0.3) for i in range(400)]
    pred, weights = model.fit_predict(spark.createDataFrame(rows, "id int, split string, x double, y double, hit boolean"), "split", "hit", ["x", "y"], ["id"])
    r = model.precision_recall(pred).first()
    assert r.precision > 0.75 and r.recall > 0.7 and dict(weights)["x"] > 1 > abs(dict(weights)["y"])
