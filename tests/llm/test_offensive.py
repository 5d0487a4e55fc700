"""Held-out judgements, terms in disguise, and the tables it must take."""

import random

from tallyspark.llm import offensive as o

BAD = ["you stupid bitch", "what the fuck are you", "i will cut your throat", "those people are vermin", "moaning under me all night"]
FINE = ["the cock crows on the farm", "i'm killing this beat", "damn the night is cold", "shoot me a message", "my old friend dick drives"]
PLAIN = ["the river runs", "a borrowed fire burns", "home in the morning", "under the bridge we wait", "that blue piano sings"]


def songs(rng, n):
    out = []
    for _ in range(n):
        bad = rng.random() < 0.2
        lines = [f"{rng.choice(PLAIN)} {rng.choice('abcdefgh')}" for _ in range(8)]
        if bad:
            lines[rng.randrange(8)] = rng.choice(BAD) + " " + rng.choice(["tonight", "again", "baby"])
        elif rng.random() < 0.4:
            lines[rng.randrange(8)] = rng.choice(FINE) + " " + rng.choice(["tonight", "again", "baby"])
        out.append(("\n".join(lines), int(bad)))
    return out


def test_terms():
    assert o.terms("Y0u $tupid B!TCH") == ["you", "stupid", "bitch"]
    assert o.terms("f u c k you") == ["fuck", "you"] and o.terms("") == []


def test_held_out():
    rng = random.Random(1)
    rows = songs(rng, 600)
    wrong = [(t, 1 - f) if rng.random() < 0.02 else (t, f) for t, f in rows]
    fm, cut = o.train([t for t, _ in wrong], [f for _, f in wrong])
    test = songs(rng, 400)
    hit = [max(fm.score([o.terms(x) for x in o.lines_of(t)])) > cut for t, _ in test]
    tp = sum(h and f for h, (_, f) in zip(hit, test, strict=True))
    assert tp / sum(hit) > 0.9 and tp / sum(f for _, f in test) > 0.9


def test_tables(spark):
    rng = random.Random(2)
    rows = [(i, t, "s", 1.0) for i, (t, _) in enumerate(songs(rng, 60))] + [(100, None, None, 1.0), (101, "", "s", 1.0), (102, " \n[x]\n", "s", 1.0), (103, "la " * 100_000, "s", 1.0), (0, "the river runs", "s", 1.0)]
    df = spark.createDataFrame(rows, "song_id long, lyrics_clean string, lyrics_source string, score double")
    judged = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 0)], "song_id long, flagged int")
    got = o.score_texts(df, judged).collect()
    by = {r.song_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert by[100].score == by[101].score == 0 and not by[102].offensive and by[100].worst_line is None
    rates = {r.source: r for r in o.rates(df.dropDuplicates(["song_id"]), o.score_texts(df, judged).dropDuplicates(["song_id"])).collect()}
    assert rates[None].songs == 1 and rates["s"].songs == 63
    assert o.score_texts(df.limit(0), judged.limit(0)).count() == 0
