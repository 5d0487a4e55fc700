"""Limits that are planted are found, with the counts of texts cut there; endings decide the rest."""

import random

import numpy as np
import pandas as pd

from tallyspark.llm import truncated as t

STARTS = "the river|a borrowed fire|every train|our old radio|my father|that blue piano|the kitchen light|silver fish".split("|")
ENDS = "runs beyond the hill|sings without a sound|comes home in the morning|waits under the bridge|fell into the water|burns for another year".split("|")


def song(rng, lines):
    return "\n".join(f"{rng.choice(STARTS)} {rng.choice(ENDS)}" for _ in range(lines))


def test_limits_found():
    rng = np.random.default_rng(3)
    x = rng.lognormal(6.7, 0.5, 3000).astype(int)
    cut = x > 1000
    x[cut & (rng.random(3000) < 0.5)] = 1000
    h = pd.Series(x).value_counts().rename_axis("length").reset_index(name="n")
    got = t.fit_limits(h)
    assert got["length"].tolist() == [1000] and abs(got["mu"][0] - 6.7) < 0.1
    none = t.fit_limits(pd.Series(rng.lognormal(6.7, 0.5, 3000).astype(int)).value_counts().rename_axis("length").reset_index(name="n"))
    assert none.empty


def test_cases(spark):
    rng = random.Random(2)
    rows, cut = [], set()
    for i in range(600):
        s = song(rng, rng.randint(6, 20))
        source = "limited" if i % 3 == 0 else "free"
        if source == "limited" and len(s) > 400 and rng.random() < 0.8:
            s = s[:400]
            cut.add(i)
        elif i % 20 == 1:
            s = s[: len(s) - rng.randint(6, 9)] + rng.choice(["", "…", "-", " [...]"])
            cut.add(i)
        elif i % 20 == 2:
            s += rng.choice(["...", " -", "\nOoh", "\n[Fade out]", " (x2)", "!"])
        rows.append((i, s, source, "c"))
    rows += [(1000, None, "free", "c"), (1001, "", "free", "c"), (1002, " \n ", None, "c"), (1003, "[Chorus]", None, "c"), (1004, "la " * 50_000, None, "c")]
    df = spark.createDataFrame(rows, "lyric_id long, plain_lyrics string, fetch_source string, text string")
    scored = t.score_cuts(df).collect()
    assert len(scored) == len(rows)
    got = {r.lyric_id for r in scored if r.is_cut and r.lyric_id < 1000}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(got)
    assert not {r.lyric_id for r in scored if r.is_cut} & {1000, 1001, 1002, 1003}
    rates = {r.source: r.rate for r in t.cut_rates(t.score_cuts(df)).collect()}
    assert rates["limited"] > 0.2 > rates["free"]


def test_empty(spark):
    df = spark.createDataFrame([], "lyric_id long, plain_lyrics string, fetch_source string")
    assert t.score_cuts(df).count() == 0 and t.cut_rates(t.score_cuts(df)).count() == 0
