"""The leak search against a brute-force alignment, and the cases it defines."""

import random

from tallyspark.llm import leakage as L

WORDS = [f"w{i}" for i in range(60)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def found(doc, text):
    ix = L.PassageIndex([(1, " ".join(text))])
    return bool(ix.search([ix.vocab.get(w, 0) for w in doc]))


def test_against_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        p = passage(rng, rng.randint(12, 30))
        k = rng.randint(6, min(20, len(p)))
        at = rng.randint(0, len(p) - k)
        part = p[at : at + k]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(1, len(part) - 1)
            part[i : i + 1] = rng.choice([["zz"], [], [part[i], "zz"]])
        doc = ["q"] * rng.randint(0, 5) + part + ["r"] * rng.randint(0, 5)
        plain = L.brute_leaks(doc, p)
        got = found(doc, p)
        if got and not plain:  # some words may have passed for a notice
            plain = any(L.brute_leaks(doc[:a] + doc[a + k :], p) for k in (1, 2, 3) for a in range(6, len(doc)))
        # an edit at the very edge of a stretch counts for brute force only
        assert got <= plain, (doc, p)
        if plain and not got:
            inner = [w for w in part if w in set(p)]
            assert len(inner) < 13, (doc, p)


def test_alterations():
    p = [f"a{i}" for i in range(40)]
    notice = "this text continues after a short word from us".split()
    assert found(p[:12], p) and not found(p[:11], p)
    assert found(p[5:11] + ["x"] + p[12:18], p)  # changed
    assert found(p[5:11] + ["x"] + p[11:17], p)  # added
    assert found(p[5:11] + p[12:18], p)  # dropped
    assert found(p[5:11] + notice + p[11:17], p)  # interrupted
    assert not found(p[5:11] + notice + p[11:14] + notice + p[14:17], p)  # twice
    assert not found(p[0:4] + ["x"] + p[5:8] + ["x"] + p[9:12], p)  # too many changes
    assert not found(list(reversed(p)), p)


def test_alterations_side_by_side():
    p = [f"a{i}" for i in range(40)]
    notice = "this text continues after a short word from us".split()
    assert found(p[5:12] + ["x", "y"] + p[14:21], p)  # two changed
    assert found(p[5:12] + p[14:21], p)  # two dropped
    assert found(p[5:13] + ["x", "y"] + p[13:21], p)  # two added
    assert found(p[5:11] + ["x"] + notice + p[12:18], p) and found(p[5:11] + notice + ["x"] + p[12:18], p)  # changed beside the notice
    assert found(p[5:11] + notice + p[12:18], p)  # dropped beside the notice
    assert not found(p[5:11] + ["x", "y"] + p[13:18], p)  # two in thirteen
    assert not found(p[5:11] + notice + p[11:16] + ["x"], p)  # an edit is no end


def test_finds_all_with_firm_ends():
    """Alterations inside a stretch are all found, wherever they stand."""
    rng = random.Random(8)
    p = [f"a{i}" for i in range(40)]
    for _ in range(300):
        n = rng.randint(12, 23)
        part = [[w] for w in p[7 : 7 + n]]
        for _ in range(n // L.ONE_IN):
            i = rng.randrange(1, n - 1)
            if part[i] == [p[7 + i]]:
                part[i] = rng.choice([["zz"], [], [p[7 + i], "zz"]])
        if rng.random() < 0.5:
            part.insert(rng.randrange(3, n - 2), ["notice"] * rng.randint(1, L.NOTICE))
        doc = [w for x in part for w in x]
        assert found(doc, p), doc


def test_sketch_is_exact():
    assert L.least_intact() >= 1
    assert L.expected_candidates(9, L.sketch_size(9, L.least_intact()), L.least_intact()) == 0.0


def test_words():
    assert L.words("Thé Cat’s “hat”—IN​side  it's_so") == ["the", "cats", "hat", "inside", "its", "so"]
    assert L.words(None) == [] and L.words("") == []


def test_table(spark):
    p = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x y. {p.upper()}! {p}", "q"), (2, None, "q"), (3, "", "q"), (4, "z " * 200_000 + p, "q"), (1, p, "q")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, p, None), (8, "too short", "i"), (9, None, None), (7, p, None)], "item_id long, passage string, text string")
    got = sorted(map(tuple, L.leaked_items(docs, items).collect()))
    assert set(got) == {(1, 7), (4, 7)}
    assert L.leaked_items(docs, items.limit(0)).count() == 0 and L.leaked_items(docs.limit(0), items).count() == 0


def test_two_alterations_and_a_notice():
    """Passages of sixteen words with two alterations and a notice: whatever the alignment accepts, the sketch brings up."""
    rng = random.Random(12)
    tried = 0
    for _ in range(2500):
        p = [f"b{i}" for i in range(16)]
        part = [[w] for w in p]
        for i in rng.sample(range(1, 15), 2):
            part[i] = rng.choice([["zz"], [], [p[i], "zz"]])
        part.insert(rng.randrange(2, 15), ["notice"] * rng.randint(1, 9))
        doc = [w for x in part for w in x]
        ids = {w: i + 1 for i, w in enumerate(p)}
        d = [ids.get(w, 0) for w in doc]
        seeds = [(i, j) for i in range(len(d)) for j in range(16) if d[i] == j + 1]
        if L.leaks(d, list(range(1, 17)), seeds):
            tried += 1
            assert found(doc, p), doc
    assert tried > 1500


def test_item_ids_of_other_types(spark):
    p = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, p)], "doc_id int, text string")
    for kind, x in (("int", 7), ("string", "x"), ("short", 3)):
        got = L.leaked_items(docs, spark.createDataFrame([(x, p)], f"item_id {kind}, passage string"))
        assert [tuple(r) for r in got.collect()] == [(1, x)] and got.schema["item_id"].dataType.simpleString() == {"short": "smallint"}.get(kind, kind)
