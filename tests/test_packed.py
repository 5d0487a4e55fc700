"""Packed fields: the machine against a plain reading, sign by sign, and the cases it must define."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.operators.packed import explode_packed, split_acts, split_ids, split_labels

SAFE = ("Duck, Drake & Hen", "Low, The Tide", "Ann & The Lights")


@pytest.mark.parametrize(
    "text,want",
    [
        ("A One Featuring B Two", ["A One", "B Two"]),
        ("A One Feauring B Two & C Three", ["A One", "B Two", "C Three"]),
        ("A One (feat. B Two & C Three)", ["A One", "B Two", "C Three"]),
        ("A One (with B Two), D", ["A One", "B Two", "D"]),
        ("Duck, Drake & Hen X Bo", ["Duck, Drake & Hen", "Bo"]),
        ("duck, drake and hen & Bo", ["duck, drake and hen", "Bo"]),
        ('"Low, The Tide" / Bo', ["Low, The Tide", "Bo"]),
        ("Grover, Jr. & Al", ["Grover, Jr.", "Al"]),
        ('"Grover, Jr.", Al', ["Grover, Jr.", "Al"]),
        ("Sylvia (r&b) vs. Al", ["Sylvia (r&b)", "Al"]),
        ("Malcolm X", ["Malcolm X"]),
        ("Malcolm X Featuring Al", ["Malcolm X", "Al"]),
        ("Malcolm X X Al x Bo", ["Malcolm X", "Al", "Bo"]),
        ("Al & Malcolm X, Bo", ["Al", "Malcolm X", "Bo"]),
        ("Dan + Shay and Al", ["Dan + Shay and Al"]),
        ("A  & B &C", ["A", "B", "C"]),
        ("A &", ["A"]),
        ("A One Ft B", ["A One", "B"]),
        ("A, A & A", ["A", "A", "A"]),
        ('The "Big" One & B', ['The "Big" One', "B"]),
        ('"A & B', ['A', 'B']),
        ("   ", []),
        ("", []),
        (None, []),
        ("With Love", ["With Love"]),
    ],
)
def test_acts(text, want):
    assert split_acts(text, SAFE) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("a|b|c", ["a", "b", "c"]),
        ("|a||b|", ["a", "b"]),
        ('"folk, world & country";pop', ["folk, world & country", "pop"]),
        ("['a', 'b c']", ["a", "b c"]),
        ('["a","b"]', ["a", "b"]),
        ("a / b / c", ["a", "b", "c"]),
        ("singer/songwriter,drum & bass", ["singer/songwriter", "drum & bass"]),
        ("a\tb\nc", ["a", "b", "c"]),
        ("children's, pop", ["children's", "pop"]),
        ('a,"b ""c"" d",e', ["a", 'b "c" d', "e"]),
        ('a,"b \\" c",e', ["a", 'b " c', "e"]),
        ('a,"open, b', ["a", '"open', "b"]),
        ("a, b; c | d", ["a", "b", "c", "d"]),
        ("[]", []),
        ("", []),
        (None, []),
        ("pop|pop", ["pop", "pop"]),
    ],
)
def test_labels(text, want):
    assert split_labels(text) == want


def test_ids():
    assert split_ids("x1; x2 | x3\nx4,x5") == ["x1", "x2", "x3", "x4", "x5"]
    assert split_ids("['x1', 'x2']") == ["x1", "x2"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc &-", min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=5), st.sampled_from(["|", ";", ",", "\t", " | ", "; ", " / "]), st.booleans())
def test_labels_round_trip(items, sep, quoted):
    packed = sep.join(f'"{x}"' if quoted else x for x in items)
    assert split_labels(packed) == items


def plain_reading(text):
    """Labels sign by sign, without escapes: the slow way."""
    out, cur, quoted = [], "", False
    for i, c in enumerate(text):
        if quoted:
            if c == '"':
                quoted = False
            else:
                cur += c
        elif c == '"' and not cur.strip() and '"' in text[i + 1 :]:
            quoted = True
            cur = ""
        elif c in "|;,\t\n\r":
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [x.strip() for x in [*out, cur] if x.strip()]


@settings(max_examples=500, deadline=None)
@given(st.text('ab,;| "', max_size=14).filter(lambda s: '""' not in s))
def test_labels_against_plain_reading(text):
    assert split_labels(text) == plain_reading(text.strip())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_never_fails(text):
    assert all(x.strip() for x in split_acts(text, SAFE)) and all(x.strip() for x in split_labels(text))


def test_explode(spark):
    df = spark.createDataFrame([(1, "A & B", "x|y", None, "q"), (1, "A & B", "x|y", None, "q"), (2, None, "", "i1", "q"), (3, "A" * 100_000 + ", B", " ", "i1|i1", "q")], "row_id long, artist string, genres string, artist_mbids string, item string")
    got = explode_packed(df, "row_id", {"artist": "acts", "genres": "labels", "artist_mbids": "ids"}).collect()
    rows = sorted((r.row_id, r.field_name, r.item_no, r.item[:3]) for r in got)
    assert rows.count((1, "artist", 2, "B")) == 2
    assert (2, "artist_mbids", 1, "i1") in rows and (3, "artist", 1, "AAA") in rows and (3, "artist_mbids", 2, "i1") in rows
    assert not [r for r in rows if r[0] == 3 and r[1] == "genres"]
    assert explode_packed(df.limit(0), "row_id", {"artist": "acts"}).count() == 0
