"""String functions as Column expressions; all are null-safe and run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: words and separators of credits, versions and lyrics ------------------------
#: Names that hold a separator but are one act, and how they are written while a credit is split.
ONE_ACT = {"lil nas x": "lil nas-x", "sam & dave": "sam and dave", "sonny & cher": "sonny and cher"}
#: Separators of a credit, longer phrases first.
SEPARATORS = (" a duet with ", " duet with ", " featuring ", " feauring ", " featauring ", " feat. ", " feat ", " ft. ", " with ", " w/ ", " vs. ", " vs ", " introducing ", " presents ", " x ", " & ", ", ", ": ", " (")
CREDIT_PATTERN = r" ?(?:,|&|;|/| featuring | feat\.? | ft\. | with | x ) ?"
FEATURE_WORDS = ("featuring", "feauring", "featauring", "feat.", "ft.")
VERSION_WORDS = ("version", "remix", "interlude", "poem", "live", "acoustic", "remaster", "remastered", "edit", "mix", "demo", "instrumental", "reprise", "radio", "extended", "sped up", "slowed")
#: Strong words that also count as beginnings, and words that count only whole.
STRONG_STARTS = ("fuck", "shit", "bitch", "nigga", "nigger", "cunt", "pussy", "motherfuck", "mothafuck", "asshole", "bastard", "whore", "slut")
STRONG_WORDS = ("dick", "dicks", "cock", "hoe", "hoes")
HOLIDAY_WORDS = ("christmas", "xmas", "santa", "holiday", "jingle", "sleigh", "rudolph", "frosty", "mistletoe", "noel", "navidad", "auld lang syne", "winter wonderland", "silent night", "drummer boy", "deck the halls", "let it snow", "snowman", "hanukkah", "new year", "grinch", "scrooge", "wonderful time")
NON_ORIGINAL = ("karaoke", "tribute", "instrumental", "made popular by", "originally performed")
# ----------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell_text(c: Column | str) -> Column:
    """Trimmed text; null and the text "nan" give ""."""
    t = F.trim(_col(c))
    return F.coalesce(F.when(F.lower(t) == "nan", "").otherwise(t), F.lit(""))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def normalize_text(c: Column | str) -> Column:
    """Lower case without brackets, "feat." and punctuation, blanks squeezed; null gives ""."""
    s = F.lower(_col(c))
    s = F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"(?U)\bfeat\.?\b|\bfeaturing\b", " ")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    return F.coalesce(squeeze(s), F.lit(""))


def credit_line(c: Column | str) -> Column:
    """A credit with every separator turned into "|", one-act names kept whole."""
    s = F.lower(_col(c))
    for sign in ('"', ")"):
        s = F.replace(s, F.lit(sign), F.lit(""))
    for a, b in ONE_ACT.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    for sep in SEPARATORS:
        s = F.replace(s, F.lit(sep), F.lit("|"))
    return s


def split_credit(c: Column | str) -> Column:
    """Names of a credit in order, pieces that are empty included, as the counts need them."""
    return F.transform(F.split(credit_line(c), r"\|"), lambda x: F.trim(x))


def lead_artist(c: Column | str) -> Column:
    return F.element_at(split_credit(c), 1)


def has_feature(c: Column | str) -> Column:
    s = F.lower(_col(c))
    out = F.lit(False)
    for w in FEATURE_WORDS:
        out = out | F.contains(s, F.lit(w))
    return out


def title_key(c: Column | str) -> Column:
    """Title without its bracket, unless the bracket marks another version or a year."""
    t = _col(c)
    words = "|".join(w.replace(" ", r"\s*") for w in VERSION_WORDS)
    marked = t.rlike(rf"(?i)\(\s*(\d{{4}}|[^)]*\b({words})\b[^)]*)\s*\)")
    return F.when(marked, F.lower(t)).otherwise(squeeze(F.lower(F.regexp_replace(t, r"\([^)]*\)", " "))))


def is_version(c: Column | str) -> Column:
    words = "|".join(w.replace(" ", r"\s*") for w in VERSION_WORDS)
    return _col(c).rlike(rf"(?i)\(\s*(\d{{4}}|[^)]*\b({words})\b[^)]*)\s*\)")


def labels(c: Column | str, sep: str = r"\|") -> Column:
    """Packed labels, trimmed, empties dropped; null gives []."""
    return F.coalesce(F.filter(F.transform(F.split(_col(c), sep), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def counts(c: Column | str, sep: str = r"\|") -> Column:
    """Packed whole numbers, or [] if any piece is none."""
    a = F.transform(labels(c, sep), lambda x: x.try_cast("int"))
    return F.when(F.exists(a, lambda x: x.isNull()), F.array().cast("array<int>")).otherwise(a)


def drop_tags(c: Column | str) -> Column:
    """Text without anything from "[" to the next "]", across lines too."""
    return F.regexp_replace(_col(c), r"\[[^\]]*\]", "")


def drop_time_tags(c: Column | str) -> Column:
    """Text without time stamps, tags of the file and labels of sections of at most 60 signs; longer brackets stay."""
    out = _col(c)
    for pattern in (r"\[\d{1,2}:\d{2}(?:[.:]\d{1,3})?\]", r"(?i)\[(?:ti|ar|al|by|offset|length|re|ve)\s*:[^\]]*\]", r"\[[^\]]{0,60}\]"):
        out = F.regexp_replace(out, pattern, "")
    return out


def split_protected(c: Column | str, names: Sequence[str] = tuple(ONE_ACT)) -> Column:
    """Acts of a credit by one pattern, listed names being hidden behind placeholders while it is split."""
    s = F.lower(_col(c))
    for k, n in enumerate(names):
        s = F.replace(s, F.lit(n), F.lit(f"\u00a7{k}\u00a7"))

    def back(x: Column) -> Column:
        for k, n in enumerate(names):
            x = F.replace(x, F.lit(f"\u00a7{k}\u00a7"), F.lit(n))
        return F.trim(x)

    return F.filter(F.transform(F.split(s, CREDIT_PATTERN), back), lambda x: x != "")


def lyric_text(c: Column | str) -> Column:
    """Lower case; every sign but a-z, 0-9, apostrophe and blanks becomes a blank."""
    return F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9'\s]", " ")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """Number of words; null when there is none."""
    return F.nullif(F.size(words(c)), F.lit(0))


def unique_word_ratio(c: Column | str) -> Column:
    w = words(c)
    return F.size(F.array_distinct(w)) / word_count(c)


def text_lines(c: Column | str) -> Column:
    """Lines with blanks squeezed, empty ones dropped."""
    return F.filter(F.transform(F.split(_col(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def repetition_score(c: Column | str) -> Column:
    """Share of lines whose text occurs more than once; null without lines.

    One pass over the sorted lines, in which equal ones stand together: the second of a run counts
    two, each later one counts one.
    """
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("again"), F.lit(0).alias("n"))

    def step(t: Column, x: Column) -> Column:
        same = t["last"].eqNullSafe(x)
        return F.struct(
            x.alias("last"),
            F.when(same, t["run"] + 1).otherwise(1).alias("run"),
            (t["again"] + F.when(same & (t["run"] == 1), 2).when(same, 1).otherwise(0)).alias("again"),
            (t["n"] + 1).alias("n"),
        )

    return F.aggregate(F.array_sort(text_lines(c)), start, step, lambda t: t["again"] / F.nullif(t["n"], F.lit(0)))


def has_strong_word(c: Column | str, starts: Sequence[str] = STRONG_STARTS, whole: Sequence[str] = STRONG_WORDS) -> Column:
    """Whether a word begins or is as listed; null when there is no word."""
    pattern = rf"(^|\s)(({'|'.join(starts)})[^\s]*|({'|'.join(whole)}))(\s|$)"
    return F.when(F.size(words(c)) > 0, _col(c).rlike(pattern))


def expand_repeats(c: Column | str) -> Column:
    """Lines with "(x3)" and the like written out so many times, 2 to 20."""
    mark = r"\s*[(\[]?\s*[xX]\s?(\d{1,2})\s*[)\]]?\s*$"

    def one(line: Column) -> Column:
        n = F.regexp_extract(line, mark, 1).try_cast("int")
        body = F.trim(F.regexp_replace(line, mark, ""))
        return F.when(n.between(2, 20) & (body != ""), F.array_repeat(body, n)).otherwise(F.array(line))

    return F.flatten(F.transform(F.split(_col(c), "\n"), one))


def holiday_title(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"(?iU)\b(" + "|".join(HOLIDAY_WORDS) + r")\b"), F.lit(False))


def non_original(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike("(?i)" + "|".join(NON_ORIGINAL)), F.lit(False))


def build_credit(parts: Column) -> Column:
    """One credit line from an array of (name, joinphrase) structs."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.coalesce(p["joinphrase"], F.lit("")))), "")


def full_date(c: Column | str) -> Column:
    """The date if the text is a whole one, else null."""
    return F.try_to_date(F.when(_col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), _col(c)), "yyyy-MM-dd")


def bands(c: Column | str, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Right-closed bands (a, b]; outside or null gives null."""
    v = _col(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, name in zip(edges, edges[1:], names, strict=False):
        out = out.when((v > lo) & (v <= hi), name)
    return out


def season_year(d: Column | str) -> Column:
    """The winter a day belongs to: December counts for its year, January for the year before."""
    return F.when(F.month(d) == 12, F.year(d)).when(F.month(d) == 1, F.year(d) - 1)


def act_key(c: Column | str) -> Column:
    """A name without apostrophes of either kind."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "['’]", ""))


def search_text(c: Column | str) -> Column:
    """Text as it goes into an address, blanks as %20."""
    return F.regexp_replace(F.url_encode(_col(c)), r"\+", "%20")
