"""Spellings of names typed by people, linked to the act they mean.

Distinct strings only take part, with their counts. MinHash over padded letter pairs of all words but
known titles and given names is banded together with the first letters of all words; bands and rows follow
from the collision curve (see bands_for). Words whose first letter slipped meet through exact keys of the
rest of the word. Inside a bucket a string is compared, by Monge-Elkan similarity with rules for initials,
nicknames, abbreviations and typing slips, only with the centres found so far, most frequent first: the work
is strings times acts, never all pairs. Buckets beyond a size take their strings a chunk at a time, each
chunk's centres being shown to all other strings over many tasks; the edges are those of the bucket taken
at once. Star clustering then hangs every string on its best centre, and hanging stars on stars ends in one
centre per act.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.packed import protected_pattern, split_packed
from tallyspark.session import cut

#: Jaccard similarity of the letter groups of two spellings that must be found with this chance.
SIMILAR, RECALL = 0.45, 0.985
ROWS = 2
#: Letters of a gram.
GRAM = 2
#: Strings of a bucket that one task compares with each other; a larger bucket takes several rounds, with the same edges.
BUCKET = 1000
#: A string at least this frequent, and at least this share of the other, is no typing slip of it.
OFTEN, OFTEN_SHARE = 8, 0.25

#: Short forms of given names. One short form may stand for several names.
NICKNAMES = {
    "alexander": "alex al sandy xander lex", "benjamin": "ben benny benji", "christopher": "chris kit topher", "daniel": "dan danny", "elizabeth": "liz lizzie beth betty eliza betsy lisa",
    "frederick": "fred freddie freddy rick", "gabriela": "gabby gabi gaby", "gabriel": "gabe", "henrietta": "etta hettie hetty henny", "isabella": "izzy bella isa", "joseph": "joe joey jo",
    "katherine": "kate kathy katie kat kit kathie", "leonard": "leo len lenny", "margaret": "maggie meg peggy marge greta madge", "nicholas": "nick nicky nico klaus", "oliver": "ollie olly",
    "patricia": "pat patty trish tricia patti", "robert": "bob rob bobby robbie bert", "susannah": "sue susie suzy susanna susan suzie", "theodore": "ted teddy theo", "victoria": "vicky vicki tori vic",
    "william": "bill will billy willy willie liam", "samuel": "sam sammy", "thomas": "tom tommy", "michael": "mike mick mickey", "james": "jim jimmy jamie", "richard": "rich rick dick", "anthony": "tony",
    "edward": "ed eddie ned ted", "charles": "charlie chuck", "andrew": "andy drew", "matthew": "matt", "jonathan": "jon", "john": "johnny jack", "catherine": "cathy cate", "deborah": "deb debbie",
    "jennifer": "jen jenny", "rebecca": "becky", "stephanie": "steph", "timothy": "tim", "gregory": "greg", "jeffrey": "jeff", "kenneth": "ken kenny", "lawrence": "larry", "peter": "pete", "raymond": "ray", "ronald": "ron ronnie",
}
#: Short forms of titles and of words for groups.
SHORT_FORMS = {
    "professor": "prof", "doctor": "dr doc", "general": "gen genl", "major": "maj", "captain": "capt cap cpt", "saint": "st ste", "sister": "sis sr", "mister": "mr", "missus": "mrs", "lieutenant": "lt", "sergeant": "sgt", "colonel": "col",
    "old": "ol ole", "little": "lil", "young": "", "baby": "", "king": "", "queen": "", "prince": "", "brother": "bro", "father": "fr", "reverend": "rev", "deejay": "dj", "emcee": "mc", "uncle": "unc",
    "quartet": "qtet quart qt", "quintet": "qnt", "sisters": "sis", "brothers": "bros", "philharmonic": "phil", "department": "dept dpt", "company": "co", "association": "assn assoc", "incorporated": "inc", "limited": "ltd",
    "orchestra": "orch", "international": "intl int", "foundation": "fdn found", "society": "soc", "collective": "coll", "ensemble": "ens", "symphony": "sym symph", "experience": "exp", "brigade": "brig bde", "mountain": "mtn mt",
    "street": "st", "family": "fam", "corporation": "corp", "junior": "jr", "senior": "snr", "project": "proj",
}
#: Titles that have no short form.
TITLES = ("tiny", "big", "lady", "lord", "sir", "dame", "miss", "master")
_LONG: dict[str, frozenset[str]] = {t: frozenset({t}) for t in TITLES}
for _full, _short in [*NICKNAMES.items(), *SHORT_FORMS.items()]:
    for _s in _short.split():
        _LONG[_s] = _LONG.get(_s, frozenset()) | {_full}
    _LONG[_full] = _LONG.get(_full, frozenset()) | {_full}


def bands_for(similar: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of so many rows with which 1-(1-s^rows)^bands reaches the recall at similarity s."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similar**rows)))


_EXTRA = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "’": "'", "‘": "'", "`": "'", "´": "'"})


def plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).translate(_EXTRA)


#: A word of a name: its letters, whether a dot cut it short.
Word = tuple[str, bool]


def readings(name: str) -> list[list[Word]]:
    """Ways to read a name as words: a hyphen and an inner capital may join or divide."""
    s = plain(name)
    out: list[list[Word]] = []
    options = [re.sub(r"-", "", s), re.sub(r"-", " ", s)] if "-" in s else [s]
    if re.search(r"[a-z][A-Z]|\b(?:DJ|MC)[A-Z]", s):
        options += [re.sub(r"([a-z]|\b(?:DJ|MC))([A-Z])", r"\1 \2", o) for o in options]
    for o in options:
        words: list[Word] = []
        for m in re.finditer(r"((?:\w\.){2,}|[\w']+)(\.?)", o.casefold().replace("&", " and ").replace("+", " and ")):
            dotted = bool(m.group(2)) or m.group(1).endswith("'")
            w = m.group(1).replace(".", "").replace("'", "").replace("_", "")
            if w and w not in ("the", "and"):
                words.append((w, dotted))
        if words and words not in out:
            out.append(words)
    return out


def slips(a: str, b: str, most: int) -> int:
    """Damerau distance of two words, or most+1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    # only cells near the diagonal can lie on a path of so few slips
    far = most + 1
    two: dict[int, int] = {}
    one: dict[int, int] = {j: min(j, far) for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = _Sparse(far)
        row[0] = min(i, far)
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row[j] = min(v, far)
        two, one = one, row
    return min(one[len(b)], far)


class _Sparse(dict):
    """A row of which only the cells near the diagonal are kept."""

    def __init__(self, far: int):
        super().__init__()
        self.far = far

    def __missing__(self, _: int) -> int:
        return self.far


def squeezed(w: str) -> str:
    """The word without the vowels after its first letter, as in "kng"."""
    return w[:1] + re.sub(r"[aeiou]", "", w[1:])


def _thinned(short: str, long: str) -> bool:
    """Whether short is long without vowels, some of the doubled or later consonants missing too."""
    bones = squeezed(long)
    return squeezed(short) == short and short[0] == long[0] and len(short) >= len(bones) - 1 and all(c in it for it in [iter(bones)] for c in short)


@functools.lru_cache(maxsize=1 << 17)
def letters_of(w: str) -> int:
    """A bit for each letter that stands in the word."""
    out = 0
    for c in w:
        out |= 1 << (ord(c) & 63)
    return out


@functools.lru_cache(maxsize=1 << 17)
def word_similarity(a: Word, b: Word) -> float:
    """1 for the same word, less for a nickname, an abbreviation, a slip or an initial, else 0."""
    x, y = a[0], b[0]
    if x == y:
        return 1.0
    if len(x) == 1 or len(y) == 1:
        if x[0] == y[0]:
            return 0.9
        short, long = (x, y) if len(x) < len(y) else (y, x)
        return 0.88 if any(f[0] == short for f in _LONG.get(long, ())) else 0.0
    fx, fy = _LONG.get(x), _LONG.get(y)
    if fx and fy and fx & fy:
        return 0.97
    if fx and fy and x in fx and y in fy:
        return 0.0
    short, long = (a, b) if len(x) < len(y) else (b, a)
    # a known word written without its vowels, or with the last of a run of consonants only
    if long[0] in _LONG and short[0] not in _LONG and len(short[0]) >= 2 and _thinned(short[0], long[0]):
        return 0.95
    if short[1] and len(short[0]) >= 2 and long[0].startswith(short[0]):
        return 0.95
    if min(len(x), len(y)) < 3 or max(len(x), len(y)) < 4:
        return 0.0
    # two slips change four letters at most
    d = slips(x, y, 2) if (letters_of(x) ^ letters_of(y)).bit_count() <= 4 else 3
    long_n = max(len(x), len(y))
    if d == 1 and (fx is None) != (fy is None):
        return 0.94  # a slip in a known title or given name, of which there are few
    if d == 1 or (d == 2 and long_n >= 9):
        return 1 - 0.08 * d
    # a slip in a nickname or a short form
    for known, other in ((fx, y), (fy, x)):
        if known and any(slips(f, other, 1) == 1 and len(f) > 4 for f in known):
            return 0.85
    return 0.0


def monge_elkan(a: Sequence[Word], b: Sequence[Word]) -> float:
    """Mean, over the words of either side, of the likeness of the best partner on the other; the lesser of both sides."""

    def one(x: Sequence[Word], y: Sequence[Word]) -> float:
        return sum(max((word_similarity(w, v) for v in y), default=0.0) for w in x) / max(1, len(x))

    return min(one(a, b), one(b, a))


def _match(a: Sequence[Word], b: Sequence[Word]) -> float:
    """Monge-Elkan similarity of two readings, verified: every word needs a partner of its own, else 0."""
    if len(a) != len(b):
        return 0.0
    left = list(b)
    loose = 0
    for w in sorted(a, key=lambda x: -len(x[0])):
        best, at = 0.0, -1
        for k, v in enumerate(left):
            s = word_similarity(w, v)
            if s > best:
                best, at = s, k
        if best < 0.8:
            return 0.0
        loose += best < 0.93
        left.pop(at)
    full = any(len(w[0]) > 3 and any(word_similarity(w, v) >= 0.83 for v in b) for w in a)
    return monge_elkan(a, b) if full and loose <= 2 and not (loose == len(a) and loose > 1) else 0.0


def similarity(a: list[list[Word]], b: list[list[Word]]) -> float:
    return max((_match(x, y) for x in a for y in b), default=0.0)


def same_letters(a: list[list[Word]], b: list[list[Word]]) -> bool:
    """Whether the names differ only in case, marks, spacing, order and short forms."""
    return any(_match(x, y) >= 1 - 0.031 for x in a for y in b)


def _h(s: str) -> int:
    return zlib.crc32(s.encode())


def _params(n: int) -> np.ndarray:
    """Seeds of n hash functions."""
    return np.random.default_rng(11).integers(1, 1 << 63, n, dtype=np.uint64)


def _min_hashes(grams: set[str], seeds: np.ndarray) -> np.ndarray:
    """The least hash of the grams under each function, every bit of the hashes well mixed."""
    x = np.array([_h(g) for g in grams], dtype=np.uint64)[:, None] ^ seeds[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).min(axis=0)


def bucket_keys(name: str, bands: int, params: np.ndarray) -> list[str]:
    """Keys of the buckets of a name: for each reading, band by band, with the words' first letters, and
    for each word that may have slipped in its first letter the rest of it with the other words' letters."""
    out: dict[str, None] = {}
    for words in readings(name):
        forms = [[_canonical(w)] for w, _ in words]
        kept = [w for w, _ in words if w not in _LONG and len(w) > 2] or [w for w, _ in words if w not in _LONG and len(w) > 1] or [w for w, _ in words]
        grams = {p[i : i + GRAM] for p in (f"^{w}$" for w in kept) for i in range(len(p) - GRAM + 1)}
        sig = _min_hashes(grams, params)
        letters = "".join(sorted(f[0][0] for f in forms))
        alts = {letters}
        for k, (w, _) in enumerate(words):
            for full in _LONG.get(w, ()):
                alts.add("".join(sorted([*(f[0][0] for i, f in enumerate(forms) if i != k), full[0]])))
        for n in range(bands):
            band = _h(",".join(map(str, sig[n * ROWS : (n + 1) * ROWS])))
            for x in alts:
                out[f"{n}:{x}:{band}"] = None
        for k, (w, _) in enumerate(words):
            if len(w) > 3:
                others = "".join(sorted(f[0][0] for i, f in enumerate(forms) if i != k))
                for rest in first_slips(w):
                    out[f"f:{others}:{rest}"] = None
    return list(out)


def _canonical(w: str) -> str:
    return min(_LONG[w]) if w in _LONG else w


def first_slips(w: str) -> set[str]:
    """What words that differ in a slip at the first letter, and in long words in one more, have in common.

    One slip leaves the rest from the second or third letter on. A second one lies among the last four letters
    or before them, so that either these or four letters near the beginning stay.
    """
    out = {w, w[1:], w[2:]}
    if len(w) >= 8:
        out |= {w[1:5], w[2:6], w[3:7], w[-4:] + "$"}
    return out


class _Star:
    """Star clustering of one bucket as its strings come in, most frequent first."""

    def __init__(self) -> None:
        self.known: dict[str, list[list[Word]]] = {}
        self.seen: dict[tuple[str, str], float] = {}
        self.start()

    def start(self) -> None:
        self.centres: list[tuple[str, int, list[list[Word]]]] = []

    def read(self, name: str) -> list[list[Word]]:
        got = self.known.get(name)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[name] = readings(name)
        return got

    def matches(self, name: str, n: int) -> list[tuple[str, float]]:
        """The centres before the string, more frequent or equally so and less by name, that it matches."""
        got = []
        read = self.read(name)
        for centre, cn, cread in self.centres:
            if (-cn, centre) >= (-n, name):
                continue
            s = self.seen.get((name, centre))
            if s is None:
                s = similarity(read, cread)
                if s and n >= OFTEN and n >= OFTEN_SHARE * cn and not same_letters(read, cread):
                    s = 0.0
                if len(self.seen) > 500_000:
                    self.seen.clear()
                self.seen[(name, centre)] = s
            if s:
                got.append((centre, s))
        return got

    def add(self, name: str, n: int) -> list[tuple[str, float]]:
        """The centres that the string matches; without one it becomes a centre itself."""
        got = self.matches(name, n)
        if not got:
            self.centres.append((name, n, self.read(name)))
        return got


def spelling_edges(names: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(name, centre, similarity) from (name, n): every string with the centres it matched.

    bucket is the number of strings beyond which a bucket takes several rounds; the edges don't depend on it.
    """
    spark = names.sparkSession
    bands = bands_for()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        params = _params(bands * ROWS)
        for pdf in batches:
            out = [(k, x, n) for x, n in zip(pdf["name"], pdf["n"], strict=True) for k in bucket_keys(x, bands, params)]
            if out:
                yield pd.DataFrame(out, columns=["bucket", "name", "n"]).astype({"bucket": object, "name": object})

    # few bytes but slow to handle, so not left to the size of partitions
    rows = names.repartition(parts).mapInPandas(keys, "bucket string, name string, n long").select(F.xxhash64("bucket").alias("b"), "name", "n").distinct()
    rows = cut(rows)
    sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(sizes, "b")
    kind = "name string, centre string, similarity double, b long, n long"

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Edges of whole buckets or chunks; a row without a centre says that the string is one."""
        star, now = _Star(), None
        for pdf in batches:
            out = []
            for b, name, n in zip(pdf["b"], pdf["name"], pdf["n"], strict=True):
                if b != now:
                    star.start()
                    now = b
                out += [(name, c, s, b, n) for c, s in star.add(name, n)] or [(name, None, 0.0, b, n)]
            if out:
                yield pd.DataFrame(out, columns=["name", "centre", "similarity", "b", "n"]).astype({"name": object, "centre": object})

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Edges of strings (role 1) with the centres of a chunk (role 0)."""
        star, now = _Star(), None
        for pdf in batches:
            out = []
            for b, salt, role, name, n in zip(pdf["b"], pdf["salt"], pdf["role"], pdf["name"], pdf["n"], strict=True):
                if (b, salt) != now:
                    star.start()
                    now = (b, salt)
                if role == 0:
                    star.centres.append((name, n, star.read(name)))
                else:
                    out += [(name, c, s, b, n) for c, s in star.matches(name, n)]
            if out:
                yield pd.DataFrame(out, columns=["name", "centre", "similarity", "b", "n"]).astype({"name": object, "centre": object})

    def grouped(df: DataFrame) -> DataFrame:
        return df.select("b", "name", "n").repartition(parts, "b").sortWithinPartitions("b", F.desc("n"), "name").mapInPandas(stars, kind)

    edges = cut(grouped(rows.where(F.col("size") <= bucket))).where("centre IS NOT NULL")
    large = rows.where(F.col("size") > bucket)
    if large.limit(1).count():
        strings = cut(large.withColumn("salt", F.pmod(F.xxhash64("name", "b"), F.ceil(F.col("size") / bucket))).select("b", "salt", "name", "n"))
        salts = strings.select("b", "salt").distinct()
        order = Window.partitionBy("b").orderBy(F.desc("n"), "name")
        left = strings.select("b", "name", "n")
        # chunk by chunk in order: the strings of a chunk among each other, then all others against its centres
        while left.limit(1).count():
            chunk = cut(left.withColumn("at", F.row_number().over(order)).where(F.col("at") <= bucket).drop("at"))
            own = cut(grouped(chunk))
            centres = own.where("centre IS NULL").select("b", "name", "n")
            others = strings.join(chunk.select("b", "name"), ["b", "name"], "left_anti")
            both = centres.join(salts, "b").withColumn("role", F.lit(0)).unionByName(others.withColumn("role", F.lit(1)))
            met = cut(both.repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "role", F.desc("n"), "name").select("b", "salt", "role", "name", "n").mapInPandas(against, kind))
            edges = edges.unionByName(own.where("centre IS NOT NULL")).unionByName(met)
            left = cut(left.join(chunk.select("b", "name"), ["b", "name"], "left_anti").join(met.select("b", "name").distinct(), ["b", "name"], "left_anti"))
    return edges.select("name", "centre", "similarity").groupBy("name", "centre").agg(F.max("similarity").alias("similarity"))


def cluster(names: DataFrame) -> DataFrame:
    """(name, act): every string of (name, n) with the most frequent spelling of its act."""
    names = cut(names)
    edges = spelling_edges(names).join(names.withColumnRenamed("name", "centre").withColumnRenamed("n", "cn"), "centre")
    parent = edges.groupBy("name").agg(F.max_by("centre", F.struct(F.round("similarity", 2), "cn", F.hash("centre"))).alias("act"))
    parent = cut(parent)
    # stars that hang on stars: a centre is always the more frequent spelling, so this ends
    while True:
        up = parent.select(F.col("name").alias("act"), F.col("act").alias("top"))
        new = cut(parent.join(up, "act", "left").select("name", F.coalesce("top", "act").alias("act"), F.col("top").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        parent = new.drop("moved")
        if not moved:
            break
    return names.select("name").join(parent, "name", "left").select("name", F.coalesce("act", "name").alias("act"))


def pairs_of(clusters: DataFrame) -> DataFrame:
    """(name_1, name_2): all pairs of spellings of an act, smaller first by code point.

    The pairs of a large act are made by many tasks: its strings are spread by hash on one side and
    copied on the other, as often as its size asks for.
    """
    sizes = clusters.groupBy("act").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / 400).cast("int"))
    c = clusters.join(sizes, "act")
    left = c.select("act", F.col("name").alias("name_1"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))
    right = c.select("act", F.col("name").alias("name_2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["act", "part"]).where("name_1 < name_2").select("name_1", "name_2")


def recording_acts(column: Column | str, protected: Sequence[str]) -> Column:
    """Acts of a recording credit, where only " feat. " and " & " divide and protected names stay."""
    safe = protected_pattern(protected)
    # protected names also come without their comma
    loose = safe.replace(r"\s*,", r"\s*,?") if safe else ""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        pat = re.compile((rf"(?P<safe>(?<!\w)(?:{loose})(?!\w))|" if loose else "") + r"(?P<cut> feat\. | & )", re.I)

        def one(x: str | None) -> list[str]:
            if not isinstance(x, str):
                return []
            out, at = [], 0
            for m in pat.finditer(x):
                if m.lastgroup == "cut":
                    out.append(x[at : m.start()])
                    at = m.end()
            return [v for v in (p.strip() for p in [*out, x[at:]]) if v]

        return pd.Series([one(x) for x in s], dtype=object)

    return run(F.col(column) if isinstance(column, str) else column)


def act_names(songs: DataFrame, protected: Sequence[str], artist: str = "artist", mb_artist: str = "mb_artist") -> DataFrame:
    """(name, n): the distinct acts of both credit columns and how often each is printed."""
    chart = songs.where(F.col(artist).isNotNull()).groupBy(F.col(artist).alias("c")).agg(F.count(F.lit(1)).alias("k")).select("k", F.explode(split_packed("c", "acts", protected)).alias("name"))
    side = songs.where(F.col(mb_artist).isNotNull()).groupBy(F.col(mb_artist).alias("c")).agg(F.count(F.lit(1)).alias("k")).select("k", F.explode(recording_acts("c", protected)).alias("name"))
    return chart.unionByName(side).groupBy("name").agg(F.sum("k").alias("n"))


def linked_spellings(songs: DataFrame, protected: Sequence[str], artist: str = "artist", mb_artist: str = "mb_artist") -> DataFrame:
    """(name_1, name_2): pairs of different strings that name the same act.

    Null and blank credits give no name; repeated rows only raise a name's count; other columns are
    pruned; ties between centres go to the more frequent spelling, then by hash; an empty table
    gives no pair. A name without any letter or digit stays alone.
    """
    return pairs_of(cut(cluster(act_names(songs, protected, artist, mb_artist))))
