"""Labels mapped to broad genres by ordered rules, first match wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: keywords of the broad genres ------------------------------------------------
LATIN = ["latin", "latino", "latina", "reggaeton", "regueton", "salsa", "bachata", "cumbia", "corrido", "corridos", "banda", "mariachi", "tejano", "merengue", "dembow", "norteño", "norteno", "ranchera", "mexican", "mexicano", "bolero", "flamenco", "samba", "bossa", "brazilian", "brasileiro", "brasileira", "carioca", "ostentação", "brega", "sertanejo", "español", "espanol", "portuguese"]
COUNTRY = ["country", "bluegrass", "americana", "honky", "nashville", "urban cowboy"]
SOUL = ["soul", "r&b", "rnb"]
HIP_HOP = ["hip hop", "hiphop", "rap", "trap", "drill", "grime", "crunk", "boom bap", "bounce", "hyphy", "dirty south", "rage", "plugg", "horrorcore", "ratchet"]
FUNK = ["funk", "funky", "funktronica", "motown", "new jack swing", "quiet storm", "doo wop"]
ROCK = ["rock", "punk", "metal", "grunge", "indie", "alternative", "emo", "shoegaze", "blackgaze", "britpop", "new wave", "psychedelia"]
DANCE = ["electronic", "electronica", "electro", "edm", "house", "techno", "trance", "dubstep", "dance", "disco", "club", "rave", "drum and bass", "dnb", "bass", "synthwave", "eurodance", "hardstyle", "garage", "trip hop", "complextro", "downtempo", "leftfield", "indietronica", "jungle", "ambient", "tronica", "breakbeat", "moombahton", "brostep", "ebm", "hardcore"]
# ----------------------------------------------------------------------------------------------
#: (kind of test, keywords or text, genre), in order.
RULES: tuple[tuple[str, object, str], ...] = (
    ("contains", "dancehall", "other"),
    ("keyword", LATIN, "Latin"),
    ("keyword", COUNTRY, "country"),
    ("ends", "pop", "pop"),
    ("keyword", SOUL, "R&B"),
    ("keyword", HIP_HOP, "hip-hop/rap"),
    ("keyword", FUNK, "R&B"),
    ("keyword", ROCK, "rock/alternative"),
    ("keyword", DANCE, "dance/electronic"),
    ("keyword", ["pop"], "pop"),
)


def has_keyword(label: Column, keywords: Sequence[str]) -> Column:
    """Whether a keyword is a whole word of the label, or a phrase in it; hyphens count as blanks."""
    s = F.replace(label, F.lit("-"), F.lit(" "))
    out = F.arrays_overlap(F.split(s, r"\s+"), F.array(*(F.lit(k) for k in keywords if " " not in k)))
    for k in (k for k in keywords if " " in k):
        out = out | F.contains(s, F.lit(k))
    return out


def broad_genre(label: Column) -> Column:
    """Broad genre of one label; null stays null."""
    s = F.trim(F.lower(label))
    out = None
    for kind, what, genre in RULES:
        test = {"contains": lambda w: F.contains(s, F.lit(w)), "ends": lambda w: F.endswith(s, F.lit(w)), "keyword": lambda w: has_keyword(s, w)}[kind](what)
        out = F.when(test, genre) if out is None else out.when(test, genre)
    return F.when(label.isNotNull(), out.otherwise("other"))


def broad_genre_sql(c: str) -> str:
    """The same rules as an SQL expression on column c, for checks."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    s = f"trim(lower({c}))"
    h = f"replace({s}, '-', ' ')"

    def test(kind: str, what: object) -> str:
        if kind == "contains":
            return f"contains({s}, {quote(what)})"
        if kind == "ends":
            return f"ends_with({s}, {quote(what)})"
        one = ", ".join(quote(k) for k in what if " " not in k)
        more = "".join(f" OR contains({h}, {quote(k)})" for k in what if " " in k)
        return f"(list_has_any(string_split_regex({h}, '\\s+'), [{one}]){more})"

    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {test(k, w)} THEN {quote(g)}" for k, w, g in RULES) + " ELSE 'other' END"


# --- Fixed values: patterns of the broad genres in the earlier rules -------------------------------
PATTERNS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("other", (r"\bdancehall\b",)),
    ("Latin", (r"\blatin", r"\breggaeton\b", r"\bregueton\b", r"\bsalsa\b", r"\bbachata\b", r"\bcumbia\b", r"\bcorrido", r"\bbanda\b", r"\bmariachi\b", r"\btejano\b", r"\bmerengue\b", r"\bdembow\b", r"\bnorte(n|ñ)o\b", r"\branchera\b", r"\bmexican\b", r"\bbolero\b", r"\bflamenco\b", r"\bsamba\b", r"\bbossa\b", r"\bbrazil", r"\bbrasil", r"\bcarioca\b", r"\bostenta", r"\bbrega\b", r"\bsertanejo\b", r"\bespa(n|ñ)ol", r"\bportugu")),
    ("country", (r"\bcountry\b", r"\bbluegrass\b", r"\bamericana\b", r"\bhonky\b", r"\bnashville\b", r"\burban cowboy\b")),
    ("pop", (r"pop$",)),
    ("R&B", (r"\bsoul\b", r"\br&b\b", r"\brnb\b")),
    ("hip-hop/rap", (r"\bhip[\s-]?hop\b", r"\brap\b", r"\btrap\b", r"\bdrill\b", r"\bgrime\b", r"\bcrunk\b", r"\bboom bap\b", r"\bbounce\b", r"\bhyphy\b", r"\bdirty south\b", r"\brage\b", r"\bplugg\b", r"\bhorrorcore\b", r"\bratchet\b")),
    ("R&B", (r"\bfunk", r"\bmotown\b", r"\bnew jack swing\b", r"\bquiet storm\b", r"\bdoo[\s-]?wop\b")),
    ("rock/alternative", (r"\brock\b", r"\bpunk\b", r"\bmetal\b", r"\bgrunge\b", r"\bindie\b", r"\balternative\b", r"\bemo\b", r"\bgaze\b", r"\bbritpop\b", r"\bnew wave\b", r"\bpsychedelia\b", r"\bblackgaze\b")),
    ("dance/electronic", (r"\belectronic", r"\belectro\b", r"\belectro[\s-]", r"\bedm\b", r"\bhouse\b", r"\btechno\b", r"\btrance\b", r"\bdubstep\b", r"\bdance\b", r"\bdisco\b", r"\bclub\b", r"\brave\b", r"\bdrum and bass\b", r"\bdnb\b", r"\bfuture bass\b", r"\bsynthwave\b", r"\beurodance\b", r"\bhardstyle\b", r"\bbass\b", r"\bgarage\b", r"\btrip hop\b", r"\bcomplextro\b", r"\bdowntempo\b", r"\bleftfield\b", r"\bindietronica\b", r"\bjungle\b", r"\bambient\b", r"\btronica\b", r"\bbreakbeat\b", r"\bmoombahton\b", r"\bbrostep\b", r"\bebm\b", r"\bhardcore\b")),
    ("pop", (r"\bpop\b",)),
)
# ----------------------------------------------------------------------------------------------


def genre_by_patterns(label: Column) -> Column:
    """Broad genre of one label by the patterns, first match wins; null stays null."""
    s = F.trim(F.lower(label))
    out = None
    for genre, patterns in PATTERNS:
        test = s.rlike("|".join(patterns))
        out = F.when(test, genre) if out is None else out.when(test, genre)
    return F.when(label.isNotNull(), out.otherwise("other"))


def genre_by_patterns_sql(c: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(trim(lower({c})), '{'|'.join(p)}') THEN '{g}'" for g, p in PATTERNS)
    return f"CASE WHEN {c} IS NULL THEN NULL {rules} ELSE 'other' END"
