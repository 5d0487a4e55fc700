"""Fields that hold several values: one row per value, with its place in the field.

A lexer cuts a field into classes of text (quotes, brackets, delimiters, joining words, plain
text) and a finite-state machine walks over the classes. Its state is (quoted?, bracket kind,
depth, text so far); a delimiter ends a value only outside quotes and outside brackets that
belong to a name. The Python part handles Arrow batches; rows never meet, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words that join acts in a credit line.
JOIN_WORDS = ("featuring", "feat.", "feat", "ft.", "ft", "duet with", "with", "vs.", "vs", "versus")
#: Name suffixes that a comma does not cut off.
SUFFIXES = ("Jr.", "Jr")


def _slips(word: str) -> set[str]:
    """The word with one letter left out, doubled or swapped with the next one."""
    out = set()
    for i in range(1, len(word)):
        out |= {word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]}
    return {w for w in out if w[0] == word[0] and len(w) >= len(word) - 1} - {word}


_JOINERS = "|".join(re.escape(w).replace("\\ ", r"\s+") for w in sorted([*JOIN_WORDS, *_slips("featuring")], key=lambda w: (-len(w), w)))


def protected_pattern(names: Iterable[str]) -> str:
    """A pattern for names never divided, typed with any spacing and with &, and or + alike."""
    parts = []
    for name in sorted({n for n in names if n and n.strip()}, key=lambda n: (-len(n), n)):
        words = re.findall(r"[^\s,&]+|,|&", name.strip())
        pat = ""
        for w in words:
            if w == ",":
                pat += r"\s*,"
            elif w == "&":
                pat += r"\s*(?:&|\+|\band\b)"
            else:
                pat += (r"\s*" if pat else "") + re.escape(w)
        parts.append(pat)
    return "|".join(parts)


@functools.lru_cache(maxsize=16)
def _act_lexer(protected: tuple[str, ...]) -> re.Pattern[str]:
    safe = protected_pattern(protected)
    rules = [
        *([rf"(?P<safe>(?<!\w)(?:{safe})(?!\w))"] if safe else []),
        rf"(?P<suffix>,\s*(?:{'|'.join(map(re.escape, SUFFIXES))})(?!\w))",
        rf"(?P<guest>[(\[]\s*(?:{_JOINERS})\s+)",
        r"(?P<open>[(\[])",
        r"(?P<close>[)\]])",
        r'(?P<quote>["“”])',
        rf"(?P<word>(?<=\s)(?:{_JOINERS})(?=\s))",
        r"(?P<x>(?<=[\s\"])x(?=[\s\"]|$|[,;)\]]))",
        r"(?P<sign>[,;|]|(?<=\s)[&/]|(?:(?<=\")&)|&(?=\s)|(?<=\s)/(?=\s))",
    ]
    return re.compile("|".join(rules), re.I)


_LABEL_LEXER = re.compile(r"(?P<sign>[|;,\t\n\r]|(?<=\s)/(?=\s))|(?P<quote>[\"'“”])|(?P<escape>\\.)|(?P<open>\[)|(?P<close>\])")
_ID_LEXER = re.compile(r"(?P<sign>[|;,/\s])|(?P<quote>[\"'])|(?P<open>\[)|(?P<close>\])")
_EDGE = " \t\r\n   ​﻿\"“”"


def _trim(s: str) -> str:
    return s.strip().strip(_EDGE).strip()


def split_acts(text: str | None, protected: tuple[str, ...] = ()) -> list[str]:
    """The acts of a credit line, in order.

    Joining words and signs divide outside quotes; brackets that open with a joining word hold
    guests. Protected names, ", Jr.", other brackets, "+", "and" and a closing X stay in the name.
    None and blank text give []; repeated values stay.
    """
    if not text:
        return []
    toks: list[tuple[str, str, int]] = []
    at = 0
    for m in _act_lexer(protected).finditer(text):
        if m.start() > at:
            toks.append(("text", text[at : m.start()], at))
        toks.append((m.lastgroup or "text", m.group(), m.start()))
        at = m.end()
    if at < len(text):
        toks.append(("text", text[at:], at))

    dividing = {"sign", "word", "guest", "close"}

    def ends_name(i: int) -> bool:
        """Whether only blanks stand between token i and the end or the next dividing token."""
        for kind, s, _ in toks[i + 1 :]:
            if kind == "text":
                if s.strip():
                    return False
            elif kind == "quote":
                # a closing quote right after, or an opening one that starts the next act
                return quoted or s != '"' or False
            else:
                return kind in dividing or (kind == "x")
        return True

    out: list[str] = []
    cur: list[str] = []
    quoted = False
    depth = 0  # of brackets that belong to the name
    guests = 0
    last_quote = max((i for i, t in enumerate(toks) if t[0] == "quote"), default=-1)

    def flush() -> None:
        nonlocal cur
        v = _trim("".join(cur))
        if v:
            out.append(v)
        cur = []

    for i, (kind, s, _) in enumerate(toks):
        if quoted:
            if kind == "quote":
                quoted = False
            cur.append(s)
            continue
        if kind == "quote":
            if not "".join(cur).strip() and i < last_quote:
                quoted = True
            cur.append(s)
        elif kind == "open":
            depth += 1
            cur.append(s)
        elif kind == "close":
            if depth:
                depth -= 1
                cur.append(s)
            elif guests:
                guests -= 1
                flush()
            else:
                cur.append(s)
        elif depth:
            cur.append(s)
        elif kind == "guest":
            guests += 1
            flush()
        elif kind == "word":
            if "".join(cur).strip():
                flush()
            elif out or guests:
                pass
            else:
                cur.append(s)
        elif kind == "x":
            if "".join(cur).strip() and not ends_name(i):
                flush()
            elif not "".join(cur).strip() and out and not ends_name(i):
                pass
            else:
                cur.append(s)
        elif kind == "sign":
            flush()
        else:
            cur.append(s)
    flush()
    return out


def split_labels(text: str | None, lexer: re.Pattern[str] = _LABEL_LEXER) -> list[str]:
    """Labels or ids packed in one field.

    Delimiters are | ; , tab, line end and a slash between blanks, all outside quotes; a leading
    list bracket makes single quotes count too. A backslash escapes the next sign in quotes and a
    doubled quote stands for one. An unclosed quote is taken as plain text. None gives [].
    """
    if not text:
        return []
    body = text.strip()
    listed = body.startswith("[") and body.endswith("]")
    if listed:
        body = body[1:-1]
    out: list[str] = []
    cur: list[str] = []
    quote = ""
    at = 0

    def flush() -> None:
        nonlocal cur
        v = "".join(cur).strip()
        if v:
            out.append(v)
        cur = []

    def closes_later(sign: str, start: int) -> bool:
        return body.find({"“": "”"}.get(sign, sign), start) >= 0

    while m := lexer.search(body, at):
        cur.append(body[at : m.start()])
        at = m.end()
        kind, s = m.lastgroup, m.group()
        if quote:
            if kind == "escape":
                cur.append(s[1:])
            elif kind == "quote" and s == quote:
                if body[at : at + 1] == quote:
                    cur.append(quote)
                    at += 1
                else:
                    quote = ""
            else:
                cur.append(s)
        elif kind == "sign":
            flush()
        elif kind == "quote" and not "".join(cur).strip() and (s != "'" or listed) and closes_later(s, at):
            quote = {"“": "”"}.get(s, s)
        elif kind in ("open", "close") and lexer is _ID_LEXER:
            pass
        else:
            cur.append(s)
    cur.append(body[at:])
    flush()
    return out


def split_ids(text: str | None) -> list[str]:
    """Ids packed in one field; blanks divide too, since no id holds one."""
    return split_labels(text, _ID_LEXER)


KINDS = {"acts": split_acts, "labels": split_labels, "ids": split_ids}


def split_packed(column: Column | str, kind: str, protected: Sequence[str] = ()) -> Column:
    """Array column with the values of a packed field; kind is acts, labels or ids."""
    names = tuple(protected)
    f = functools.partial(split_acts, protected=names) if kind == "acts" else KINDS[kind]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        out = []
        for x in s:
            if not isinstance(x, str):
                out.append([])
                continue
            v = known.get(x)
            if v is None:
                v = known[x] = f(x)
            out.append(v)
        return pd.Series(out, dtype=object)

    return run(F.col(column) if isinstance(column, str) else column)


def explode_packed(df: DataFrame, id_col: str, fields: dict[str, str], protected: Sequence[str] = ()) -> DataFrame:
    """One row (id_col, field_name, item_no, item) per value of each packed field.

    fields maps column names to kinds. Null, empty and blank fields give no row; equal values of a
    field all stay; equal rows of df all come out; other columns of df are pruned, so their names
    cannot clash; an empty df gives an empty result.
    """
    one = F.array(
        *(F.struct(F.lit(name).alias("field_name"), split_packed(name, kind, protected).alias("items")) for name, kind in fields.items())
    )
    return (
        df.select(F.col(id_col), *fields)
        .select(id_col, F.explode(one).alias("f"))
        .select(id_col, F.col("f.field_name").alias("field_name"), F.posexplode("f.items").alias("pos", "item"))
        .select(id_col, "field_name", (F.col("pos") + 1).cast("int").alias("item_no"), "item")
    )


def protected_names(acts: DataFrame, column: str = "act_name", limit: int = 100_000) -> tuple[str, ...]:
    """The protected names as a plain tuple; a fixed reference list, refused beyond limit rows."""
    rows = acts.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} protected names; this list is meant to be a fixed one")
    return tuple(sorted(r[0] for r in rows))


def fold(text: str) -> str:
    """Lower case without marks, with single blanks."""
    s = unicodedata.normalize("NFKD", text)
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold()
    return re.sub(r"\s+", " ", s).strip()
