"""Scores for abusive, hateful or sexually explicit language, line by line.

A factorization machine over hashed terms (words, neighbouring words, letter groups) scores each
line; its second-order part learns which terms are abusive only together, such as an insult with a
group, and which are harmless together. Judgements are known per text, not per line, so training
alternates: score all lines, take the top lines of judged-offensive texts as its positive lines, fit
again. A text's score is that of its worst line. The model is fitted on a bounded sample of judged
texts plus a few fixed lines; scoring covers every line of every text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most judged texts that are used for fitting, taken by hash of their id.
MAX_JUDGED = 20_000
#: Offensive texts that a threshold found from the texts must outweigh.
FEW = 5
BITS = 17
RANK = 8
ROUNDS = 2
EPOCHS = 6
#: Line scores remembered per worker before its memory is emptied; a matter of speed only.
REMEMBERED = 200_000

#: Fixed lines that start the model where judged texts are few: offensive, then harmless.
SEED_BAD = (
    "fuck you", "what the fuck is wrong with you bitch", "you stupid bitch", "fucking asshole", "motherfucker", "piece of shit", "this is bullshit",
    "i don't give a shit about you", "lying whore get out", "you cunt", "that slut", "son of a bitch", "hijo de puta no vuelvas", "puta mierda", "pendejo cabrón",
    "i will kill you", "i'm gonna kill you tonight", "i'll cut your throat", "i'll break your jaw", "gonna shoot your family", "beg for your life", "go kill yourself",
    "we're coming to burn you alive", "i'll put you in the ground", "you worthless pathetic loser", "you are a disgusting pig", "rot in a ditch you rat", "drop dead you freak",
    "nobody would miss you you parasite", "those people are vermin", "they are filthy animals throw them in the sea", "they poison our blood burn their homes", "they are less than human lock them in cages",
    "they should crawl back where they came from", "born thieves hang them high", "they do not deserve to breathe our air", "ought to be wiped out", "son ratas que los quemen a todos",
    "spread your legs", "suck my dick", "riding me naked in the back seat", "moaning under me on the bed", "come on my sheets", "licking between my legs", "grab your tits and bend you over",
    "i want you inside me all night", "take off your panties", "on her knees sucking me", "wet for me in the shower",
)
SEED_FINE = (
    "damn the night is cold", "what the hell", "hell of a night", "i'm killing this beat on the dance floor", "the bass is sick it's murder on the speakers", "shoot me a message when you're home",
    "beat me at chess", "my old friend dick drives the bus", "the cock crows on the farm", "pussy willows in the spring", "our bitch had puppies in the barn", "garden hoes are leaning on the shed",
    "a cocktail dress and a classic assassin movie", "burn this town with music", "we choke on laughter dying at your jokes", "stupid me i lost the key", "your ugly sweater makes me smile",
    "strip the old paint and spread the new", "i broke my jaw on an apple", "trash cans rolling down the hill", "the animals are thirsty lead them to the sea", "kiss me slow", "all night long i love you",
    "take me home tonight", "you lovely piece of sunshine", "i would die for you", "love is a loaded gun", "wet from the rain", "grab your coat and bend with the wind", "on her knees in the garden",
    "hanging high the moon", "those people are singing", "my grandmother", "oh oh oh", "la la la", "hold me close in the morning", "i'll cut your hair and laugh about it",
)

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "’": "'"})
_TOKEN = re.compile(r"[a-zñ0-9$@!*'’]+")
_STAMP = re.compile(r"^\s*\[[^\]]*\]\s*")


def terms(line: str) -> list[str]:
    """Words of a line, with letters put back where signs or digits stand for them."""
    s = line.casefold()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    out = []
    for w in _TOKEN.findall(s):
        w = w.rstrip("!")
        if any(c.isalpha() for c in w):
            w = w.translate(_LEET)
        w = re.sub(r"(.)\1+", r"\1", w.strip("'"))
        if w:
            out.append(w)
    return _joined(out)


def _joined(words: list[str]) -> list[str]:
    """Words with three or more single letters in a row made one word, as in "f u c k"."""
    if sum(len(w) == 1 for w in words) < 3:
        return words
    out: list[str] = []
    run: list[str] = []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) > 2 else run
        run = []
        if w:
            out.append(w)
    return out


def _slot(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}{s}".encode()) & ((1 << BITS) - 1)


def features(words: Sequence[str]) -> tuple[list[int], list[float]]:
    """Hashed terms of a line and their weights."""
    got: dict[int, float] = {}
    for w in words:
        got[_slot("w", w)] = 1.0
        if len(w) > 2:
            p = f"<{w}>"
            k = len(p) - 2
            for i in range(k):
                h = _slot("g", p[i : i + 3])
                got.setdefault(h, 0.6 / k**0.5)
    for a, b in zip(words, words[1:], strict=False):
        got[_slot("b", f"{a} {b}")] = 0.7
    return list(got), list(got.values())


class FactorizationMachine:
    """Binary second-order factorization machine with hashed features, fitted by Adagrad."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << BITS
        self.b = np.zeros(1, dtype=np.float32)
        self.w = np.zeros(n, dtype=np.float32)
        self.v = rng.normal(0, 0.03, (n, RANK)).astype(np.float32)
        self.gb = np.full(1, 1e-6)
        self.gw = np.full(n, 1e-6, dtype=np.float32)
        self.gv = np.full((n, RANK), 1e-6, dtype=np.float32)

    def raw(self, idx: np.ndarray, val: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, ptr[:-1], axis=0)
        sq = np.add.reduceat((vx**2).sum(1), ptr[:-1])
        lin = np.add.reduceat(self.w[idx] * val, ptr[:-1])
        return self.b[0] + lin + 0.5 * ((s**2).sum(1) - sq), s, vx

    def step(self, idx: np.ndarray, val: np.ndarray, ptr: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float = 0.08, l2: float = 2e-5) -> None:
        out, s, vx = self.raw(idx, val, ptr)
        g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * weight
        row = np.repeat(np.arange(len(y)), np.diff(ptr))
        gi = g[row] * val
        gv = gi[:, None] * (s[row] - vx)
        u, inv = np.unique(idx, return_inverse=True)
        aw = np.bincount(inv, gi, len(u)) + l2 * self.w[u]
        av = np.zeros((len(u), RANK), dtype=np.float32)
        np.add.at(av, inv, gv.astype(np.float32))
        av += l2 * self.v[u]
        self.gw[u] += aw**2
        self.gv[u] += av**2
        self.gb += g.sum() ** 2
        self.w[u] -= rate * aw / np.sqrt(self.gw[u])
        self.v[u] -= rate * 0.5 * av / np.sqrt(self.gv[u])
        self.b -= rate * g.sum() / np.sqrt(self.gb)

    def score(self, lines: Sequence[Sequence[str]]) -> np.ndarray:
        """Log-odds per line; a line without words gets -9."""
        out = np.full(len(lines), -9.0, dtype=np.float32)
        idx, val, ptr = _pack([features(w) for w in lines])
        full = np.flatnonzero(np.diff(ptr) > 0)
        if len(full):
            p = np.concatenate([ptr[full], [ptr[-1]]])
            out[full] = self.raw(idx, val, p)[0]
        return out


def _pack(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ptr = np.cumsum([0] + [len(r[0]) for r in rows])
    idx = np.fromiter((i for r in rows for i in r[0]), dtype=np.int64, count=int(ptr[-1]))
    val = np.fromiter((x for r in rows for x in r[1]), dtype=np.float32, count=int(ptr[-1]))
    return idx, val, ptr


def lines_of(text: str) -> list[str]:
    return [x for x in (_STAMP.sub("", y).strip() for y in re.split(r"\r\n|\r|\n", text)) if x]


def train(texts: Sequence[str], flags: Sequence[int], seed: int = 7) -> tuple[FactorizationMachine, float]:
    """The fitted machine and the log-odds above which a text counts as offensive."""
    key: dict[str, int] = {}
    lines: list[list[str]] = []

    def line_id(s: str) -> int:
        w = terms(s)
        k = " ".join(w)
        if k not in key:
            key[k] = len(lines)
            lines.append(w)
        return key[k]

    bags = [sorted({line_id(x) for x in lines_of(t)}) for t in texts]
    bad, fine = [line_id(x) for x in SEED_BAD], [line_id(x) for x in SEED_FINE]
    n = len(lines)
    all_idx, all_val, all_ptr = _pack([features(w) for w in lines])
    size = np.diff(all_ptr)
    seeds = np.zeros(n)
    seeds[bad], seeds[fine] = 1, -1
    hot = np.array(flags, dtype=bool)
    rng = np.random.default_rng(seed)
    half = rng.integers(0, 2, len(bags))

    def machine(chosen: list[set[int]] | None, part: np.ndarray, dropped: np.ndarray, epochs: int, boost: float, turn: int) -> FactorizationMachine:
        """A machine fitted on some of the texts; chosen has the positive lines of each text."""
        pos, neg = np.zeros(n), np.zeros(n)
        for k in np.flatnonzero(part):
            for x in bags[k]:
                (pos if hot[k] else neg)[x] += 1
        share = pos / np.maximum(pos + neg, 1)
        y, weight = np.zeros(n), np.zeros(n)
        weight[neg > 0] = 1 + 0.3 * np.log(neg[neg > 0])
        weight[dropped] = 0
        if chosen is None:
            first = np.flatnonzero(share > 0.6)
            y[first] = 1
            weight[first] = np.where(pos[first] > 1, 1.0, 0.05)
        else:
            for k in np.flatnonzero(part & hot):
                for x in chosen[k]:
                    if share[x] > 0.4:
                        y[x], weight[x] = 1, 1 + 0.3 * np.log(pos[x])
        y[seeds > 0] = 1
        weight[seeds != 0] = np.maximum(weight[seeds != 0], 2.0)
        use = np.flatnonzero((weight > 0) & (size > 0))
        up, down = weight[use][y[use] == 1].sum(), weight[use][y[use] == 0].sum()
        w = np.where(y == 1, weight * min(boost, max(1.0, 0.4 * down / max(up, 1.0))), weight)
        fm = FactorizationMachine(seed + turn)
        for _ in range(epochs):
            rng.shuffle(use)
            for at in range(0, len(use), 256):
                now = use[at : at + 256]
                ptr = np.concatenate([[0], np.cumsum(size[now])])
                where = np.repeat(all_ptr[now] - ptr[:-1], size[now]) + np.arange(ptr[-1])
                fm.step(all_idx[where], all_val[where], ptr, y[now], w[now])
        return fm

    # each half of the texts is scored by the machine of the other half, so that no text's own
    # judgement, which may be wrong, speaks for its lines
    chosen: list[set[int]] | None = None
    dropped = np.zeros(n, dtype=bool)
    for turn in range(ROUNDS):
        s = [machine(chosen, half != h, dropped, EPOCHS, 3.0, 2 * turn + h).score(lines) for h in (0, 1)]
        dropped = (np.minimum(s[0], s[1]) > 2) & (seeds >= 0)
        chosen = [{x for x in b if s[h][x] > 0} if f else set() for b, f, h in zip(bags, hot, half, strict=True)]
    fm = machine(chosen, np.ones(len(bags), dtype=bool), dropped, 2 * EPOCHS, 6.0, 99)
    s = fm.score(lines)
    tops = np.array([max((s[i] for i in b), default=-9.0) for b in bags])
    real = np.array([bool(c) for c in chosen], dtype=bool)
    at = np.arange(-2, 3.01, 0.25)
    f1 = np.array([2 * ((tops > t) & real).sum() / max(1, (tops > t).sum() + real.sum()) for t in at])
    # of the thresholds that are as good, the middle, drawn towards even odds where few texts speak for it
    cut = float(np.median(at[f1 >= f1.max() - 0.002])) * real.sum() / (real.sum() + FEW)
    return fm, cut


def fit(texts: DataFrame, judged: DataFrame, id_col: str = "song_id", text_col: str = "lyrics_clean", flag_col: str = "flagged") -> tuple[FactorizationMachine, float]:
    """Fit on at most MAX_JUDGED judged texts, chosen by hash of their id; contradicting or repeated
    judgements of one id count by their mean, null flags and null texts not at all."""
    one = judged.where(F.col(flag_col).isNotNull()).groupBy(id_col).agg(F.avg(flag_col).alias("flag"))
    have = texts.where(F.col(text_col).isNotNull()).select(id_col).join(one, id_col).groupBy(id_col).agg(F.first("flag").alias("flag"))
    # ids are chosen first, so that only the chosen texts travel
    ids = have.orderBy(F.xxhash64(id_col), id_col).limit(MAX_JUDGED)
    sample = texts.select(id_col, F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min("text").alias("text"), (F.first("flag") > 0.5).cast("int").alias("flag"))
    rows = sorted(sample.collect(), key=lambda r: (r[0], r[1]))
    return train([r[1] for r in rows], [r[2] for r in rows])


def score_texts(texts: DataFrame, judged: DataFrame, id_col: str = "song_id", text_col: str = "lyrics_clean") -> DataFrame:
    """(id, score, offensive, worst_line): the chance of the worst line of every text.

    A null, empty or blank text gets score 0 and is not offensive, with a null worst_line. Equal
    rows all come out; ties for the worst line go to the first; other columns are pruned. Without
    any judged text the fixed lines alone make the model.
    """
    fm, cut = fit(texts, judged, id_col, text_col)
    held = texts.sparkSession.sparkContext.broadcast((fm.b, fm.w, fm.v, cut))
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = FactorizationMachine.__new__(FactorizationMachine)
        m.b, m.w, m.v, at = held.value
        known: dict[str, float] = {}
        for pdf in batches:
            split = [lines_of(t) if isinstance(t, str) else [] for t in pdf[text_col]]
            new = list(dict.fromkeys(x for ls in split for x in ls if x not in known))
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(x for ls in split for x in ls))
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                known.update(zip(part, m.score([terms(x) for x in part]).tolist(), strict=True))
            worst = [max(ls, key=known.__getitem__) if ls else None for ls in split]
            raw = np.array([known[x] if x is not None else -np.inf for x in worst], dtype=float)
            yield pd.DataFrame({id_col: pdf[id_col], "score": 1 / (1 + np.exp(-(raw - at))), "offensive": raw > at, "worst_line": pd.Series(worst, index=pdf.index, dtype=object)})

    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, score double, offensive boolean, worst_line string")


def rates(texts: DataFrame, scores: DataFrame, id_col: str = "song_id", source_col: str = "lyrics_source") -> DataFrame:
    """(source, songs, offensive, rate) per source; a null source is one of its own."""
    return (
        texts.select(id_col, F.col(source_col).alias("source"))
        .join(scores.select(id_col, "offensive"), id_col)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("songs"), F.sum(F.col("offensive").cast("long")).alias("offensive"), F.avg(F.col("offensive").cast("double")).alias("rate"))
    )
