"""Texts cut off by field limits or in transfer.

Two kinds of evidence meet in one posterior. Length: per source, a lognormal of the text lengths is
fitted by maximum likelihood with right censoring at each candidate limit (a length, in characters
or bytes, at which far more texts stand than the fit allows); a value at a limit gets the posterior
that it was censored there. Ending: over all lines of the corpus, how often the last words of a
text end a line, go on, or are the beginning of a longer word there. Line and length counts are
aggregated before they move; only one small histogram per source meets in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import cut

#: Chance that so many texts share a length by accident, below which the length is a candidate limit.
LIMIT_P = 1e-6
#: Fewest texts at a candidate limit.
LIMIT_LEAST = 4
#: Texts cut per complete text before any evidence.
PRIOR = 0.05
#: Letters of a usual line.
LETTERS_A_LINE = 40
#: Contexts seen less often than this leave the word to a shorter context.
SEEN = 4

_TIME = r"^\s*\[\d[\d:.]*\]\s*"
#: Signs and remarks that a cut or a singer may leave at the end of a text.
_TAIL = r"(?iU)(\s*(\[\s*(\.\.\.|…|text ends|cut|truncated|continued)\s*\]|\(\s*(continued|cont\.?|more|truncated|\.\.\.|…)\s*\)|…|\.{2,}|[-–—]))+\s*$"
_REMARK = r"(?iU)\s*[,(\[]?\s*(?:x\s?\d+|\d+\s?x|repeat(?:ed)?(?: x?\d+)?)\s*[)\]]?\s*$"
#: A bracket, a character reference or the bytes of a letter that were begun and not ended.
_UNCLOSED = r"(\[[^\]]*|\x{FFFD}|&(#\d{0,4}|#x[0-9a-f]{0,4}|am?|amp|apo?|apos|lt?|gt?|qu?|quot?|n|nbs?|nbsp))$"
_LABEL = r"(?iU)^\s*[\[(][^\])]*[\])]\s*:?\s*$"


def _clean_line(c: Column) -> Column:
    return F.regexp_replace(c, _TIME, "")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([\p{L}\p{N}'’*@$!]*[\p{L}\p{N}]['’*]?)"), 1)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once a row, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def last_lines(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per text: its other lines as they stand, its last line with a word, that line's words and what stands after them."""
    raw = F.split(F.regexp_replace(F.col(text_col), r"(?:\s|(?<=[\r\n])\[\d[\d:.]*\])+$", ""), "\r\n?|\n")

    def parts(last: Column) -> Column:
        return _let(F.regexp_replace(last, _TAIL, ""), lambda body: F.struct(last.alias("last"), (body != last).alias("tail"), (last.rlike(_LABEL) & (body == last)).alias("label"), F.concat(F.array(F.lit("^")), _words(F.regexp_replace(body, _REMARK, ""))).alias("w")))

    x = _let(raw, lambda lines: F.struct(lines.alias("raw"), _let(F.trim(_clean_line(F.try_element_at(lines, F.lit(-1)))), parts).alias("end")))
    texts = df.where(F.length(F.trim(text_col)) > 0).select(F.col(id_col), F.col(source_col).alias("source"), F.length(text_col).alias("chars"), F.octet_length(text_col).alias("bytes"), x.alias("x"))
    return cut(texts).select(id_col, "source", "chars", "bytes", "x.raw", "x.end.*").where("last <> ''")


def line_grams(texts: DataFrame) -> DataFrame:
    """(ctx, nxt, n): how often a word, or the line's end "$", follows a context in the corpus.

    Contexts are the last four and the last two words, with "^" for the line's start. The last line
    of each text is left out, since it may be cut. Equal lines are counted before anything is made of
    them. Rows may repeat.
    """
    # cut here, or the filters below would be moved before the count and match every line
    raw = cut(texts.select(F.explode(F.slice("raw", 1, F.greatest(F.size("raw") - 1, F.lit(0)))).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")))
    lines = (
        raw.select("n", F.trim(_clean_line(F.col("line"))).alias("line"))
        .where("line <> ''")
        .select("n", F.lower(F.regexp_replace(F.regexp_replace("line", _REMARK, ""), r"(?U)[^\p{L}\p{N}'’*@$!]+$", "")).alias("line"))
        .where(F.col("line") != "")
        .groupBy("line")
        .agg(F.sum("n").alias("n"))
    )
    t = F.concat(F.array(F.lit("^")), _words(F.col("line")), F.array(F.lit("$")))
    return (
        lines.select("n", t.alias("t"))
        .where(F.size("t") > 2)
        .select("n", "t", F.explode(F.sequence(F.lit(2), F.size("t"))).alias("i"))
        .select("n", F.try_element_at("t", F.col("i")).alias("nxt"), F.explode(_contexts(F.col("t"), F.col("i") - 1)).alias("ctx"))
    )


def _known(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """(what, ctx, p, one, two) for the asked (what, ctx, p).

    what "e": followers of the context and how many of them are a line's end. what "w": how often p itself
    follows, and how often a word that p begins. Beginnings are joined as equal strings, so a common context is no product.
    """
    asked = asked.distinct()
    # the semi-join leaves grams partitioned by context, where they are added up without another shuffle
    grams = grams.join(asked.select("ctx").distinct(), "ctx", "left_semi").groupBy("ctx", "nxt").agg(F.sum("n").alias("n"))
    grams = cut(grams)
    end = F.col("nxt") == "$"
    ends = grams.groupBy("ctx").agg(F.sum("n").alias("one"), F.sum(F.when(end, F.col("n")).otherwise(0)).alias("two")).select(F.lit("e").alias("what"), "ctx", F.lit("").alias("p"), "one", "two")
    begun = F.transform(F.sequence(F.lit(1), F.length("nxt")), lambda k: F.struct(F.substring(F.col("nxt"), F.lit(1), k).alias("p"), (k == F.length("nxt")).alias("whole")))
    word = (
        grams.where(~end & (F.length("nxt") > 0))
        .select("ctx", "n", F.explode(begun).alias("x"))
        .select("ctx", F.col("x.p").alias("p"), "n", "x.whole")
        .join(asked.where("what = 'w'").select("ctx", "p"), ["ctx", "p"], "left_semi")
        .groupBy("ctx", "p")
        .agg(F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("one"), F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0)).alias("two"))
        .select(F.lit("w").alias("what"), "ctx", "p", "one", "two")
    )
    return ends.unionByName(word)


def _contexts(words: Column, end: Column) -> Column:
    """The contexts that end at the 1-based place end: four words, and two marked as such."""
    four = F.slice(words, F.greatest(end - 3, F.lit(1)), F.least(end, F.lit(4)))
    two = F.slice(words, F.greatest(end - 1, F.lit(1)), F.least(end, F.lit(2)))
    return F.array(F.concat(F.lit("4 "), F.array_join(four, " ")), F.concat(F.lit("2 "), F.array_join(two, " ")))


def _fit(lengths: np.ndarray, counts: np.ndarray, limits: list[int]) -> tuple[float, float]:
    """Lognormal by censored maximum likelihood: values at a limit only say that the true length is
    at least the limit. EM on the truncated normal of the logs."""
    x = np.log(np.maximum(lengths, 1))
    cens = np.isin(lengths, limits)
    w = counts.astype(float)
    mu = float(np.average(x, weights=w))
    sd = max(0.05, math.sqrt(np.average((x - mu) ** 2, weights=w)))
    for _ in range(60):
        z = (x[cens] - mu) / sd
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        lam = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-12)
        e1 = x.copy()
        e1[cens] = mu + sd * lam
        e2 = x**2
        e2[cens] = mu**2 + sd**2 + sd * (x[cens] + mu) * lam
        new = float(np.average(e1, weights=w))
        var = float(np.average(e2, weights=w)) - new**2
        new_sd = max(0.05, math.sqrt(max(var, 1e-6)))
        done = abs(new - mu) + abs(new_sd - sd) < 1e-7
        mu, sd = new, new_sd
        if done:
            break
    return mu, sd


def _poisson_tail(k: int, mean: float) -> float:
    """P(X >= k) to first order."""
    if mean <= 0:
        return 0.0
    return min(1.0, math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) * (k + 1) / max(k + 1 - mean, 1e-9)) if k > mean else 1.0


def fit_limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and unit from its histogram (length, n), with the censoring
    odds of a value there: texts censored at the limit per text that is naturally that long."""
    pdf = pdf.groupby("length", as_index=False)["n"].sum().sort_values("length")
    x, n = pdf["length"].to_numpy(), pdf["n"].to_numpy()
    total = n.sum()
    limits: list[int] = []
    if total >= 8:
        for _ in range(4):
            mu, sd = _fit(x, n, limits)
            dens = np.exp(-((np.log(np.maximum(x, 1)) - mu) ** 2) / (2 * sd**2)) / (np.maximum(x, 1) * sd * math.sqrt(2 * math.pi))
            new = [int(a) for a, b, d in zip(x, n, dens, strict=True) if b >= LIMIT_LEAST and _poisson_tail(int(b), float(total * max(d, 1e-9))) < LIMIT_P]
            if new == limits:
                break
            limits = new
    rows = []
    for a in limits:
        b = int(n[x == a][0])
        natural = max(float(total * dens[x == a][0]), 0.05)
        rows.append({"source": pdf_source(pdf), "length": a, "at": b, "mu": mu, "sigma": sd, "odds": max(b - natural, 0.1) / natural})
    return pd.DataFrame(rows, columns=["source", "length", "at", "mu", "sigma", "odds"])


def pdf_source(pdf: pd.DataFrame) -> str | None:
    return pdf.attrs.get("source")


def limits_of(texts: DataFrame) -> DataFrame:
    """(unit, source, length, at, mu, sigma, odds): candidate limits per source, in characters and bytes."""
    hist = (
        texts.select(F.coalesce("source", F.lit("")).alias("source"), F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "length"))
        .groupBy("source", "unit", "length")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_limits(pdf[["length", "n"]])
        out["source"], out["unit"] = key
        return out[["unit", "source", "length", "at", "mu", "sigma", "odds"]]

    return hist.groupBy("source", "unit").applyInPandas(one, "unit string, source string, length int, at long, mu double, sigma double, odds double")


def score_cuts(df: DataFrame, id_col: str = "lyric_id", text_col: str = "plain_lyrics", source_col: str = "fetch_source") -> DataFrame:
    """(id, source, chars, limit_odds, end_odds, posterior, is_cut) for every row of df.

    posterior is the chance that the text was cut; is_cut says that it exceeds one half. Null and
    blank texts were not cut and get posterior 0; a null source is a source of its own; equal rows
    all come out. A text that ends in dots, a dash, an interjection or a label counts as its
    last words do. Texts of labels only get posterior 0 but for limits.
    """
    texts = last_lines(df, id_col, text_col, source_col)
    limits = cut(limits_of(texts)).select("unit", F.col("source").alias("l_source"), "length", "odds")
    m = F.size("w")
    last = texts.drop("raw").withColumn("label", F.col("label") | (m < 2)).withColumn("partial", F.try_element_at("w", F.lit(-1)))
    # what follows each context that some text ends on
    end, word = _contexts(F.col("w"), m), _contexts(F.col("w"), m - 1)
    ask = lambda kind, what, ctx, p: F.struct(F.lit(kind).alias("kind"), F.lit(what).alias("what"), ctx.alias("ctx"), p.alias("p"))
    none, part = F.lit(""), F.col("partial")
    asked = last.where(~F.col("label")).select(id_col, F.explode(F.array(ask("e4", "e", end[0], none), ask("e2", "e", end[1], none), ask("w4", "w", word[0], part), ask("w2", "w", word[1], part))).alias("x")).select(id_col, "x.*")
    known = _known(asked.select("what", "ctx", "p"), line_grams(texts))
    c = F.col
    pick = lambda kind, v: F.coalesce(F.max(F.when(c("kind") == kind, c(v))), F.lit(0))
    of_text = asked.join(known, ["what", "ctx", "p"]).groupBy(id_col).agg(
        pick("e4", "one").alias("e4n"), pick("e4", "two").alias("e4e"), pick("e2", "one").alias("e2n"), pick("e2", "two").alias("e2e"),
        pick("w4", "one").alias("w4s"), pick("w4", "two").alias("w4l"), pick("w2", "one").alias("w2s"), pick("w2", "two").alias("w2l"),
    )
    got = last.drop("w").join(of_text, id_col, "left").na.fill(0, ["e4n", "e4e", "e2n", "e2e", "w4s", "w4l", "w2s", "w2l"])
    # odds that this ending comes from a cut: places where it goes on against places where it ends
    four = F.log((c("e4n") - c("e4e") + 0.2) / (c("e4e") + 0.2))
    two = F.log((c("e2n") - c("e2e") + 0.2) / (c("e2e") + 0.2))
    go_on = F.when(c("e4n") >= SEEN, four).when(c("e2n") >= SEEN, two).when(c("e4n") + c("e2n") > 0, 0.5 * two)
    longer = F.when(c("w4s") + c("w4l") >= 2, F.log((c("w4l") + 0.1) / (c("w4s") + 0.1))).otherwise(F.log((c("w2l") + 0.1) / (c("w2s") + 0.1)))
    # a last word that nobody uses here, and which begins one that is used, is half a word
    end_odds = (
        F.when(c("label"), F.lit(-6.0))
        .when((c("e4n") == 0) & (c("e2n") == 0), F.when(c("w4l") + c("w2l") > 0, F.greatest(longer, F.lit(2.0)) + 2).otherwise(F.lit(0.5)))
        .when((c("w4s") + c("w4l") >= 2) & (longer > 2), F.greatest(longer, go_on))
        .otherwise(go_on)
    )
    # a cut falls on a line's end about as often as a line has letters, so no ending speaks more for a whole text
    end_odds = F.least(F.greatest(end_odds, F.lit(-math.log(LETTERS_A_LINE))), F.lit(9.0)) + F.when(c("tail") & ~c("label"), 0.7).otherwise(0.0)
    end_odds = F.when(c("last").rlike(_UNCLOSED), F.lit(9.0)).otherwise(end_odds)
    bound = limits.where("unit = 'chars'").select("l_source", F.col("length").alias("lc"), F.col("odds").alias("c_odds"))
    bound_b = limits.where("unit = 'bytes'").select(F.col("l_source").alias("lb_source"), F.col("length").alias("lb"), F.col("odds").alias("b_odds"))
    scored = (
        got.withColumn("end_odds", end_odds)
        .join(bound, (F.coalesce(c("source"), F.lit("")) == c("l_source")) & (c("chars") == c("lc")), "left")
        .join(bound_b, (F.coalesce(c("source"), F.lit("")) == c("lb_source")) & (c("bytes") == c("lb")), "left")
        .withColumn("limit_odds", F.coalesce(F.log(F.greatest("c_odds", "b_odds")) - math.log(PRIOR), F.lit(0.0)))
        .withColumn("posterior", 1 / (1 + F.exp(-(c("limit_odds") + c("end_odds") + math.log(PRIOR)))))
        .select(id_col, F.col("limit_odds").alias("lo"), F.col("end_odds").alias("eo"), F.col("posterior").alias("po"))
    )
    return df.select(id_col, F.col(source_col).alias("source"), F.length(text_col).alias("chars")).join(scored, id_col, "left").select(
        id_col,
        "source",
        "chars",
        F.coalesce("lo", F.lit(0.0)).alias("limit_odds"),
        F.coalesce("eo", F.lit(0.0)).alias("end_odds"),
        F.coalesce("po", F.lit(0.0)).alias("posterior"),
        (F.coalesce("po", F.lit(0.0)) > 0.5).alias("is_cut"),
    )


def cut_rates(scored: DataFrame) -> DataFrame:
    """(source, texts, cut, rate): how often each source truncates; sources without texts count 0."""
    return scored.groupBy("source").agg(
        F.count("chars").alias("texts"),
        F.sum(F.col("is_cut").cast("long")).alias("cut"),
        (F.sum(F.col("is_cut").cast("double")) / F.nullif(F.count("chars"), F.lit(0))).alias("rate"),
    )
