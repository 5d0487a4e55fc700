"""Tests and running totals that stay distributed until one row is left."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import cut


def running_sum(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with running totals in the given order, without sorting everything in one task.

    Rows are range-partitioned by the order, summed inside each partition, and each partition
    starts from the totals of those before it, of which there are as many as partitions. The order
    must be total, or ties are broken arbitrarily.
    """
    p = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    start = p.groupBy("__p").agg(*(F.sum(c).alias(f"__t_{k}") for k, c in sums.items()))
    start = start.select("__p", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums))
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = p.join(F.broadcast(start), "__p")
    return out.withColumns({k: F.col(f"__s_{k}") + F.sum(c).over(w) for k, c in sums.items()}).drop("__p", *(f"__s_{k}" for k in sums))


def chi_square(df: DataFrame, a: str, b: str, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, n, chi2, dof, cramers_v, strength): one contingency test per stratum.

    Rows with a null in a or b are left out. A 2x2 table gets the continuity correction, bounded by the
    deviation itself. V comes from the corrected statistic. One-row or one-column tables give nulls.
    """
    s = list(strata)
    cell = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*s, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("o"))
    ra = cell.groupBy(*s, "__a").agg(F.sum("o").alias("ra"))
    rb = cell.groupBy(*s, "__b").agg(F.sum("o").alias("rb"))
    tot = cell.groupBy(*s).agg(F.sum("o").alias("n"), F.countDistinct("__a").alias("r"), F.countDistinct("__b").alias("c"))
    if s:
        full = ra.join(rb, s).join(cell, [*s, "__a", "__b"], "left").join(tot, s)
    else:
        full = ra.crossJoin(F.broadcast(rb)).join(cell, ["__a", "__b"], "left").crossJoin(F.broadcast(tot))
    e = F.col("ra") * F.col("rb") / F.col("n")
    diff = F.abs(F.coalesce("o", F.lit(0)) - e)
    yates = F.when((F.col("r") == 2) & (F.col("c") == 2), F.least(F.lit(0.5), diff)).otherwise(0.0)
    out = full.groupBy(*s, "n", "r", "c").agg(F.sum((diff - yates) ** 2 / e).alias("__x"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    v = F.sqrt(F.col("__x") / (F.col("n") * (F.least("r", "c") - 1)))
    ok = dof > 0
    return out.select(*s, "n", F.when(ok, F.col("__x")).alias("chi2"), dof.cast("int").alias("dof"), F.when(ok, v).alias("cramers_v"), F.when(ok, strength(v)).alias("strength"))


def strength(v: Column) -> Column:
    return F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "moderate").otherwise("strong")


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """(n1, n2, median1, median2, u, z, rank_biserial) of a two-sided test of group true against false.

    Values are counted per distinct value first; a running count over those gives mid-ranks. Ties
    correct the variance and z has the continuity correction. Null values or groups are left out;
    an empty group gives nulls.
    """
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(group).cast("boolean").alias("g"))
    c = d.groupBy("v").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("g")).alias("t1"))
    r = running_sum(c, ["v"], {"upto": "t"})
    rank = F.col("upto") - (F.col("t") - 1) / 2
    s = r.agg(F.sum(rank * F.col("t1")).alias("r1"), F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n2"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    med = d.agg(F.median(F.when(F.col("g"), F.col("v"))).alias("median1"), F.median(F.when(~F.col("g"), F.col("v"))).alias("median2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    ok = (n1 > 0) & (n2 > 0)
    return s.crossJoin(F.broadcast(med)).select("n1", "n2", "median1", "median2", F.when(ok, u).alias("u"), F.when(ok, z).alias("z"), F.when(ok, 2 * u / (n1 * n2) - 1).alias("rank_biserial"))


def chi2_tail(x: float, dof: int) -> float:
    """P(X > x) for a chi-square variable, by the series or the continued fraction of the incomplete gamma."""
    if x <= 0:
        return 1.0
    if dof == 1:
        return math.erfc(math.sqrt(x / 2))
    a, y = dof / 2, x / 2
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = y + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def with_p(df: DataFrame, chi2: str = "chi2", dof: str = "dof", name: str = "p") -> DataFrame:
    """Adds the p-value of chi-square rows; there is one row per test, so Python is no burden."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_tail(float(a), int(b)) for a, b in zip(x, k, strict=True)], dtype="float64")

    return df.withColumn(name, tail(chi2, dof))


def with_normal_p(df: DataFrame, z: str = "z", name: str = "p") -> DataFrame:
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else math.erfc(float(a) / math.sqrt(2)) for a in x], dtype="float64")

    return df.withColumn(name, tail(z))


def rate_table(df: DataFrame, by: Sequence[str], hit: str) -> DataFrame:
    """(by, n, hits, rate): share of rows where hit holds, in percent; null keys are left out."""
    keep = df
    for c in by:
        keep = keep.where(F.col(c).isNotNull())
    h = F.coalesce(F.col(hit).cast("int"), F.lit(0))
    return keep.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("hits"), (F.avg(h.cast("double")) * 100).alias("rate"))
