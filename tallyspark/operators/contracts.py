"""Promises about tables that are checked before they are relied on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what an operator relies on."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once; null keys count like any."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).limit(3).collect()
    if bad:
        raise ContractError(f"keys {list(keys)} are not unique, such as {bad}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "one_to_one", indicator: str | None = None) -> DataFrame:
    """Left join that promises its cardinality: one_to_one or many_to_one.

    The right keys must be unique (and the left ones for one_to_one), so the row count can't
    change; null keys match nothing. indicator names a column with both or left_only.
    """
    require_unique(right.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), keys)
    if validate == "one_to_one":
        require_unique(left, keys)
    if not indicator:
        return left.join(right, list(keys), "left")
    out = left.join(right.withColumn("__here", F.lit(True)), list(keys), "left")
    return out.withColumn(indicator, F.when(F.col("__here").isNull(), "left_only").otherwise("both")).drop("__here")


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, missing, share): one pass over the table, one row per column."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("missing")) for c in df.columns))
    return row.select("__n", F.explode(pairs).alias("p")).select("p.column_name", "p.missing", (F.col("p.missing") / F.nullif("__n", F.lit(0))).alias("share"))


def close_enough(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal within tolerance; two nulls are equal, one null isn't."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], atol: float = 1e-8) -> DataFrame:
    """(column_name, only_left, only_right, both, agree) from a full outer join of two tables."""
    r = right.select(*keys, *(F.col(c).alias(f"{c}__r") for c in columns), F.lit(True).alias("__r"))
    j = left.select(*keys, *columns, F.lit(True).alias("__l")).join(r, list(keys), "full")
    numeric = {f.name for f in left.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")}
    aggs = [F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"), F.count_if(F.col("__l") & F.col("__r")).alias("both")]
    for c in columns:
        same = close_enough(F.col(c), F.col(f"{c}__r"), atol=atol) if c in numeric else F.col(c).eqNullSafe(F.col(f"{c}__r"))
        aggs.append(F.count_if(F.col("__l") & F.col("__r") & same).alias(f"__{c}"))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"__{c}").alias("agree")) for c in columns))
    return j.agg(*aggs).select(F.explode(rows).alias("x"), "only_left", "only_right", "both").select("x.column_name", "only_left", "only_right", "both", "x.agree")
