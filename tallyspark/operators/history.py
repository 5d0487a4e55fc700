"""What was known before: aggregates over strictly earlier days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def day_number(d: Column | str) -> Column:
    return F.datediff(F.col(d) if isinstance(d, str) else d, F.to_date(F.lit("1970-01-01")))


def earlier(keys: Sequence[str], day: str) -> Window:
    """Rows of the same keys on strictly earlier days; same-day rows don't see each other."""
    return Window.partitionBy(*keys).orderBy(day_number(day)).rangeBetween(Window.unboundedPreceding, -1)


def strict_prior(df: DataFrame, keys: Sequence[str], day: str, aggs: dict[str, Column]) -> DataFrame:
    """df with aggs over strictly earlier rows of the same keys.

    aggs maps new names to aggregates of df's columns. A range frame on the day number keeps the
    work at one sort per key, where an inequality join would be quadratic in a busy key.
    """
    w = earlier(keys, day)
    return df.withColumns({k: a.over(w) for k, a in aggs.items()})


def prior_by_day(df: DataFrame, keys: Sequence[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """(keys, day, sums) as strict_prior gives them, for keys so busy that one task shouldn't sort
    all their rows: rows are added up per key and day first, map-side, and only days are sorted."""
    per_day = df.groupBy(*keys, day).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    w = earlier(keys, day)
    return per_day.select(*keys, day, *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums))


def known_events(debuts: DataFrame, events: DataFrame, keys: Sequence[str], day: str, name: str) -> DataFrame:
    """debuts with the number of events of the same keys on strictly earlier days.

    Debuts and events are interleaved and a running sum taken, per key and day first."""
    tagged = debuts.groupBy(*keys, day).agg(F.lit(0).cast("long").alias("hit")).unionByName(events.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("hit")))
    by_day = tagged.groupBy(*keys, day).agg(F.sum("hit").alias("hit"))
    w = earlier(keys, day)
    known = by_day.select(*keys, day, F.coalesce(F.sum("hit").over(w), F.lit(0)).alias(name))
    return debuts.join(known, [*keys, day], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def islands(df: DataFrame, keys: Sequence[str], day: str, gap_days: int, name: str = "island") -> DataFrame:
    """df with the number of the run each row is in: a gap of more than gap_days starts a new run."""
    w = Window.partitionBy(*keys).orderBy(day)
    step = F.datediff(day, F.lag(day).over(w))
    return df.withColumn("__new", F.coalesce((step > gap_days).cast("int"), F.lit(1))).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
