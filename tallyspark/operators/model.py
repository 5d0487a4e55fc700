"""Two logistic models of a hit under a split by time: fill, scale, fit, predict, compare."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_hot(df: DataFrame, column: str, levels: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first; null gives zeros."""
    names = {f"{prefix}_{k}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for k, v in enumerate(levels) if k}
    return df.withColumns(names), list(names)


def train_stats(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Exact median, and mean and sample deviation after filling with it, per column, from training rows only."""
    med = train.agg(*(F.median(c).alias(c) for c in columns)).first()
    fill = {c: (0.0 if med[c] is None else float(med[c])) for c in columns}
    row = train.agg(*(x for c in columns for x in (F.avg(F.coalesce(F.col(c).cast("double"), F.lit(fill[c]))).alias(f"m_{c}"), F.stddev_samp(F.coalesce(F.col(c).cast("double"), F.lit(fill[c]))).alias(f"s_{c}")))).first()
    return {c: (fill[c], row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({f"z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - mean) / sd for c, (m, mean, sd) in stats.items()})


def newton(rows: DataFrame, x: str, y: str, size: int, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the logistic loss plus penalty/2 times their squared norm, the constant's included.

    x is an array column. Each round is one pass that returns the gradient and the curvature of every
    partition, summed by Spark; size squared numbers come back, whatever the number of rows.
    """
    w = np.zeros(size)
    spark = rows.sparkSession

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = np.zeros(size), np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                m, t = np.vstack(pdf[x].to_numpy()), pdf[y].to_numpy(dtype=float)
                q = 1 / (1 + np.exp(-np.clip(m @ held.value, -35, 35)))
                g += m.T @ (t - q)
                h += (m * (q * (1 - q))[:, None]).T @ m
        yield pd.DataFrame({"i": np.arange(size + size * size), "v": np.concatenate([g, h.ravel()])})

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(w)
        got = rows.select(x, y).mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        if not len(got):
            break
        step = np.linalg.solve(got[size:].reshape(size, size) + penalty * np.eye(size), got[:size] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_predict(df: DataFrame, split: str, label: str, columns: Sequence[str], keep: Sequence[str], c: float = 1.0) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Predictions for the test rows and the coefficients.

    The intercept is a constant feature and is penalised like any weight; the penalty is 1/c. Rows
    without a label are left out of the fit.
    """
    train = df.where((F.col(split) == "train") & F.col(label).isNotNull())
    st = train_stats(train, columns)
    ready = scale(df, st).withColumn("__x", F.array(*(F.col(f"z_{x}") for x in columns), F.lit(1.0))).withColumn("__y", F.col(label).cast("double"))
    rows = ready.where((F.col(split) == "train") & F.col("__y").isNotNull()).select("__x", "__y").persist()
    w = newton(rows, "__x", "__y", len(columns) + 1, 1 / c)
    rows.unpersist()
    z = F.aggregate(F.arrays_zip(F.col("__x").alias("a"), F.array(*(F.lit(float(v)) for v in w)).alias("b")), F.lit(0.0), lambda t, e: t + e["a"] * e["b"])
    p = 1 / (1 + F.exp(-z))
    out = ready.where(F.col(split) == "test").select(*keep, F.col(label).alias("actual"), p.alias("probability"), (p > 0.5).alias("predicted"))
    return out, list(zip([*columns, "intercept"], [float(v) for v in w], strict=True))


def confusion(pred: DataFrame) -> DataFrame:
    """(actual, predicted, n)."""
    return pred.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(pred: DataFrame) -> DataFrame:
    both = F.count_if(F.col("actual") & F.col("predicted"))
    return pred.agg(F.count_if("predicted").alias("flagged"), both.alias("right"), F.count_if("actual").alias("hits"), (both / F.nullif(F.count_if("predicted"), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if("actual"), F.lit(0))).alias("recall"))
