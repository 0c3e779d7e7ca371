"""Surrogate series for significance tests: shuffled, phase-randomised, or seasonal with shuffled rests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.functions.scoring import finite
from phasefold.plans.blocks import check_columns

from .latest import q

METHODS = ("random_shuffle", "ebisuzaki", "seasonal")


def smoothed(v: np.ndarray, smooth: float) -> np.ndarray:
    """Penalised least squares on second differences, in place of a smoothing spline: five bands, solved in O(n)."""
    n = len(v)
    if n < 3:
        return v.copy()
    one, two = np.zeros(n), np.zeros(n)
    main = np.ones(n)
    for a, b, c in ((0, 1, 2),):
        i = np.arange(n - 2)
        np.add.at(main, i + a, smooth)
        np.add.at(main, i + b, 4 * smooth)
        np.add.at(main, i + c, smooth)
        np.add.at(one, i, -2 * smooth)
        np.add.at(one, i + 1, -2 * smooth)
        np.add.at(two, i, smooth)
    d, l1, l2, z = np.empty(n), np.zeros(n), np.zeros(n), np.empty(n)
    for i in range(n):  # L D L' of the symmetric band matrix
        e1 = l1[i - 1] if i else 0.0
        e2 = l2[i - 2] if i > 1 else 0.0
        d[i] = main[i] - (d[i - 1] * e1 * e1 if i else 0.0) - (d[i - 2] * e2 * e2 if i > 1 else 0.0)
        l1[i] = (one[i] - (d[i - 1] * e1 * l2[i - 1] if i else 0.0)) / d[i]
        l2[i] = two[i] / d[i]
        z[i] = v[i] - (e1 * z[i - 1] if i else 0.0) - (e2 * z[i - 2] if i > 1 else 0.0)
    out = z / d
    for i in range(n - 2, -1, -1):
        out[i] -= l1[i] * out[i + 1] + (l2[i] * out[i + 2] if i + 2 < n else 0.0)
    return out


def surrogate(v: np.ndarray, method: str, rng: np.random.Generator, alpha: float | None = None, smooth: float = 100.0) -> np.ndarray:
    n = len(v)
    if method == "random_shuffle":
        return rng.permutation(v)
    if method == "ebisuzaki":
        f = np.fft.rfft(v - v.mean())
        turn = np.exp(2j * np.pi * rng.random(len(f)))
        turn[0] = 1
        if n % 2 == 0:  # the highest frequency stays real
            turn[-1] = np.sqrt(2) * np.cos(2 * np.pi * rng.random())
        w = np.fft.irfft(f * turn, n)
        return v.mean() + w * (v.std() / w.std() if w.std() > 0 else 1.0)
    trend = smoothed(v, smooth)
    noise = rng.normal(0, (np.ptp(v) / 5 if alpha is None else alpha), n)
    return trend + rng.permutation(v - trend) + noise


def surrogates(series: DataFrame, column: str, method: str, number: int, seed: int = 0, alpha: float | None = None, smooth: float = 100.0) -> DataFrame:
    """(surrogate_id, run_id, pos, value): ``number`` seeded surrogates of every run, each a task's unit of work."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    check_columns(series, [column])

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        i, run = int(pdf["surrogate_id"].iloc[0]), int(pdf["run_id"].iloc[0])
        return pd.DataFrame({"surrogate_id": i, "run_id": run, "pos": pdf["pos"], "value": surrogate(pdf["value"].to_numpy(dtype=float), method, np.random.default_rng([seed, i, abs(run)]), alpha, smooth)})

    rows = series.select(F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("surrogate_id"), F.col("run_id").cast("long").alias("run_id"), F.col("pos").cast("long").alias("pos"), finite(F.col(q(column)).cast("double")).alias("value"))
    return rows.groupBy("surrogate_id", "run_id").applyInPandas(make, "surrogate_id int, run_id long, pos long, value double").withColumn("value", finite(F.col("value")))


def write_csv(made: DataFrame, path: str) -> None:
    """Surrogates as CSV with a header, on any file system that Spark reaches."""
    made.orderBy("surrogate_id", "run_id", "pos").write.mode("overwrite").option("header", True).csv(path)
