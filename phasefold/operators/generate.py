"""Closed-loop generation: each prediction becomes the next observation. Every run is one task's unit of work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.functions.scoring import finite
from phasefold.plans.blocks import check_columns

from . import kernels as K
from .latest import q


def generate(series: DataFrame, x: list[str], steps: int, dimensions: int, step: int = -1, k: int = 0, theta: float | None = None) -> DataFrame:
    """(run_id, pos, variable, value) of ``steps`` rows after each run; simplex, or S-map where ``theta`` is given.

    The training set stays the observed run. Raises where a lag leaves the run.
    """
    if step > 0:
        raise ValueError("generation needs lags of the past")
    check_columns(series, x)
    back = (dimensions - 1) * -step

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        run = pdf.sort_values("pos")[[f"c{i}" for i in range(len(x))]].to_numpy(dtype=float)
        if len(run) <= back:
            raise ValueError("a lag leaves the series")
        lags = K.lag_stack(run, dimensions, step)[:-1]
        whole = np.isfinite(lags).all(1)
        S, Y = lags[whole], run[1:][whole]
        grown = np.vstack([run, np.empty((steps, run.shape[1]))])
        for n in range(len(run), len(run) + steps):
            state = K.lag_stack(grown[n - 1 - back : n], dimensions, step)[-1]
            d = np.sqrt(((S - state) ** 2).sum(1))
            at = np.argsort(d, kind="stable")[: len(S) if theta is not None and not k else k or S.shape[1] + 1]
            grown[n] = K.simplex_fit(d[None, at], Y[at][None])[0][0] if theta is None else K.smap_fit(d[at], S[at], Y[at], state, theta)[0]
        new = grown[len(run) :]
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "pos": np.repeat(np.arange(len(run), len(run) + steps), len(x)), "variable": x * steps, "value": new.ravel()})

    rows = series.select(F.col("run_id").cast("long").alias("run_id"), "pos", *[finite(F.col(q(c)).cast("double")).alias(f"c{i}") for i, c in enumerate(x)])
    return rows.groupBy("run_id").applyInPandas(grow, "run_id long, pos long, variable string, value double").withColumn("value", finite(F.col("value")))
