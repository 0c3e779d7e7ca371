"""S-map: a linear map around every test state, fitted with weights that fall with distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.plans.blocks import Problem, availability, frames, over_blocks

from . import kernels as K


def neighbour_count(k: int, n: int, most: int) -> int:
    """``k``, or all neighbours that every query has; raises beyond those."""
    if k > n - most:
        raise ValueError(f"k={k} but only {n - most} neighbours are available")
    return k or n - most


def smap(train: DataFrame, x: list[str], y: list[str], test: DataFrame | None = None, dimensions: int = 1, step: int = -1, horizon: int = 1, k: int = 0, radius: int = 0, theta: float = 0.0, mask: str | None = None) -> DataFrame:
    """(run_id, pos, target, pred, variance, coef, sv) for every row of ``test`` (of ``train`` without one).

    Rows that can't be predicted have null. ``k`` 0 means all available
    neighbours. A neighbour without a target drops out of that target's fit only;
    without any target there is no prediction.
    """
    lib, qry = frames(train, x, y, test, dimensions, step, (horizon,), mask)
    n, m, most = availability(lib, qry, radius, test is None)
    size = neighbour_count(k, n, most) if n and m else k

    def work(p: Problem) -> Iterator[tuple]:
        for at in p.parts():
            d = np.sqrt(p.shut(at, sum(p.squared(at, c) for c in range(p.S.shape[1]))))
            idx, near = p.nearest(at, d, size)
            out = []
            for i, (r, pos) in enumerate(zip(p.q_run[at].tolist(), p.q_pos[at].tolist(), strict=True)):
                ok = np.isfinite(near[i])
                pred, var, coef, sv = K.smap_fit(near[i][ok], p.S[idx[i][ok]], p.Y[idx[i][ok]], p.Q[at][i], theta)
                out += [(r, pos + horizon, t, pred[j], var[j], coef[j].tolist(), sv[j].tolist()) for j, t in enumerate(y)]
            if out:
                yield tuple(zip(*out, strict=True))

    made = over_blocks(lib, qry, work, "run_id long, pos long, target string, pred double, variance double, coef array<double>, sv array<double>", test is None, radius, (n, m))
    made = made.withColumn("coef", F.when(F.col("pred").isNotNull(), F.col("coef"))).withColumn("sv", F.when(F.col("pred").isNotNull(), F.col("sv")))
    return on_spine(made, train if test is None else test, y)


def on_spine(made: DataFrame, base: DataFrame, y: list[str]) -> DataFrame:
    """Predictions of every row of ``base`` and target, null where there is none."""
    spine = base.select(F.col("run_id").cast("long").alias("run_id"), F.col("pos").cast("long").alias("pos"), F.explode(F.array(*[F.lit(t) for t in y])).alias("target"))
    return spine.join(made, ["run_id", "pos", "target"], "left")
