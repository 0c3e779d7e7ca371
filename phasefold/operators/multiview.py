"""Multiview embedding: the mean of the best predictions from many small views of the lag stack."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.functions.scoring import plain_correlation
from phasefold.plans.blocks import Problem, frames, over_blocks

from . import kernels as K
from .smap import on_spine


def views(n: int, size: int) -> list[tuple[int, ...]]:
    return list(combinations(range(n), min(size, n)))


def view_predictions(train: DataFrame, x: list[str], y: list[str], test: DataFrame | None, combos: list[tuple[int, ...]], dimensions: int, step: int, horizon: int, k: int, radius: int, rated: bool) -> DataFrame:
    """(view, run_id, pos, target, pred, actual) of every view; ``rated``: of the first target only."""
    lib, qry = frames(train, x, y, test, dimensions, step, (horizon,))

    def work(p: Problem) -> Iterator[tuple]:
        for at in p.parts():
            each: dict[int, np.ndarray] = {}
            for view, combo in enumerate(combos):
                for c in combo:
                    if c not in each:
                        each[c] = p.squared(at, c)
                idx, near = p.nearest(at, np.sqrt(p.shut(at, sum(each[c] for c in combo))), k or len(combo) + 1)
                pred = K.simplex_fit(near, p.Y[idx])[0]
                n = len(pred)
                for j, t in enumerate(y[:1] if rated else y):
                    yield [view] * n, p.q_run[at], p.q_pos[at] + horizon, [t] * n, pred[:, j], p.T[at][:, j]

    return over_blocks(lib, qry, work, "view int, run_id long, pos long, target string, pred double, actual double", test is None, radius)


def multiview(train: DataFrame, x: list[str], y: list[str], test: DataFrame | None = None, dimensions: int = 1, step: int = -1, horizon: int = 1, k: int = 0, radius: int = 0, view_size: int = 0, top: int = 0, rank_inside: bool = True) -> tuple[DataFrame, DataFrame]:
    """(predictions, views): (run_id, pos, target, pred) of every row and (rank, combo, corr, max_ae, sum_ae, rmse).

    Views rank by the first target's correlation, in the training runs or out of
    sample; ties go by the combination. A view without a prediction at a row
    leaves the mean there null, as do rows that can't be predicted.
    """
    combos = views(len(x) * dimensions, view_size or len(x))
    rated = view_predictions(train, x, y, None if rank_inside else test, combos, dimensions, step, horizon, k, radius, True)
    a, p = F.col("actual"), F.col("pred")
    e = F.when(a.isNotNull() & p.isNotNull(), F.abs(a - p))
    table = rated.groupBy("view").agg(plain_correlation(a, p).alias("corr"), F.max(e).alias("max_ae"), F.sum(e).alias("sum_ae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    most = min(len(combos), top or max(1, isqrt(len(combos))))
    best = table.orderBy(F.desc_nulls_last("corr"), "view").limit(most).collect()  # as many as there are views kept
    spark = train.sparkSession
    ranked = spark.createDataFrame([(i + 1, list(combos[r["view"]]), r["corr"], r["max_ae"], r["sum_ae"], r["rmse"]) for i, r in enumerate(best)], "rank int, combo array<int>, corr double, max_ae double, sum_ae double, rmse double")
    each = view_predictions(train, x, y, test, [combos[r["view"]] for r in best], dimensions, step, horizon, k, radius, False)
    mean = each.groupBy("run_id", "pos", "target").agg(F.when(F.count("pred") == len(best), F.avg("pred")).alias("pred"))
    return on_spine(mean, train if test is None else test, y), ranked
