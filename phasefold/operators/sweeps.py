"""Skill over embedding dimensions, horizons and localisation.

Each sweep is one pass: distances are made once for a few queries and grow lag by
lag, neighbours are found once wherever the swept setting doesn't change them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasefold.functions.scoring import Metric, skill_by
from phasefold.plans.blocks import Problem, availability, frames, over_blocks

from . import kernels as K
from .smap import neighbour_count

#: The strengths tested where none are given.
THETAS = (0.01, 0.1, 0.3, 0.5, 0.75, 1, 1.5, 2, 3, 4, 5, 6, 7, 8, 9)


def _rows(names: tuple, made: np.ndarray, truth: np.ndarray) -> tuple:
    return (*[[v] * len(made) for v in names], made, np.where(np.isinf(truth), np.nan, truth))


def embedding_sweep(train: DataFrame, x: list[str], y: list[str] | None = None, test: DataFrame | None = None, dimensions: int = 10, step: int = -1, horizon: int = 1, k: int = 0, radius: int = 0, joint: bool = True, shared_rows: bool = False, mask: str | None = None, by: Metric = "plain") -> DataFrame:
    """(target, variable, e, skill): ``variable`` is null in a joint sweep. Without ``y`` each variable predicts itself.

    Each dimension uses the states complete at that dimension; ``shared_rows``
    keeps those complete at the largest one in all variables, and scores the rows
    whose truths are all there.
    """
    self_only, y = y is None, y or x
    lib, qry = frames(train, x, y, test, dimensions, step, (horizon,), mask, whole=shared_rows)
    groups = [(x[i], [i], [i]) for i in range(len(x))] if self_only else [(None, list(range(len(x))), list(range(len(y))))] if joint else [(x[i], [i], list(range(len(y)))) for i in range(len(x))]

    def work(p: Problem) -> Iterator[tuple]:
        p.Y = np.where(np.isinf(p.Y), np.nan, p.Y)
        for at in p.parts():
            use = np.isfinite(p.T[at]).all(1) if shared_rows else np.ones(len(p.T[at]), dtype=bool)
            for variable, sources, targets in groups:
                d2 = p.shut(at, np.zeros((len(p.Q[at]), len(p.S))))
                whole = use.copy()
                for e in range(1, dimensions + 1):
                    for v in sources:
                        d2 = d2 + p.squared(at, v * dimensions + e - 1)
                        whole &= np.isfinite(p.Q[at, v * dimensions + e - 1])
                    if not whole.any():
                        break
                    idx, near = p.nearest(at, np.sqrt(np.where(np.isnan(d2), np.inf, d2)), k or e * len(sources) + 1)
                    pred = K.simplex_fit(near, p.Y[idx])[0]
                    for j in targets:
                        yield _rows((y[j], variable, e), pred[whole, j], p.T[at][whole, j])

    rows = over_blocks(lib, qry, work, "target string, variable string, e int, pred double, actual double", test is None, radius)
    return skill_by(rows, ["target", "variable", "e"], by)


def best_dimension(sweep: DataFrame) -> DataFrame:
    """The smallest dimension of greatest skill; nulls come last."""
    w = Window.partitionBy("target", "variable").orderBy(F.desc_nulls_last("skill"), "e")
    return sweep.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def own_dimension(train: DataFrame, x: list[str], test: DataFrame | None = None, dimensions: int = 10, **more) -> dict[str, int]:
    """The dimension at which each variable's history best predicts itself; a skill that can't be told counts as 0."""
    swept = embedding_sweep(train, x, None, test, dimensions, shared_rows=True, **more)
    return {r["variable"]: r["e"] for r in best_dimension(swept.withColumn("skill", F.coalesce("skill", F.lit(0.0)))).collect()}


def horizon_sweep(train: DataFrame, x: list[str], y: list[str], test: DataFrame | None = None, dimensions: int = 1, step: int = -1, horizons: list[int] | None = None, k: int = 0, radius: int = 0, shared_neighbors: bool = False, mask: str | None = None, by: Metric = "plain") -> DataFrame:
    """(target, horizon, skill). Each horizon has its own rows, or, with ``shared_neighbors``, those usable at the largest one and one search."""
    hs = list(horizons or range(1, 11))
    lib, qry = frames(train, x, y, test, dimensions, step, hs, mask)
    far = hs.index(max(hs))

    def work(p: Problem) -> Iterator[tuple]:
        y_at = lambda i: slice(i, None, len(hs))
        for at in p.parts():
            d = np.sqrt(p.shut(at, sum(p.squared(at, c) for c in range(p.S.shape[1]))))
            found = None
            for i, h in enumerate(hs):
                edge = far if shared_neighbors else i
                if found is None or not shared_neighbors:
                    usable = ~np.isinf(p.Y[:, edge])
                    found = p.nearest(at, np.where(usable, d, np.inf), k or p.S.shape[1] + 1)
                idx, near = found
                asked = ~np.isinf(p.T[at, edge])
                target = np.where(np.isinf(p.Y[:, y_at(i)]), np.nan, p.Y[:, y_at(i)])
                pred = K.simplex_fit(near, target[idx])[0]
                for j, t in enumerate(y):
                    yield _rows((t, h), pred[asked, j], p.T[at][asked, j * len(hs) + i])

    rows = over_blocks(lib, qry, work, "target string, horizon int, pred double, actual double", test is None, radius)
    return skill_by(rows, ["target", "horizon"], by)


def theta_sweep(train: DataFrame, x: list[str], y: list[str], test: DataFrame | None = None, dimensions: int = 1, step: int = -1, horizon: int = 1, thetas: tuple[float, ...] = THETAS, k: int = 0, radius: int = 0, mask: str | None = None, by: Metric = "plain") -> DataFrame:
    """(target, theta, skill) of the S-map; neighbours are found once for all strengths."""
    lib, qry = frames(train, x, y, test, dimensions, step, (horizon,), mask)
    n, m, most = availability(lib, qry, radius, test is None)
    size = neighbour_count(k, n, most) if n and m else k

    def work(p: Problem) -> Iterator[tuple]:
        for at in p.parts():
            d = np.sqrt(p.shut(at, sum(p.squared(at, c) for c in range(p.S.shape[1]))))
            idx, near = p.nearest(at, d, size)
            for theta in thetas:
                pred = np.array([K.smap_fit(a[np.isfinite(a)], p.S[i[np.isfinite(a)]], p.Y[i[np.isfinite(a)]], s, float(theta))[0] for a, i, s in zip(near, idx, p.Q[at], strict=True)])
                for j, t in enumerate(y):
                    yield _rows((t, float(theta)), pred[:, j], p.T[at][:, j])

    rows = over_blocks(lib, qry, work, "target string, theta double, pred double, actual double", test is None, radius, (n, m))
    return skill_by(rows, ["target", "theta"], by)
