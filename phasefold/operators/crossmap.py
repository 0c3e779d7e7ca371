"""Convergent cross mapping: skill of predicting targets from a source's states over library sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasefold.functions.scoring import Metric, skill_by
from phasefold.plans.blocks import Problem, availability, check_columns, frames, over_blocks

from . import kernels as K
from .sweeps import own_dimension

#: Shares of the samples taken as library sizes where none are given.
SHARES = (0.1, 0.25, 0.5, 0.75, 0.9)

Dimensions = int | dict[str, int] | dict[tuple[str, str], int] | None


def draws(n: int, sizes: list[int], repeats: int, seed: int | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, repeat, rows drawn without replacement); sizes beyond ``n`` take all rows."""
    rng = np.random.default_rng(seed)
    return ((s, r, rng.choice(n, size=min(s, n), replace=False)) for s in sizes for r in range(repeats))


def dimension_table(dimensions: int | dict, sources: list[str], targets: list[str]) -> dict[tuple[str, str], int]:
    """The dimension of every (source, target) from one number, one for each source, or one for each pair."""
    if isinstance(dimensions, int):
        return {(s, t): dimensions for s in sources for t in targets}
    return {(s, t): dimensions[s, t] if (s, t) in dimensions else dimensions[s] for s in sources for t in targets}


def cross_map(train: DataFrame, sources: list[str], targets: list[str] | None = None, test: DataFrame | None = None, dimensions: Dimensions = 3, step: int = -1, horizon: int = 0, k: int = 0, radius: int = 0, sizes: list[int] | None = None, repeats: int = 20, seed: int | None = 0, mode: str = "variables", mask: str | None = None, subsets: list[tuple[int, int, np.ndarray]] | None = None, max_dimensions: int = 10, by: Metric | None = None) -> DataFrame:
    """(lib_size, source, target, repeat, skill). Without ``targets`` every source maps every source.

    ``mode`` 'variables' scores all test rows and clamps the correlation's
    denominator, so a constant prediction has skill about 0; 'sample' scores the
    training states only (and then takes no test set) and gives null there.
    ``dimensions`` is one number, one for each source, one for each (source,
    target), of which 'variables' takes the largest of a source, or None: the one
    at which a source best predicts itself, up to ``max_dimensions``. All sources
    share the rows complete at the largest dimension, and one table of draws.
    """
    if mode not in ("variables", "sample"):
        raise ValueError("mode must be 'variables' or 'sample'")
    if mode == "sample" and test is not None:
        raise ValueError("mode 'sample' scores training states; it takes no test set")
    if radius and test is not None:
        raise ValueError("an exclusion radius needs predictions of the training runs")
    targets = list(targets) if targets is not None else list(sources)
    check_columns(train, [*sources, *targets])
    if dimensions is None:
        dimensions = own_dimension(train, sources, test, max_dimensions, step=step, horizon=horizon, radius=radius, mask=mask)
    dims = dimension_table(dimensions, sources, targets)
    if mode == "variables":
        dims = {(s, t): max(dims[s, u] for u in targets) for s, t in dims}
    top = max(dims.values())
    lib, qry = frames(train, sources, targets, test, top, step, (horizon,), mask)
    if mode == "sample":
        qry = lib
    inside = test is None
    n, m, _ = availability(lib, qry, in_sample=False)
    if sizes is None and subsets is None:
        rows = train.count()
        sizes = [int(rows * f) for f in SHARES]

    def work(p: Problem) -> Iterator[tuple]:
        made = list(subsets) if subsets is not None else list(draws(n, sizes, repeats, seed))
        for at in p.parts():
            use = np.isfinite(p.T[at]).all(1)
            if not use.any():
                continue
            for i, source in enumerate(sources):
                d2, whole = p.shut(at, np.zeros((len(p.Q[at]), len(p.S)))), {}
                for e in range(1, max(dims[source, t] for t in targets) + 1):
                    d2 = d2 + p.squared(at, i * top + e - 1)
                    of = [j for j, t in enumerate(targets) if dims[source, t] == e]
                    if of:
                        whole[e] = np.sqrt(d2), of
                for e, (d, of) in whole.items():
                    for size, repeat, rows in made:
                        idx, near = p.nearest(at, d[:, rows], k or e + 1, rows)
                        pred = K.simplex_fit(near, p.Y[rows][idx])[0][use]
                        for j in of:
                            got = len(pred)
                            yield [size] * got, [source] * got, [targets[j]] * got, [repeat] * got, pred[:, j], p.T[at][use, j]

    rows = over_blocks(lib, qry, work, "lib_size int, source string, target string, repeat int, pred double, actual double", inside, radius, (n, m))
    return skill_by(rows, ["lib_size", "source", "target", "repeat"], by or ("clamped" if mode == "variables" else "plain"), strict=True)


def mean_skill(skills: DataFrame) -> DataFrame:
    return skills.groupBy("lib_size", "source", "target").agg(F.when(F.count("skill") == F.count("*"), F.avg("skill")).alias("skill"))


def convergence(skills: DataFrame, n: int | Column) -> DataFrame:
    """(source, target, slope): least-squares slope of mean skill on the library's share of ``n`` states."""
    n = F.lit(n) if isinstance(n, int) else n
    return mean_skill(skills).groupBy("source", "target").agg(F.regr_slope("skill", F.least(F.col("lib_size"), n) / n.cast("double")).alias("slope"))
