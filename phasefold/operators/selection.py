"""Greedy choice of the variables that best predict a target (manifold dimensional expansion)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.functions.scoring import Metric, finite, skill_by
from phasefold.plans.blocks import Problem, availability, check_columns, frames, over_blocks
from phasefold.session import materialize

from . import kernels as K
from .crossmap import cross_map, mean_skill
from .latest import q
from .simplex import simplex
from .smap import smap
from .sweeps import best_dimension, embedding_sweep

GATES = ("pre", "post", False)
METRICS = {"correlation": "plain", "r2": "r2"}


def _scored(lib: DataFrame, qry: DataFrame, names: list[str], chosen: list[str], pool: list[str], inside: bool, radius: int, metric: Metric, sizes: tuple[int, int]) -> DataFrame:
    """(variable, skill) of adding each of ``pool``: the chosen columns' distances are made once for all."""
    have, new = [names.index(c) for c in chosen], [names.index(c) for c in pool]

    def work(p: Problem) -> Iterator[tuple]:
        for at in p.parts():
            use = np.isfinite(p.T[at][:, 0])
            if not use.any():
                continue
            d2 = p.shut(at, np.zeros((len(p.Q[at]), len(p.S))))
            for c in have:
                d2 = d2 + p.squared(at, c)
            for c in new:
                idx, near = p.nearest(at, np.sqrt(d2 + p.squared(at, c)), len(have) + 2)
                pred = K.simplex_fit(near, p.Y[idx])[0][use, 0]
                yield [names[c]] * len(pred), pred, p.T[at][use, 0]

    rows = over_blocks(lib, qry, work, "variable string, pred double, actual double", inside, radius, sizes)
    return skill_by(rows, ["variable"], METRICS.get(metric, metric) if isinstance(metric, str) else metric, strict=True)


def candidate_scores(train: DataFrame, candidates: list[str], target: str, chosen: list[str] = (), test: DataFrame | None = None, horizon: int = 1, radius: int = 0, metric: Metric = "correlation", mask: str | None = None) -> DataFrame:
    """(variable, score) of adding each candidate to the chosen columns; k is the number of columns plus one."""
    names = [*dict.fromkeys([*chosen, *candidates])]
    lib, qry = frames(train, names, [target], test, 1, -1, (horizon,), mask)
    n, m, _ = availability(lib, qry, in_sample=False)
    return _scored(lib, qry, names, list(chosen), [c for c in candidates if c not in chosen], test is None, radius, metric, (n, m)).withColumnRenamed("skill", "score")


def candidate_dimensions(train: DataFrame, candidates: list[str], target: str, test: DataFrame | None = None, dimensions: int = 10, step: int = -1, horizon: int = 1, radius: int = 0, mask: str | None = None) -> DataFrame:
    """(variable, e, skill): the dimension at which each candidate's history best predicts the target, and that skill."""
    swept = embedding_sweep(train, candidates, [target], test, dimensions, step, horizon, radius=radius, joint=False, shared_rows=True, mask=mask)
    return best_dimension(swept).select("variable", "e", "skill")


def convergence_slopes(train: DataFrame, candidates: list[str], target: str, dimensions: int | dict[str, int], n: int, percents: tuple[int, ...], repeats: int, seed: int, step: int, horizon: int, radius: int, mask: str | None = None) -> dict[str, float]:
    """Slope of skill over library share (of ``n`` states) when the target's history cross-maps each candidate.

    Fewer than two library sizes tell nothing: the slope is 0.5 then. A skill
    that can't be told gives minus infinity. All candidates share the rows
    complete at their largest dimension.
    """
    sizes = [int(p / 100 * n) for p in percents]
    if len(sizes) < 2:
        return {c: 0.5 for c in candidates}
    table = dimensions if isinstance(dimensions, int) else {(target, c): dimensions[c] for c in candidates}
    got = cross_map(train, [target], candidates, None, table, step, horizon, 0, radius, sizes, repeats, seed, "sample", mask)
    share = F.col("lib_size") / F.lit(float(n))
    rows = mean_skill(got).groupBy("target").agg(F.when(F.count("skill") == F.count("*"), F.regr_slope("skill", share)).alias("slope")).collect()
    found = {r["target"]: r["slope"] for r in rows}
    return {c: float("-inf") if found.get(c) is None else found[c] for c in candidates}


@dataclass
class Choice:
    """``steps``: (step, variable, score, slope); ``scores``: (step, variable, score) of all candidates; ``dimensions``: (variable, e, peak)."""

    steps: list[tuple[int, str, float, float | None]] = field(default_factory=list)
    scores: list[tuple[int, str, float | None]] = field(default_factory=list)
    dimensions: list[tuple[str, int, float | None]] = field(default_factory=list)

    @property
    def variables(self) -> list[str]:
        return [s[1] for s in self.steps]


def choose(train: DataFrame, candidates: list[str], target: str, test: DataFrame | None = None, most: int = 5, horizon: int = 1, radius: int = 0, metric: Metric = "correlation", least_score: float = 0.0, include_target: bool = False, gate: str | bool = False, least_slope: float = 0.01, dimensions: int | None = 3, step: int = -1, percents: tuple[int, ...] = (10, 25, 50, 75), repeats: int = 10, seed: int = 0, spread: float = 0.0, max_dimensions: int = 10, least_peak: float = 0.0, mask: str | None = None) -> Choice:
    """The greedy choice with all that led to it; it stops when no candidate passes.

    Candidates with a standard deviation below ``spread`` never enter. ``gate``
    'pre' filters all candidates by convergence first, 'post' checks the best
    ones in order of score and remembers the verdicts; a candidate converges if
    its slope exceeds ``least_slope``. With a gate and ``dimensions`` None each
    candidate's own dimension is searched up to ``max_dimensions``, and those
    whose best skill is below ``least_peak`` leave the pool. A ``least_score``
    above 0 is asked for at each step. An included target counts toward ``most``.
    Each step is one job over all candidates.
    """
    if gate not in GATES:
        raise ValueError("gate must be 'pre', 'post' or False")
    if isinstance(metric, str) and metric not in METRICS:
        raise ValueError("metric must be 'correlation', 'r2' or a function of columns")
    check_columns(train, [*candidates, target])
    names = [*dict.fromkeys([*candidates, *([target] if include_target else [])])]
    keep = [*dict.fromkeys([*names, target, *([mask] if mask else [])])]
    train = materialize(train.select("run_id", "pos", *[F.col(q(c)) for c in keep]))
    test = None if test is None else materialize(test.select("run_id", "pos", *[F.col(q(c)) for c in keep if c != mask]))
    spreads = train.agg(*[F.stddev_pop(finite(F.col(q(c)).cast("double"))).alias(f"s{i}") for i, c in enumerate(names)]).first()
    chosen = [target] if include_target else []
    pool = [c for c in candidates if (spreads[names.index(c)] or 0.0) >= spread and c not in chosen]
    lib, qry = (materialize(f) for f in frames(train, names, [target], test, 1, -1, (horizon,), mask))
    n, m, _ = availability(lib, qry, in_sample=False)
    out = Choice()
    own: int | dict[str, int] | None = dimensions
    if gate and dimensions is None and pool:
        rows = candidate_dimensions(train, pool, target, test, max_dimensions, step, horizon, radius, mask).collect()
        out.dimensions = sorted((r["variable"], r["e"], r["skill"]) for r in rows)
        own = {v: e for v, e, _ in out.dimensions}
        if least_peak > 0:
            pool = [c for c in pool if any(v == c and s is not None and s >= least_peak for v, _, s in out.dimensions)]
    slopes: dict[str, float] = {}
    of = lambda c: own if isinstance(own, int) or own is None else own[c]
    if gate == "pre" and pool:
        pre = convergence_slopes(train, pool, target, own, n, percents, repeats, seed, step, horizon, radius, mask)
        pool = [c for c in pool if pre[c] > least_slope]
    while len(chosen) < most and pool:
        rated = {r["variable"]: r["skill"] for r in _scored(lib, qry, names, chosen, pool, test is None, radius, metric, (n, m)).collect()}
        number = len(out.steps) + 1
        out.scores += [(number, c, rated.get(c)) for c in pool]
        order = sorted((c for c in pool if rated.get(c) is not None), key=lambda c: (-rated[c], names.index(c)))
        if least_score > 0:
            order = [c for c in order if rated[c] >= least_score]
        pick = order[0] if order and gate != "post" else None
        if gate == "post":
            for c in order:
                if c not in slopes:  # each with the rows of its own dimension, so one at a time
                    slopes |= convergence_slopes(train, [c], target, of(c), n, percents, repeats, seed, step, horizon, radius, mask)
                if slopes[c] > least_slope:
                    pick = c
                    break
        if pick is None:
            break
        chosen.append(pick)
        pool.remove(pick)
        out.steps.append((number, pick, rated[pick], slopes.get(pick)))
    return out


def select_variables(train: DataFrame, candidates: list[str], target: str, test: DataFrame | None = None, **settings) -> list[tuple[int, str, float, float | None]]:
    """Steps (step, variable, score, slope) of ``choose``."""
    return choose(train, candidates, target, test, **settings).steps


def predict_selected(train: DataFrame, variables: list[str], target: str, test: DataFrame | None = None, horizon: int = 1, radius: int = 0, k: int = 0, theta: float | None = None, mask: str | None = None) -> DataFrame:
    """(run_id, pos, target, pred) of every row from the chosen variables: simplex, or S-map where ``theta`` is given.

    Without variables every prediction is null.
    """
    base = train if test is None else test
    if not variables:
        return base.select("run_id", "pos", F.lit(target).alias("target"), F.lit(None).cast("double").alias("pred"))
    if theta is not None:
        return smap(train, variables, [target], test, 1, -1, horizon, k, radius, theta, mask).select("run_id", "pos", "target", "pred")
    return simplex(train, variables, [target], test, 1, -1, horizon, k, radius, mask).select("run_id", "pos", "target", "pred")
