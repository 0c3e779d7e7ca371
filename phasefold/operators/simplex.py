"""Simplex projection: weighted averages over the nearest states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.functions.scoring import Metric, correlation_or_zero, metric
from phasefold.plans.blocks import availability, check_columns

from .embedding import library, query
from .latest import q
from .neighbors import neighbors


def project(near: DataFrame, targets: list[str]) -> DataFrame:
    """(run_id, pos, target, pred, variance) from neighbours; null where a neighbour's target is null.

    Weights are exp(-d / max(least d, 1e-6)); the variance is taken around the
    prediction in a second pass over the gathered neighbours.
    """
    got = near.groupBy("run_id", F.col("out_pos").alias("pos")).agg(F.min("d").alias("least"), F.collect_list(F.struct("rank", "d", "y")).alias("near"))
    out = got.select("run_id", "pos", "least", F.array_sort("near").alias("near"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("target")) for i, t in enumerate(targets)])).alias("t"))
    pick = F.transform("near", lambda s: F.struct(F.exp(-s["d"] / F.greatest(F.col("least"), F.lit(1e-6))).alias("w"), F.get(s["y"], F.col("t.i")).alias("y")))
    out = out.select("run_id", "pos", F.col("t.target").alias("target"), pick.alias("wy"))
    total = F.aggregate("wy", F.lit(0.0), lambda a, s: a + s["w"])
    pred = F.aggregate("wy", F.lit(0.0), lambda a, s: a + s["w"] * s["y"]) / total
    out = out.withColumn("pred", pred)
    return out.select("run_id", "pos", "target", "pred", (F.aggregate("wy", F.lit(0.0), lambda a, s: a + s["w"] * (s["y"] - F.col("pred")) * (s["y"] - F.col("pred"))) / total).alias("variance"))


def simplex(train: DataFrame, x: list[str], y: list[str], test: DataFrame | None = None, dimensions: int = 1, step: int = -1, horizon: int = 1, k: int = 0, radius: int = 0, mask: str | None = None) -> DataFrame:
    """(run_id, pos, target, pred, variance) for every row of ``test`` (of ``train`` without one).

    Rows that can't be predicted have null. ``k`` 0 means one more than the
    state's size. Raises ValueError for a radius with a test set, empty training
    or test states, and a ``k`` beyond the neighbours available.
    """
    in_sample = test is None
    if radius and not in_sample:
        raise ValueError("an exclusion radius needs predictions of the training runs")
    check_columns(train, [*x, *y, *([mask] if mask else [])])
    if test is not None:
        check_columns(test, x)
    lib = library(train, x, y, dimensions, step, horizon, mask)
    base = train if in_sample else test
    qry = query(base, x, dimensions, step, horizon)
    k = k or len(x) * dimensions + 1
    n, m, most = availability(lib, qry, radius, in_sample)
    if n == 0 or m == 0:
        raise ValueError("no complete training or test state")
    if k > n - most:
        raise ValueError(f"k={k} but only {n - most} neighbours are available")
    made = project(neighbors(lib, qry, k, in_sample, radius, sizes=(n, m), dimensions=len(x) * dimensions), y)
    spine = base.select("run_id", "pos", F.explode(F.array(*[F.lit(t) for t in y])).alias("target"))
    return spine.join(made, ["run_id", "pos", "target"], "left")


def truth(series: DataFrame, y: list[str]) -> DataFrame:
    """(run_id, pos, target, actual) in long form."""
    return series.select("run_id", "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(q(c)).cast("double").alias("actual")) for c in y])).alias("s")).select("run_id", "pos", "s.*")


def score(predictions: DataFrame, series: DataFrame, y: list[str], by: Metric = "correlation") -> DataFrame:
    """(target, score) over all runs together. ``by`` names a metric or is a function of the actual and the predicted column.

    Raises ValueError where the truths of a target are missing from ``series``.
    """
    check_columns(series, y)
    both = predictions.join(truth(series, y), ["run_id", "pos", "target"])
    f = correlation_or_zero if by == "correlation" else metric(by)
    return both.groupBy("target").agg(f(F.col("actual"), F.col("pred")).alias("score"))
