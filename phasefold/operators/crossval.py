"""Folds of runs, and selection and cross mapping over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasefold.functions.scoring import Metric

from .crossmap import cross_map, mean_skill
from .selection import Choice, choose, predict_selected
from .simplex import score


def fold_edges(n: int, folds: int) -> list[tuple[int, int]]:
    """Contiguous blocks between whole-number edges; empty ones are skipped."""
    edges = [int(n * i / folds) for i in range(folds + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def with_folds(series: DataFrame, folds: int | None = None) -> DataFrame:
    """The series with ``fold``: one fold a run, or ``folds`` contiguous blocks of every run."""
    if folds is None:
        runs = series.select("run_id").distinct()
        ranked = runs.withColumn("fold", F.dense_rank().over(Window.orderBy("run_id")) - 1)  # one row a run
        return series.join(ranked, "run_id")
    n = F.max("pos").over(Window.partitionBy("run_id")) + 1
    edge = lambda i: F.floor(n * i / folds)
    at: Column = F.lit(folds - 1)
    for i in range(folds - 1, -1, -1):
        at = F.when(F.col("pos") < edge(i + 1), i).otherwise(at)
    return series.withColumn("fold", at)


def split(series: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test runs of a fold; what lies before and after the test block are runs of their own."""
    ends = Window.partitionBy("run_id")
    first = F.min(F.when(F.col("fold") == fold, F.col("pos"))).over(ends)
    side = F.when(F.col("fold") == fold, 1).when(F.col("pos") < first, 0).otherwise(2)
    rows = series.withColumn("__s", F.when(first.isNull(), F.lit(0)).otherwise(side))
    rows = rows.withColumn("run_id", F.col("run_id") * 3 + F.col("__s"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")).cast("long") - 1)
    return rows.where(F.col("fold") != fold).drop("__s", "fold"), rows.where(F.col("fold") == fold).drop("__s", "fold")


def choose_by_fold(series: DataFrame, candidates: list[str], target: str, folds: int | None = None, **settings) -> list[tuple[int, Choice]]:
    """(fold, choice) of the greedy choice in every fold, scored on its test block."""
    marked = with_folds(series, folds)
    return [(f, choose(train, candidates, target, test, **settings)) for f in _folds(marked) for train, test in [split(marked, f)]]


def select_by_fold(series: DataFrame, candidates: list[str], target: str, folds: int | None = None, **settings) -> list[tuple[int, list[tuple]]]:
    """(fold, steps) of the greedy choice in every fold."""
    return [(f, c.steps) for f, c in choose_by_fold(series, candidates, target, folds, **settings)]


def stepwise_scores(by_fold: list[tuple[int, list[tuple]]]) -> list[tuple[int, int, str, float]]:
    """(fold, step, variable, score) of the variable chosen at each step."""
    return [(f, s[0], s[1], s[2]) for f, steps in by_fold for s in steps]


def fold_predictions(series: DataFrame, by_fold: list[tuple[int, list[tuple]]], target: str, folds: int | None = None, horizon: int = 1, k: int = 0) -> DataFrame:
    """(fold, run_id, pos, target, pred): each fold's test block predicted from the variables chosen there.

    Run ids are those of ``split``: three times the run's, plus one for the test
    block. A fold that chose nothing has null predictions.
    """
    marked = with_folds(series, folds)
    out = None
    for f, steps in by_fold:
        train, test = split(marked, f)
        one = predict_selected(train, [s[1] for s in steps], target, test, horizon, k=k).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out.select("fold", "run_id", "pos", "target", "pred")


def fold_scores(series: DataFrame, predictions: DataFrame, target: str, folds: int | None = None, by: Metric = "correlation") -> DataFrame:
    """(fold, target, score) of ``fold_predictions`` against the held-out rows."""
    marked = with_folds(series, folds).withColumn("run_id", F.col("run_id") * 3 + 1)
    marked = marked.withColumn("pos", F.row_number().over(Window.partitionBy("run_id", "fold").orderBy("pos")).cast("long") - 1)
    out = None
    for f in _folds(marked):
        one = score(predictions.where(F.col("fold") == f).drop("fold"), marked.where(F.col("fold") == f), [target], by).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out.select("fold", "target", "score")


def frequent_variables(by_fold: list[tuple[int, list[tuple]]], n: int) -> list[str]:
    """The n variables chosen in most folds, ties by name."""
    count: dict[str, int] = {}
    for _, steps in by_fold:
        for s in steps:
            count[s[1]] = count.get(s[1], 0) + 1
    return sorted(count, key=lambda v: (-count[v], v))[:n]


def best_fold(by_fold: list[tuple[int, list[tuple]]]) -> int | None:
    """The first fold of the highest last score; folds that chose nothing come last."""
    scored = [(f, s[-1][2]) for f, s in by_fold if s]
    return max(scored, key=lambda x: (x[1], -x[0]))[0] if scored else None


FINAL = ("best_fold", "frequency", "reselect")


def final_variables(series: DataFrame, by_fold: list[tuple[int, list[tuple]]], candidates: list[str], target: str, how: str = "best_fold", most: int = 5, **settings) -> list[str]:
    """The choice to keep: that of the best fold, the most frequent ones, or a new in-sample choice among all that any fold chose."""
    if how not in FINAL:
        raise ValueError(f"how must be one of {FINAL}")
    if how == "frequency":
        return frequent_variables(by_fold, most)
    if how == "reselect":
        pool = {s[1] for _, steps in by_fold for s in steps}
        rest = {k: v for k, v in settings.items() if k not in ("gate", "test")}
        return choose(series, [c for c in candidates if c in pool], target, None, most=most, gate=False, **rest).variables if pool else []
    best = best_fold(by_fold)
    return [s[1] for f, steps in by_fold if f == best for s in steps]


def cross_map_by_fold(series: DataFrame, sources: list[str], targets: list[str], folds: int | None = None, **settings) -> DataFrame:
    """(lib_size, source, target, mean, std): over folds, with the population's deviation."""
    if settings.get("mode") == "sample" or settings.get("radius"):
        raise ValueError("folds are scored out of sample: neither mode 'sample' nor a radius")
    marked = with_folds(series, folds)
    out = None
    for f in _folds(marked):
        train, test = split(marked, f)
        one = mean_skill(cross_map(train, sources, targets, test, **settings)).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("lib_size", "source", "target").agg(F.avg("skill").alias("mean"), F.stddev_pop("skill").alias("std"))


def _folds(marked: DataFrame) -> list[int]:
    return sorted(r[0] for r in marked.select("fold").distinct().collect())
