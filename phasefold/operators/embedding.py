"""Lagged states, training pairs and test states of runs, as window expressions.

A series is a DataFrame with ``run_id``, ``pos`` (0, 1, 2 ... without gaps) and
value columns. Windows never cross runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasefold.functions.scoring import finite

from .latest import q


def in_run():
    return Window.partitionBy("run_id").orderBy("pos")


def check(dimensions: int, step: int) -> None:
    if dimensions < 1:
        raise ValueError("the embedding needs at least one dimension")
    if step == 0 and dimensions > 1:
        raise ValueError("step must not be 0")


def regular_series(df: DataFrame, moment: Column, value: Column, unit: str, run: Column | None = None, fill: float | None = 0.0, digits: int = 4) -> DataFrame:
    """(run_id, pos, v): sums of ``value`` by ``unit`` ('hour', 'day', 'week', 'month') on a dense spine.

    Periods without rows get ``fill``; rows with a null moment or run are dropped.
    """
    run = run if run is not None else F.lit(0)
    base = df.select(run.alias("run_id"), F.date_trunc(unit, moment).cast("timestamp_ntz").alias("t"), value.cast("double").alias("v")).where("t IS NOT NULL AND run_id IS NOT NULL")
    sums = base.groupBy("run_id", "t").agg(F.round(F.sum("v"), digits).alias("v"))
    edges = sums.groupBy().agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = edges.select(F.posexplode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("pos", "t"))
    runs = sums.select("run_id").distinct().join(F.broadcast(spine))  # one row of periods for each run: the size of the result
    return runs.join(sums, ["run_id", "t"], "left").select("run_id", F.col("pos").cast("long").alias("pos"), F.coalesce("v", F.lit(fill)).alias("v"))


def state_column(columns: list[str], dimensions: int, step: int) -> Column:
    """ARRAY of lags grouped by variable: v[pos], v[pos+step], ... for each; null elements where a lag is missing."""
    check(dimensions, step)
    return F.array(*[F.lag(finite(F.col(q(c)).cast("double")), -i * step).over(in_run()) if i else finite(F.col(q(c)).cast("double")) for c in columns for i in range(dimensions)])


def _complete() -> Column:
    return F.forall("state", lambda e: e.isNotNull())


def library(series: DataFrame, x: list[str], y: list[str], dimensions: int = 1, step: int = -1, horizon: int = 1, mask: str | None = None) -> DataFrame:
    """(run_id, pos, state, y): complete states whose target row lies in the run.

    A target that is there but missing stays in as null; ``mask`` names a boolean
    column of the rows allowed as training states.
    """
    there = F.lead("pos", horizon).over(in_run()) if horizon else F.col("pos")
    targets = F.array(*[F.lead(finite(F.col(q(c)).cast("double")), horizon).over(in_run()) if horizon else finite(F.col(q(c)).cast("double")) for c in y])
    rows = series.select("run_id", "pos", state_column(x, dimensions, step).alias("state"), targets.alias("y"), there.alias("__to"), (F.col(q(mask)) if mask else F.lit(True)).alias("__in"))
    return rows.where(F.col("__to").isNotNull() & F.col("__in").cast("boolean") & _complete()).select("run_id", "pos", "state", "y")


def query(series: DataFrame, x: list[str], dimensions: int = 1, step: int = -1, horizon: int = 1) -> DataFrame:
    """(run_id, pos, out_pos, state): complete states and the row they predict, inside the run."""
    ends = Window.partitionBy("run_id")
    rows = series.select("run_id", "pos", (F.col("pos") + horizon).alias("out_pos"), state_column(x, dimensions, step).alias("state"), F.max("pos").over(ends).alias("__n"))
    return rows.where((F.col("out_pos") >= 0) & (F.col("out_pos") <= F.col("__n")) & _complete()).select("run_id", "pos", "out_pos", "state")
