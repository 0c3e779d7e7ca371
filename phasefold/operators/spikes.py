"""Implausible readings, judged beside their own source.

Each source has two robust exponentially weighted control charts, one run
forward and one backward in time. A chart predicts a reading from the mean and
the scale of the readings before it, and clips suspected readings before they
update mean and scale, so that a spike neither moves the mean nor widens the
limits. A reading is a spike if both charts flag it on the same side and the
run-length counter of such readings stays within ``max_run``: a change of level
that lasts is flagged by one chart only. A second counter finds stuck runs, and
physical limits come first: what cannot exist never reaches the charts.

Large sources are cut into blocks of their own readings, so a source with a third
of all rows is spread over many tasks. Readings are counted by stretches of the
order key first, and blocks are made of whole stretches. A block also gets the
stretches with the ``pad`` readings before and after it to warm its charts up;
only its own readings are judged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasefold.functions.arrow_groups import group_starts, whole_groups
from phasefold.session import materialize


@dataclass(frozen=True)
class Limits:
    """What a measurement can be. ``unit``: one unit of the last digit kept."""

    low: float
    high: float
    unit: float
    log_scale: bool
    floor: float = 0.02


@dataclass(frozen=True)
class Chart:
    """``rate`` and ``scale_rate``: weights of the newest reading; ``clip``: in scales; ``sigmas``: flags beyond."""

    rate: float = 0.35
    scale_rate: float = 0.03
    clip: float = 2.0
    sigmas: float = 4.0
    max_run: int = 3
    stuck_run: int = 6


def ew_chart(y: np.ndarray, floor: float, c: Chart) -> np.ndarray:
    """How many scales each reading lies from the robust exponentially weighted mean of those before."""
    z = np.empty(len(y))
    steps = np.abs(np.diff(y[:41]))
    scale = max(float(np.median(steps)) * 1.05 if len(steps) else floor, floor)
    mean = float(np.median(y[:5]))
    clip, rate, slow = c.clip, c.rate, c.scale_rate
    for i, v in enumerate(y.tolist()):
        r = v - mean
        z[i] = r / scale
        bound = clip * scale
        if r > bound:
            r = bound
        elif r < -bound:
            r = -bound
        mean += rate * r
        scale += slow * (1.25 * abs(r) - scale)
        if scale < floor:
            scale = floor
    return z


def stuck_runs(v: np.ndarray, unit: float, least: int) -> np.ndarray:
    """Readings in runs of ``least`` or more at one non-zero value, give or take one unit."""
    out = np.zeros(len(v), dtype=bool)
    if len(v) < least:
        return out
    near = np.abs(np.diff(v)) <= 2.2 * unit
    near &= (v[1:] != 0) & (v[:-1] != 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a + 1 < least:
            continue
        i = a
        while i <= b:
            low = high = v[i]
            j = i + 1
            while j <= b and max(high, v[j]) - min(low, v[j]) <= 2.2 * unit:
                low, high = min(low, v[j]), max(high, v[j])
                j += 1
            if j - i >= least:
                out[i:j] = True
                i = j
            else:
                i += 1
    return out


def lone_zeros(v: np.ndarray) -> np.ndarray:
    """Zeros of a source that never runs dry: none of its zeros stands beside another zero or a value under 1 % of its median."""
    zero = v == 0
    if not zero.any():
        return zero
    low = v < 0.01 * np.median(v)
    beside = np.zeros(len(v), dtype=bool)
    beside[1:] |= low[:-1]
    beside[:-1] |= low[1:]
    return zero & ~(zero & beside).any()


def resumes(y: np.ndarray, a: int, b: int) -> bool:
    """Whether the course steps back after y[a:b] as it stepped away before; a flood recedes by and by."""
    away, back = y[a] - y[a - 1], y[b - 1] - y[b]
    return away * back > 0 and min(abs(away), abs(back)) >= 0.45 * max(abs(away), abs(back))


def judge(v: np.ndarray, lim: Limits, c: Chart = Chart()) -> np.ndarray:
    """Reasons for one source's readings in time order: 0 none, 1 impossible, 2 spike, 3 stuck. NaN is never flagged."""
    out = np.zeros(len(v), dtype=np.int8)
    there = ~np.isnan(v)
    bad = there & ((v < lim.low) | (v > lim.high))
    out[bad] = 1
    at = np.flatnonzero(there & ~bad)
    stuck = stuck_runs(v[at], lim.unit, c.stuck_run)
    use = ~stuck & ((v[at] > 0) | lone_zeros(v[at])) if lim.log_scale else ~stuck
    pos = at[use]
    y = np.log(np.maximum(v[pos], lim.unit)) if lim.log_scale else v[pos]
    if len(pos) >= 5:
        fore, back = ew_chart(y, lim.floor, c), ew_chart(y[::-1], lim.floor, c)[::-1]
        size = np.minimum(np.abs(fore), np.abs(back))
        far, sure = size > c.sigmas, size > 2 * c.sigmas  # at either end one side of the course is missing
        far &= np.sign(fore) == np.sign(back)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], far, [False])).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            inner = a > 0 and b < len(y)
            if b - a <= c.max_run and (resumes(y, a, b) if inner else sure[a:b].all()):
                out[pos[a:b]] = 2
    out[at[stuck]] = 3
    return out


def flag_readings(df: DataFrame, source: Column, order: Column, record_id: Column, fields: dict[str, tuple[Column, Limits]], chart: Chart = Chart(), block: int = 65536, pad: int = 512, keys: int = 4096) -> DataFrame:
    """(field, record_id, reason) of the implausible readings; reason is 'impossible', 'spike' or 'stuck'.

    ``fields`` names each measurement with its value and limits; all are judged
    in one pass, each by itself. ``df`` has one row per reading that holds. Null
    or NaN values are missing: they are never flagged and update nothing. Rows
    without source, order key or id are left out, since no normal behaviour can
    be told for them. Ties of the order key go by record_id. ``block`` and
    ``pad`` are counted in a source's readings, stretches are ``keys`` order keys
    long. An empty table gives an empty result; other columns of ``df`` are
    ignored.
    """
    values = {f"v{i}": (name, lim) for i, (name, (_, lim)) in enumerate(fields.items())}
    slim = df.select(source.cast("string").alias("source"), order.cast("long").alias("pos"), record_id.cast("long").alias("record_id"), *[v.cast("double").alias(f"v{i}") for i, (v, _) in enumerate(fields.values())])
    there = [f"({v} IS NOT NULL AND NOT isnan({v}))" for v in values]
    slim = slim.where("source IS NOT NULL AND pos IS NOT NULL AND record_id IS NOT NULL").where(" OR ".join(there))
    slim = materialize(slim.withColumn("stretch", F.floor(F.col("pos") / keys)))
    # readings of a large source before each of its stretches: at most one row a stretch
    order_in = Window.partitionBy("source").orderBy("stretch")
    counts = slim.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(order_in) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("source")))
    large = counts.where(F.col("all") > block).select("source", "stretch", "n", "before")
    placed = slim.join(large, ["source", "stretch"], "left")
    cell = lambda c: F.greatest(F.floor(c / block), F.lit(0))
    own = F.coalesce(cell(F.col("before")), F.lit(0))
    near = F.array_distinct(F.array(own, F.coalesce(cell(F.col("before") - pad), own), F.coalesce(cell(F.col("before") + F.col("n") - 1 + pad), own)))
    spread = placed.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == own).drop("stretch", "n", "before")
    sorted_rows = spread.repartition("source", "block").sortWithinPartitions("source", "block", "pos", "record_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(["", "impossible", "spike", "stuck"], dtype=object)
        for t in whole_groups(batches, ["source", "block"]):
            t = t.combine_chunks()
            cols = [t.column(k).combine_chunks() for k in ("source", "block")]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            starts = np.append(group_starts(cols), t.num_rows)
            own_rows, ids = (t.column(k).to_numpy() for k in ("own", "record_id"))
            for column, (name, lim) in values.items():
                v = t.column(column).to_numpy()
                why = np.zeros(t.num_rows, dtype=np.int8)
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    at = np.flatnonzero(~np.isnan(v[a:b])) + a
                    why[at] = judge(v[at], lim, chart)
                hit = np.flatnonzero((why > 0) & own_rows.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(ids[hit], pa.int64()), pa.array(names[why[hit]], pa.string())], ["field", "record_id", "reason"])

    return sorted_rows.mapInArrow(run, "field string, record_id long, reason string")
