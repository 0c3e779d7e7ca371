"""Spike charts, regular grid and latest rows: brute force and edge cases."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasefold.operators.latest import latest_rows
from phasefold.operators.regular_grid import read_moment, regular_grid
from phasefold.operators.spikes import Limits, flag_readings, judge, stuck_runs

FLOW = Limits(0.0, 2e6, 0.1, True)


def course(n: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.round(np.exp(5 + 0.5 * np.sin(np.arange(n) / 9) + rng.normal(0, 0.05, n)), 1)


def test_spikes_are_flagged_and_floods_are_not():
    v = course(120)
    v[30] *= 20
    v[60:63] /= 15
    v[90:100] *= np.exp(np.r_[np.linspace(0.2, 1.2, 5), np.linspace(1.2, 0.2, 5)])  # a flood
    assert np.flatnonzero(judge(v, FLOW) == 2).tolist() == [30, 60, 61, 62]


def test_impossible_stuck_missing_and_zero():
    v = course(80)
    v[5], v[6], v[7] = -999.9, 1e9, np.nan
    v[20:27] = 77.7
    v[22] = 77.8
    v[40:50] = 0.0
    got = judge(v, FLOW)
    assert np.flatnonzero(got == 1).tolist() == [5, 6]
    assert np.flatnonzero(got == 3).tolist() == list(range(20, 27))
    assert not got[40:50].any() and got[7] == 0


def test_a_zero_is_a_spike_only_where_no_dry_spell_is():
    v = course(80)
    v[30] = 0.0
    assert np.flatnonzero(judge(v, FLOW)).tolist() == [30]
    v[60:64] = 0.0
    assert not judge(v, FLOW).any()


def test_stuck_runs_need_length_and_stay_within_one_unit():
    assert stuck_runs(np.array([1.0, 1, 1, 1, 1, 2]), 0.1, 6).sum() == 0
    assert stuck_runs(np.zeros(9), 0.1, 6).sum() == 0
    assert stuck_runs(np.array([5.0, 1, 1, 1.1, 1, 1, 0.9, 5]), 0.1, 6).tolist() == [False, *[True] * 6, False]


def test_blocks_change_nothing(spark):
    """A source cut into blocks gives what it gives in one piece."""
    v = course(3000, 3)
    v[[100, 999, 1000, 1500, 2047, 2048]] *= 30
    rows = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "s string, i long, v double")
    flags = lambda b, order, k: {r["record_id"] for r in flag_readings(rows, F.col("s"), order, F.col("i"), {"v": (F.col("v"), FLOW)}, block=b, pad=200, keys=k).collect()}
    one, many = flags(1 << 20, F.col("i"), 4096), flags(1024, F.col("i"), 64)
    assert one == many >= {100, 1500}
    # ids shared out over many sources: a source's keys are far apart
    assert flags(1024, F.col("i") * 997 + 5, 5000) == one


def test_flags_with_nulls_empty_and_clashing_columns(spark):
    schema = "s string, i long, v double, reason string, record_id long, block int"
    rows = [("s", i, float(x), "r", 1, 2) for i, x in enumerate(course(40))] + [(None, 1, 5.0, None, None, None), ("s", None, 5.0, None, None, None), ("s", 7, None, None, None, None), ("s", 8, float("nan"), None, None, None), ("t", 9, -1.0, None, None, None)]
    call = lambda d: flag_readings(d, F.col("s"), F.col("i"), F.col("i"), {"v": (F.col("v"), FLOW), "w": (F.col("block").cast("double"), FLOW)})
    got = call(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in got.where("field = 'v'").collect()] == [("v", 9, "impossible")] and got.where("field = 'w' AND reason = 'stuck'").count() == 40
    assert call(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("1983-04-01", "1983-04-01 00:00"), (" 1983/04/01 ", "1983-04-01 00:00"), ("19830401", "1983-04-01 00:00"), ("1983-04-01T10:20:30", "1983-04-01 10:20"),
        ("01-Apr-1983", "1983-04-01 00:00"), ("1 April 1983 07:05", "1983-04-01 07:05"), ("1983-04-01 25:61", "1983-04-01 00:00"), ("1983-02-30", None),
        ("1983-04", None), ("see log sheet", None), ("", None), (None, None), ("30-Feb-1983", None),
    ],
)
def test_moments(spark, text, want):
    got = spark.createDataFrame([(text,)], "d string").select(read_moment(F.col("d"))).first()[0]
    assert (got and got.strftime("%Y-%m-%d %H:%M")) == want


def brute_grid(rows, kind):
    """Increments by cell from all consecutive pairs, an hour at a time."""
    out = {}
    by = {}
    for s, t, v in rows:
        by.setdefault(s, []).append((t, v))
    zero = dt.datetime(1979, 12, 31)
    for s, r in by.items():
        r.sort()
        for (a, x), (b, y) in zip(r, r[1:], strict=False):
            hours = (b - a).total_seconds() / 3600
            total = (y if y < x else y - x) if kind == "counter" else (x + y) / 2 * hours
            for h in range(int(hours)):
                c = (a + dt.timedelta(hours=h) - zero).days // 7
                out[s, c] = out.get((s, c), 0) + total / hours
    return out


@pytest.mark.parametrize("kind", ["level", "counter"])
def test_grid_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(s, dt.datetime(1980, 1, 1) + dt.timedelta(hours=int(h)), float(rng.integers(0, 50))) for s in "ab" for h in rng.choice(2000, 25, replace=False)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "s string, t timestamp_ntz, v double, o long")
    got = regular_grid(df, F.col("s"), F.col("t"), F.col("v"), F.col("o"), "1979-12-31", 7, kind, max_gap_days=1e6).collect()
    want = brute_grid(rows, kind)
    zero = dt.datetime(1979, 12, 31)
    for r in got:
        assert math.isclose(r["amount"] or 0.0, want.get((r["source"], (r["cell"] - zero).days // 7), 0.0), abs_tol=1e-6)
    for s in "ab":
        cells = sorted((r["cell"] - zero).days // 7 for r in got if r["source"] == s)
        assert cells == list(range(cells[0], cells[-1] + 1))


def test_grid_marks_and_edges(spark):
    t = lambda d: dt.datetime(1980, 1, 1) + dt.timedelta(days=d)
    rows = [("a", t(0), 1.0, 1), ("a", t(20), 2.0, 2), ("a", t(90), 3.0, 3), ("b", t(0), 1.0, 4), ("c", t(0), None, 5), (None, t(0), 1.0, 6), ("d", t(0), float("nan"), 7), ("a", t(0), 1.0, 1)]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, v double, o long")
    call = lambda d: regular_grid(d, F.col("s"), F.col("t"), F.col("v"), F.col("o"), "1979-12-31").collect()
    got = {(r["source"], r["cell"].strftime("%m-%d")): (r["status"], r["n_readings"]) for r in call(df)}
    assert {s for s, _ in got} == {"a", "b"}
    assert got["a", "12-31"] == ("observed", 2) and got["a", "01-07"] == ("filled", 0) and got["a", "02-11"] == ("uncovered", 0)
    assert call(df.where("false")) == []
    with pytest.raises(ValueError):
        regular_grid(df, F.col("s"), F.col("t"), F.col("v"), F.col("o"), "1979-12-31", kind="x")


def test_latest_rows(spark):
    d = dt.datetime
    rows = [(1, d(2000, 1, 1), 5.0), (1, d(2000, 1, 2), None), (2, None, 1.0), (2, d(1990, 1, 1), 2.0), (3, d(2000, 1, 1), 9.0), (3, d(2000, 1, 1), 4.0), (None, d(2000, 1, 1), 1.0), (4, None, 3.0)]
    df = spark.createDataFrame(rows, "k long, at timestamp_ntz, `v.x` double")
    assert {tuple(r) for r in latest_rows(df, ["k"], "at", ["v.x"]).collect()} == {(1, None), (2, 2.0), (3, 4.0), (4, 3.0)}
