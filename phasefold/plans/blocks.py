"""All-pairs kernels over blocks of queries.

Every task holds some test states and is shown all training states, which reach
it through a shuffle in order of run and position; nothing passes through the
driver. Inside a task distances are made for a few queries at a time, so memory
follows the library, not its square. Axes of a sweep (dimension, horizon, draw,
candidate, view) are walked inside the task, on distances made once; predictions
leave as rows and are scored by Spark.

All of these methods compare each test state with each training state: the work
is the product of both, by definition of the method, whatever the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasefold.functions.scoring import finite
from phasefold.operators.latest import q

MOST_NUMBERS = 50_000_000  # numbers of a library that one task holds (400 MB)
LEAST_QUERIES, MOST_QUERIES = 64, 20_000  # of a task
PAIRS = 4_000_000  # distances held at once


def check_columns(df: DataFrame, names: list[str]) -> None:
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"columns {lost} are missing")
    if not names:
        raise ValueError("at least one column is needed")


def _states(series: DataFrame, x: list[str], y: list[str], dimensions: int, step: int, horizons: list[int], more: list[Column]) -> DataFrame:
    """(run_id, pos, state, y, ...): lags may be null; y[target, horizon] is null where missing, infinite where no such row is."""
    w = Window.partitionBy("run_id").orderBy("pos")
    value = lambda c: finite(F.col(q(c)).cast("double"))
    lags = [F.lag(value(c), -i * step).over(w) if i else value(c) for c in x for i in range(dimensions)]
    at = lambda c, h: F.lead(value(c), h).over(w) if h else value(c)
    there = {h: F.lead("pos", h).over(w).isNotNull() if h else F.lit(True) for h in horizons}
    targets = [F.when(there[h], at(c, h)).otherwise(F.lit(float("inf"))) for c in y for h in horizons]
    return series.select("run_id", "pos", F.array(*lags).alias("state"), F.array(*targets).alias("y"), *more)


def complete(state: str = "state") -> Column:
    return F.forall(state, lambda e: e.isNotNull())


def has_row(y: str = "y") -> Column:
    """Whether the target row of at least one horizon lies in the run."""
    return F.exists(y, lambda e: e.isNull() | (e < float("inf")))


def frames(train: DataFrame, x: list[str], y: list[str], test: DataFrame | None = None, dimensions: int = 1, step: int = -1, horizons: tuple[int, ...] | list[int] = (1,), mask: str | None = None, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(library, queries): states with targets and truths. ``whole`` keeps complete states only."""
    if dimensions < 1:
        raise ValueError("the embedding needs at least one dimension")
    if step == 0 and dimensions > 1:
        raise ValueError("step must not be 0")
    check_columns(train, [*x, *y, *([mask] if mask else [])])
    if test is not None:
        check_columns(test, [*x, *y])
    lib = _states(train, x, y, dimensions, step, list(horizons), [(F.coalesce(F.col(q(mask)).cast("boolean"), F.lit(False)) if mask else F.lit(True)).alias("in_library")])
    qry = lib if test is None else _states(test, x, y, dimensions, step, list(horizons), [F.lit(True).alias("in_library")])
    keep = (complete() if whole else F.lit(True)) & has_row()
    return lib.where(keep & F.col("in_library")).drop("in_library"), qry.where(keep)


def availability(lib: DataFrame, qry: DataFrame, radius: int = 0, in_sample: bool = True) -> tuple[int, int, int]:
    """(training states, test states, most training states that one test state excludes), by one aggregation."""
    both = lib.select("run_id", "pos", F.lit(1).alias("l"), F.lit(0).alias("q")).unionByName(qry.select("run_id", "pos", F.lit(0).alias("l"), F.lit(1).alias("q")))
    if not in_sample:
        n, m = both.agg(F.sum("l"), F.sum("q")).first()
        return n or 0, m or 0, 0
    rows = both.groupBy("run_id", "pos").agg(F.max("l").alias("l"), F.max("q").alias("q"))
    near = F.sum("l").over(Window.partitionBy("run_id").orderBy("pos").rangeBetween(-radius, radius))
    n, m, most = rows.withColumn("near", near).agg(F.sum("l"), F.sum("q"), F.max(F.when(F.col("q") == 1, F.col("near")))).first()
    return n or 0, m or 0, most or 0


@dataclass
class Problem:
    """Training states S with targets Y, test states Q with truths T, and where they are."""

    S: np.ndarray
    Y: np.ndarray
    s_run: np.ndarray
    s_pos: np.ndarray
    Q: np.ndarray
    T: np.ndarray
    q_run: np.ndarray
    q_pos: np.ndarray
    inside: bool
    radius: int

    def parts(self) -> Iterator[slice]:
        size = int(max(1, min(256, PAIRS // max(1, len(self.S)))))
        return (slice(a, a + size) for a in range(0, len(self.Q), size))

    def shut(self, at: slice, d: np.ndarray) -> np.ndarray:
        """Distances [queries, library], infinite for excluded and incomplete training states."""
        d = np.where(np.isnan(d), np.inf, d)
        if self.inside:
            d[(self.q_run[at, None] == self.s_run) & (np.abs(self.q_pos[at, None] - self.s_pos) <= self.radius)] = np.inf
        return d

    def squared(self, at: slice, column: int) -> np.ndarray:
        return (self.Q[at, column, None] - self.S[None, :, column]) ** 2

    def nearest(self, at: slice, d: np.ndarray, k: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, distance) of the k nearest, ties by time gap (in-sample), then by run and position."""
        r, pos = (self.s_run, self.s_pos) if rows is None else (self.s_run[rows], self.s_pos[rows])
        k = min(k, d.shape[1])
        idx = np.empty((len(d), k), dtype=np.int64)
        q_run, q_pos = self.q_run[at], self.q_pos[at]
        for i, row in enumerate(d):
            if k < len(row):
                c = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])  # ties at the edge stay in
            else:
                c = np.arange(len(row))
            if len(c) > k and not np.isfinite(row[c]).all():
                c = c[np.argsort(row[c], kind="stable")[: max(k, int(np.isfinite(row[c]).sum()))]]
            if self.inside:
                gap = np.where(r[c] == q_run[i], np.abs(pos[c] - q_pos[i]), 1 << 40)
                c = c[np.lexsort((c, gap, row[c]))]
            else:
                c = c[np.lexsort((c, row[c]))]
            idx[i] = c[:k]
        return idx, np.take_along_axis(d, idx, 1)


def query_groups(spark: SparkSession, m: int) -> int:
    """Groups into which m test states are spread; each is shown the library."""
    return int(max(1, min(m // LEAST_QUERIES, max(spark.sparkContext.defaultParallelism, -(-m // MOST_QUERIES)))))


def over_blocks(lib: DataFrame, qry: DataFrame, work: Callable[[Problem], Iterator[tuple]], schema: str, in_sample: bool, radius: int = 0, sizes: tuple[int, int] | None = None, library_blocks: int = 1) -> DataFrame:
    """Rows of the column tuples that ``work`` yields for each block of queries; NaN becomes null.

    ``sizes``: training and test states, where they are known. With several
    ``library_blocks`` each task is shown one of them, and each query is asked of
    all. Raises ValueError where either side is empty or a block of the library
    too large for a task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if radius and not in_sample:
        raise ValueError("an exclusion radius needs predictions of the training runs")
    n, m = sizes or availability(lib, qry, in_sample=False)[:2]
    if n == 0 or m == 0:
        raise ValueError("no complete training or test state")
    spark = lib.sparkSession
    groups = query_groups(spark, m)
    own = F.pmod(F.xxhash64("run_id", "pos"), F.lit(library_blocks)).cast("int")
    shown = lib.select(F.explode(F.sequence(own, own + (groups - 1) * library_blocks, F.lit(library_blocks))).alias("g"), F.lit(0).alias("role"), "run_id", "pos", "state", "y")
    group = F.pmod(F.xxhash64("pos", "run_id"), F.lit(groups)).cast("int") * library_blocks
    asked = qry.select(F.explode(F.sequence(group, group + library_blocks - 1)).alias("g"), F.lit(1).alias("role"), "run_id", "pos", "state", "y")
    rows = shown.unionByName(asked).withColumn("run_id", F.col("run_id").cast("long")).withColumn("pos", F.col("pos").cast("long"))
    groups *= library_blocks
    rows = rows.repartition(groups, "g").sortWithinPartitions("g", "role", "run_id", "pos")
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    limit = MOST_NUMBERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held: dict) -> Iterator[pa.RecordBatch]:
            if not held[0] or not held[1]:
                return
            sides = [[np.concatenate(c) for c in zip(*held[r], strict=True)] for r in (0, 1)]
            (s_run, s_pos, s, y), (q_run, q_pos, qs, t) = sides
            for out in work(Problem(s, y, s_run, s_pos, qs, t, q_run, q_pos, in_sample, radius)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(out, arrow, strict=True)], schema=arrow)

        now, held = None, {0: [], 1: []}
        for b in batches:
            if not b.num_rows:
                continue
            g, role = b.column("g").to_numpy(), b.column("role").to_numpy()
            run_id, pos = b.column("run_id").to_numpy(), b.column("pos").to_numpy()
            wide = [b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) for c in ("state", "y")]
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(role) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if g[a] != now:
                    if now is not None:
                        yield from finish(held)
                    now, held = g[a], {0: [], 1: []}
                held[int(role[a])].append((run_id[a:z], pos[a:z], wide[0][a:z], wide[1][a:z]))
                if role[a] == 0 and sum(x[2].size + x[3].size for x in held[0]) > limit:
                    raise ValueError("the library is too large for a task: fewer states, or neighbors(), which cuts it into blocks")
        if now is not None:
            yield from finish(held)

    return rows.mapInArrow(run, schema)
