"""Nearest training states of every test state.

Each test state has every training state as a candidate, by definition. Few pairs
(both sides are counted) are a join with a broadcast library in the JVM. For more,
the library is cut into blocks by a hash, the queries into groups; a task compares
one group with one block by numpy and keeps k best, which are ranked once more
over all blocks. With complete states in few dimensions only the cells of the space
that a query's nearest can lie in are compared (``plans.cells``), if that shuffles
fewer rows and no state fills the library. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasefold.plans.blocks import Problem, over_blocks, query_groups
from phasefold.plans.cells import Map, chart, copies, fan_out, heaviest, nearest_in_cells

JOIN_PAIRS = 1_000_000  # pairs that a join compares; a broadcast library has at most as many rows
BLOCK_ROWS = 500_000  # training states of a block
MOST_DIMENSIONS = 8  # of states for which cells are tried


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def neighbors(lib: DataFrame, qry: DataFrame, k: int, in_sample: bool = False, radius: int = 0, join_pairs: int = JOIN_PAIRS, block_rows: int = BLOCK_ROWS, sizes: tuple[int, int] | None = None, dimensions: int | None = None) -> DataFrame:
    """(run_id, pos, out_pos, rank, d, l_run, l_pos, y): the k nearest library rows of each query.

    Ties go by the gap in time (in-sample only), then by run and position of the
    library row. In-sample, rows of the same run within ``radius`` (at least the
    row itself) are excluded. Queries with fewer candidates get them all.
    ``sizes``: rows of library and queries, where they are known. ``dimensions``:
    the states' size, where they are known to be complete.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n, m = sizes or (lib.count(), qry.count())
    if n * m <= join_pairs and n <= JOIN_PAIRS:
        left = lib.select(F.col("run_id").alias("l_run"), F.col("pos").alias("l_pos"), F.col("state").alias("l_state"), "y")
        pairs = qry.join(F.broadcast(left), _allowed(in_sample, radius))
        near = pairs.select("run_id", "pos", "out_pos", distance(F.col("state"), F.col("l_state")).alias("d"), "l_run", "l_pos", "y")
    elif (to := _cells(lib, k, in_sample, radius, n, m, dimensions)) is not None:
        near = nearest_in_cells(lib, qry, to, n, m)
    else:

        def work(p: Problem) -> Iterator[tuple]:
            for at in p.parts():
                idx, d = p.nearest(at, np.sqrt(p.shut(at, sum(p.squared(at, c) for c in range(p.S.shape[1])))), k)
                i, j = np.nonzero(np.isfinite(d))
                hit = idx[i, j]
                yield p.q_run[at][i], p.q_pos[at][i], p.T[at][i, 0].astype(np.int64), d[i, j], p.s_run[hit], p.s_pos[hit], p.Y[hit].tolist()

        asked = qry.withColumn("y", F.array(F.col("out_pos").cast("double")))
        schema = "run_id long, pos long, out_pos long, d double, l_run long, l_pos long, y array<double>"
        near = over_blocks(lib, asked, work, schema, in_sample, radius, (n, m), -(-n // block_rows))
    gap = F.abs(F.col("l_pos") - F.col("pos"))
    far = F.when(F.col("l_run") == F.col("run_id"), gap).otherwise(F.lit(1 << 40)) if in_sample else F.lit(0)
    best = Window.partitionBy("run_id", "pos").orderBy("d", far, "l_run", "l_pos")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("run_id", "pos", "out_pos", "d", "l_run", "l_pos", "y", "rank")


def _cells(lib: DataFrame, k: int, in_sample: bool, radius: int, n: int, m: int, dimensions: int | None) -> Map | None:
    """Cells of the library, if they shuffle fewer rows than blocks do and no state is so frequent that its cell has more pairs than a block's task."""
    if not dimensions or dimensions > MOST_DIMENSIONS:
        return None
    to, groups = chart(lib, k, in_sample, radius, n), query_groups(lib.sparkSession, m)
    if to is None or heaviest(to) ** 2 * groups > copies(to, m):
        return None
    return to if n * copies(to, m) + m * fan_out(to) < n * groups + m else None


def _allowed(in_sample: bool, radius: int) -> Column:
    if not in_sample:
        return F.lit(True)
    return ~((F.col("l_run") == F.col("run_id")) & (F.abs(F.col("l_pos") - F.col("pos")) <= radius))
