"""Nearest states in few dimensions without comparing all pairs; the result is that of all pairs.

Some training states (landmarks) cut the space into cells of about CELL_ROWS
training states. The k-th nearest landmark of a query bounds its k-th distance, so
the query is sent to just those cells that the ball of this radius touches. A task
holds one cell at a time in a tree of leaves, takes a bound from the query's own
leaf and compares with every leaf within it. Landmarks only bound: every training
state lies in a cell, and none within the bound is left out. Distances to boxes are
added up in the order of the distances to states, so rounding can't put a box
beyond a state inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.plans import blocks

LEAF = 64  # states of a leaf
CELL_ROWS = 4_000  # training states of a cell
LEAST_LANDMARKS, MOST_LANDMARKS = 2_000, 100_000
A_LANDMARK = 32  # training states for each landmark
NEAR_RUN = 1 << 40  # gap in time between runs
TRIALS = 500  # landmarks asked for the number of cells that a query reaches


def _squared(parts: Iterator[np.ndarray]) -> np.ndarray:
    return sum(x * x for x in parts)


class Tree:
    """States in the leaves of a balanced tree, and the k nearest of many queries."""

    def __init__(self, S: np.ndarray, run: np.ndarray, pos: np.ndarray, inside: bool, radius: int) -> None:
        n = len(S)
        self.depth = max(0, int(np.ceil(np.log2(n / LEAF))))
        order, edges, axes, cuts = np.arange(n), [0, n], [], []
        for _ in range(self.depth):
            finer = [0]
            for a, z in pairwise(edges):
                own = S[order[a:z]]
                c, mid = int(np.argmax(own.max(0) - own.min(0))), (z - a) // 2
                by = np.argpartition(own[:, c], mid)
                order[a:z] = order[a:z][by]
                axes.append(c)
                cuts.append(own[by[mid], c])
                finer += [a + mid, z]
            edges = finer
        self.axes, self.cuts, self.edges = np.array(axes, dtype=np.int64), np.array(cuts), np.array(edges)
        self.order, self.S, self.run, self.pos = order, S[order], run[order], pos[order]
        self.low, self.high = (f.reduceat(self.S, self.edges[:-1]) for f in (np.minimum, np.maximum))
        self.inside, self.radius = inside, radius

    def node(self, Q: np.ndarray, depth: int) -> np.ndarray:
        """Of each query, which of the 2 ** depth parts of the space it lies in."""
        at, rows = np.zeros(len(Q), dtype=np.int64), np.arange(len(Q))
        for level in range(depth):
            i = (1 << level) - 1 + at
            at = 2 * at + (Q[rows, self.axes[i]] > self.cuts[i])
        return at

    def regions(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of these parts, which together are the whole space."""
        low, high = np.full((1, self.S.shape[1]), -np.inf), np.full((1, self.S.shape[1]), np.inf)
        for level in range(depth):
            i = np.arange((1 << level) - 1, (2 << level) - 1)
            low, high = low.repeat(2, 0), high.repeat(2, 0)
            high[np.arange(0, len(low), 2), self.axes[i]] = self.cuts[i]
            low[np.arange(1, len(low), 2), self.axes[i]] = self.cuts[i]
        return low, high

    def _distances(self, q: np.ndarray, run: np.ndarray, pos: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        S = self.S[rows]
        d = np.sqrt(_squared(q[:, c, None] - S[None, :, c] for c in range(S.shape[1])))
        if self.inside:
            d[(run[:, None] == self.run[rows]) & (np.abs(pos[:, None] - self.pos[rows]) <= self.radius)] = np.inf
        return d

    def _close(self, q: np.ndarray, run: np.ndarray, pos: np.ndarray, k: int, leaf: int) -> np.ndarray:
        """Rows of all leaves that may hold one of the k nearest of one of the queries, which lie in one leaf."""
        leaves = len(self.edges) - 1
        a, z = leaf, leaf + 1
        while z - a < leaves:
            bound = kth(self._distances(q, run, pos, slice(self.edges[a], self.edges[z])), k)
            if np.isfinite(bound).all():
                near = (reach(q, self.low, self.high) <= bound[:, None]).any(0)
                return np.flatnonzero(np.repeat(near, np.diff(self.edges)))
            size = 2 * (z - a)
            a = a // size * size
            z = a + size
        return np.arange(len(self.S))

    def nearest(self, Q: np.ndarray, run: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, state, distance, rank from 0) of the k nearest, in order of queries and ranks.

        Ties go by time gap (in-sample), then by run and position. Excluded states never count.
        """
        leaf = self.node(Q, self.depth)
        by = np.argsort(leaf, kind="stable")
        out, held = [], 0
        for rows in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1) if len(Q) else []:
            for a in range(0, len(rows), 2 * LEAF):
                some = rows[a : a + 2 * LEAF]
                close = self._close(Q[some], run[some], pos[some], k, int(leaf[some[0]]))
                size = max(1, blocks.PAIRS // len(close))
                for b in range(0, len(some), size):
                    at = some[b : b + size]
                    d = self._distances(Q[at], run[at], pos[at], close)
                    i, j = np.nonzero((d <= kth(d, k)[:, None]) & (d < np.inf))  # ties at the edge stay in
                    out.append((at[i], close[j], d[i, j]))
                    held += len(i)
                    if held > blocks.PAIRS:  # ties without number are not gathered
                        out = [self._best(run, pos, k, out)[:3]]
                        held = len(out[0][0])
        i, j, d, rank = self._best(run, pos, k, out)
        return i, self.order[j], d, rank

    def _best(self, run: np.ndarray, pos: np.ndarray, k: int, out: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        none = np.empty(0, dtype=np.int64)
        i, j, d = (np.concatenate(c) for c in zip((none, none, np.empty(0)), *out, strict=True))
        gap = np.where(self.run[j] == run[i], np.abs(self.pos[j] - pos[i]), NEAR_RUN) if self.inside else np.zeros(len(j), dtype=np.int64)
        best = np.lexsort((self.pos[j], self.run[j], gap, d, i))
        i, j, d = i[best], j[best], d[best]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        kept = rank < k
        return i[kept], j[kept], d[kept], rank[kept]


def kth(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of each row; infinite where there are fewer."""
    return np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances [queries, boxes]; 0 inside."""
    return np.sqrt(_squared(np.maximum(0.0, np.maximum(low[None, :, c] - q[:, c, None], q[:, c, None] - high[None, :, c])) for c in range(q.shape[1])))


class Map:
    """Cells of the space by landmarks, and the cells in which a query's k nearest lie."""

    def __init__(self, tree: Tree, depth: int, k: int) -> None:
        self.tree, self.depth, self.k = tree, min(depth, tree.depth), k
        self.low, self.high = tree.regions(self.depth)

    def cell(self, S: np.ndarray) -> np.ndarray:
        return self.tree.node(S, self.depth)

    def touched(self, Q: np.ndarray, run: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) pairs."""
        i, _, d, rank = self.tree.nearest(Q, run, pos, self.k)
        bound = np.full(len(Q), np.inf)
        bound[i[rank == self.k - 1]] = d[rank == self.k - 1]
        return np.nonzero(reach(Q, self.low, self.high) <= bound[:, None])


def states(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def chart(lib: DataFrame, k: int, inside: bool, radius: int, n: int) -> Map | None:
    """Cells for a library of n states; None where there are no landmarks."""
    step = max(1, n // min(MOST_LANDMARKS, max(LEAST_LANDMARKS, n // A_LANDMARK)))
    t = lib.where(F.pmod(F.xxhash64("pos", "run_id", F.lit("landmark")), F.lit(step)) == 0).select(F.col("run_id").cast("long"), F.col("pos").cast("long"), "state").toArrow().combine_chunks()
    if not t.num_rows:
        return None
    run, pos = (t.column(c).to_numpy() for c in ("run_id", "pos"))
    depth = max(0, int(np.ceil(np.log2(max(1, n / CELL_ROWS)))))
    return Map(Tree(states(t.column("state").combine_chunks()), run, pos, inside, radius), depth, k)


def fan_out(to: Map) -> float:
    """Cells that a query reaches on average, of some landmarks."""
    some = slice(None, None, -(-len(to.tree.S) // TRIALS))
    t = to.tree
    return len(to.touched(t.S[some], t.run[some], t.pos[some])[0]) / len(t.S[some])


def heaviest(to: Map) -> float:
    """Share of the most frequent state, of the landmarks: no cut parts its rows, which are all at the same distance."""
    return np.unique(to.tree.S, axis=0, return_counts=True)[1].max() / len(to.tree.S)


def copies(to: Map, m: int) -> int:
    """How often each cell is laid out, so that a task has MOST_QUERIES queries of it on average."""
    return max(1, -(-m // (blocks.MOST_QUERIES << to.depth)))


def nearest_in_cells(lib: DataFrame, qry: DataFrame, to: Map, n: int, m: int) -> DataFrame:
    """(run_id, pos, out_pos, d, l_run, l_pos, y): the k nearest of each cell that a query reaches; the k nearest of all are among them."""
    times = copies(to, m)
    k, inside, radius, limit = to.k, to.tree.inside, to.tree.radius, blocks.MOST_NUMBERS
    schema = "g int, role int, run_id long, pos long, out_pos long, state array<double>, y array<double>"
    both = [F.col(c).cast("long").alias(c) for c in ("run_id", "pos")]
    state = F.col("state").cast("array<double>").alias("state")
    held = lib.select(F.lit(0).alias("g"), F.lit(0).alias("role"), *both, F.lit(None).cast("long").alias("out_pos"), state, F.col("y").cast("array<double>").alias("y"))
    asked = qry.select(F.lit(0).alias("g"), F.lit(1).alias("role"), *both, F.col("out_pos").cast("long").alias("out_pos"), state, F.array().cast("array<double>").alias("y"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g = to.cell(states(b.column("state")))[:, None] * times + np.arange(times)
                yield b.take(pa.array(np.arange(b.num_rows).repeat(times))).set_column(0, "g", pa.array(g.ravel(), pa.int32()))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                run, pos = b.column("run_id").to_numpy(), b.column("pos").to_numpy()
                i, g = to.touched(states(b.column("state")), run, pos)
                yield b.take(pa.array(i)).set_column(0, "g", pa.array(g * times + (run + pos)[i] % times, pa.int32()))

    parts = min(times << to.depth, max(2 * lib.sparkSession.sparkContext.defaultParallelism, n * times // (4 * CELL_ROWS)))
    rows = held.mapInArrow(placed, schema).unionByName(asked.mapInArrow(sent, schema)).repartition(parts, "g").sortWithinPartitions("g", "role")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, tree = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            g, role = b.column("g").to_numpy(), b.column("role").to_numpy()
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(role) != 0)) + 1
            for a, z in pairwise([0, *cuts, b.num_rows]):
                one = b.slice(a, z - a)
                if g[a] != now:
                    now, own, tree = g[a], [], None
                if role[a] == 0:
                    own.append(one)
                    if sum(len(p.column(c).flatten()) for p in own for c in ("state", "y")) > limit:
                        raise ValueError("a cell of the library is too large for a task")
                    continue
                if not own:
                    continue  # no training state lies in this cell
                if tree is None:
                    lib_rows = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
                    s_run, s_pos = lib_rows.column("run_id"), lib_rows.column("pos")
                    tree = Tree(states(lib_rows.column("state")), s_run.to_numpy(), s_pos.to_numpy(), inside, radius)
                i, j, d, _ = tree.nearest(states(one.column("state")), one.column("run_id").to_numpy(), one.column("pos").to_numpy(), k)
                i, j = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([*(one.column(c).take(i) for c in ("run_id", "pos", "out_pos")), pa.array(d), s_run.take(j), s_pos.take(j), lib_rows.column("y").take(j)], names=["run_id", "pos", "out_pos", "d", "l_run", "l_pos", "y"])

    return rows.mapInArrow(found, "run_id long, pos long, out_pos long, d double, l_run long, l_pos long, y array<double>")
