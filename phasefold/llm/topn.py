"""Top N items of every group by sorted runs and a loser-tree merge.

1. Rows are spread by their full key, so a group of any size lies in many tasks.
   Each task sorts its rows by group and score: a sorted run of every group it
   holds. Of a run no more than the group's own N can survive; the task seeks
   to the next group after that many.
2. The survivors are stored in buckets by group, each run still in order. A
   bucket's task merges the runs of a group with a tree of losers, which costs
   log2(runs) comparisons an output, stops after the group's own N outputs and
   seeks to the next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasefold.functions.arrow_groups import group_starts, whole_groups
from phasefold.session import materialize

from .skew import join_unique

#: Limits are broadcast up to this many rows (16 bytes each); more are joined by a shuffle that splits hot keys off.
BROADCAST_ROWS = 500_000


class LoserTree:
    """Multiway merge of sorted runs of comparable items.

    Leaf i is run i's head; each inner node keeps the loser of its match, the
    winner goes up. After an output only the matches on the path of its run are
    played again. Ties go to the run with the smaller number.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.node = [-1] * self.k  # node[0] is the overall winner
        winner = [0] * self.k + list(range(self.k))
        for n in range(self.k - 1, 0, -1):
            a, b = winner[2 * n], winner[2 * n + 1]
            if not self._beats(a, b):
                a, b = b, a
            winner[n], self.node[n] = a, b
        self.node[0] = winner[1] if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def pop(self):
        """The smallest item left, or None."""
        w = self.node[0]
        if self.at[w] >= len(self.runs[w]):
            return None
        item = self.runs[w][self.at[w]]
        self.at[w] += 1
        n = (self.k + w) // 2
        while n > 0:
            if self._beats(self.node[n], w):
                self.node[n], w = w, self.node[n]
            n //= 2
        self.node[0] = w
        return item


def merge_runs(runs: list[list], n: int) -> list:
    """The n smallest items of sorted runs, in order."""
    if len(runs) == 1:
        return runs[0][:n]
    tree, out = LoserTree(runs), []
    while len(out) < n and (item := tree.pop()) is not None:
        out.append(item)
    return out


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], limits: DataFrame, limit_key: str, n: str, default_n: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``n`` rows of each group with the smallest ``score``, ties by ``ties`` in order.

    ``df`` holds one row per (group, ties); all of these columns are BIGINT,
    ``score`` is DOUBLE. ``limits`` gives ``n`` for each ``limit_key`` (a group
    column, unique there); a group without a limit gets ``default_n`` or, where
    that is None, nothing; an ``n`` of 0 or less gives nothing. Rows with a null in group or ties, or a score that is
    null, NaN or infinite, don't count. A group with fewer rows is kept whole.
    A bucket's task holds one group's survivors at a time: at most ``n`` of each
    run. Returns the columns group + ties + rank (1 is best). Empty in, empty out.
    """
    keys = [*group, *ties]
    slim = df.select(*keys, score)
    for c in keys:
        slim = slim.where(F.col(c).isNotNull())
    slim = slim.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    wanted = limits.select(limit_key, F.col(n).cast("long").alias("__n")).where("__n IS NOT NULL")
    if wanted.count() <= broadcast_rows:
        slim = slim.join(F.broadcast(wanted), limit_key, "inner" if default_n is None else "left")
    else:
        slim = materialize(slim)
        if default_n is not None:
            wanted = slim.select(limit_key).distinct().join(wanted, limit_key, "left")
        slim = join_unique(slim, wanted, limit_key)
    if default_n is not None:
        slim = slim.withColumn("__n", F.coalesce("__n", F.lit(default_n).cast("long")))
    slim = slim.where("__n > 0").select(*keys, score, "__n")
    order = [*group, score, *ties]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, run = None, 0, None
        for b in batches:
            if b.num_rows == 0:
                continue
            if run is None:
                from pyspark import TaskContext

                run = TaskContext.get().partitionId()
            starts = group_starts([b.column(c) for c in group])
            size = np.diff(np.append(starts, b.num_rows))
            rank = np.arange(b.num_rows) - np.repeat(starts, size)
            head = tuple(b.column(c)[0].as_py() for c in group)
            if head == last:
                rank[: size[0]] += taken
            last = tuple(b.column(c)[-1].as_py() for c in group)
            taken = int(rank[-1]) + 1
            kept = b.filter(pa.array(rank < b.column("__n").to_numpy()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(kept.num_rows, run), pa.int64())], [*kept.schema.names, "__run"])

    kinds = dict(slim.dtypes)
    cols = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, score])
    runs = slim.repartition(*keys).sortWithinPartitions(*order).mapInArrow(cut, f"{cols}, __n long, __run long")
    bucketed = runs.repartition(*group).sortWithinPartitions(*group, "__run", score, *ties)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, group):
            t = t.combine_chunks()
            at = {c: t.column(c).to_numpy() for c in [*keys, score, "__run", "__n"]}
            begins = np.append(group_starts([t.column(c).chunk(0) for c in group]), t.num_rows)
            pick, ranks = [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                need = int(at["__n"][a])
                edge = [a, *(np.flatnonzero(np.diff(at["__run"][a:b])) + a + 1).tolist(), b]
                if len(edge) == 2:
                    best = range(a, min(b, a + need))
                else:
                    rows = list(zip(*[at[c][a:b].tolist() for c in [score, *ties]], range(a, b), strict=True))
                    best = [x[-1] for x in merge_runs([rows[i - a : j - a] for i, j in zip(edge[:-1], edge[1:], strict=True)], need)]
                pick.extend(best)
                ranks.extend(range(1, len(best) + 1))
            idx = np.array(pick, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at[c][idx]) for c in keys] + [pa.array(ranks, pa.int32())], [*keys, "rank"])

    out = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return bucketed.mapInArrow(merge, f"{out}, rank int")
