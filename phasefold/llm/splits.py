"""Train, validation and test splits that keep related records together.

Records are tied by shared keys, directly or through further records. The ties
are found as connected components of a graph whose nodes are the keys, by
alternating large-star and small-star contraction (a number of rounds that grows
with the logarithm of the longest chain) until few enough links are left for one
task. Components are then balanced by the
largest-differencing method: tuples of partial sums start as the heaviest
components side by side, and the tuple with the largest spread is repeatedly
combined with the next one, heaviest against lightest, until one tuple of many
equal bins is left. Whole bins go to the splits by target proportion.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasefold.session import materialize

from .skew import join_unique


def person_key(code: Column) -> Column:
    """Letters (any case) and number (leading zeros dropped) of a code; null for codes without a number."""
    letters = F.upper(F.regexp_replace(code, r"[^\p{L}]", ""))
    number = F.regexp_replace(F.regexp_replace(code, r"[^0-9]", ""), r"^0+(?=.)", "")
    return F.when(number != "", F.concat_ws(":", letters, number))


TASK_LINKS = 400_000  # links that one task takes (two numbers each); more are contracted by rounds first


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node tied to it) of a list of links, by minima along links and pointer jumping."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(node))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            return node, node[low]
        low = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's links as a forest: every node with the smallest node that these links tie it to."""
    links = [b for b in batches if b.num_rows]
    if links:
        node, root = roots(*(np.concatenate([b.column(c).to_numpy() for b in links]) for c in ("u", "v")))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b BIGINT): root is the smallest node tied to it.

    Edges with a null end are ignored; repeated edges and loops change nothing.
    While there are more than ``task_links`` links, each round contracts them and
    writes them to the shared checkpoint folder; the rest is settled in one task.
    """
    both_ends = edges.where("a IS NOT NULL AND b IS NOT NULL")
    e = materialize(both_ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, settled = None, False
    for _ in range(max_rounds):
        n, mark = e.where("u <> v").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n <= task_links:
            break
        if (n, mark) == before:
            settled = True
            break
        before = (n, mark)
        # large star: every neighbour above u goes to the smallest node around u
        both = materialize(e.where("u <> v").select("u", "v").unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(join_unique(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every neighbour below u, and u itself, goes to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_unique(large, low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        loops = e.where("u = v")
        e = materialize(small.unionByName(loops))
    else:
        raise RuntimeError("components did not settle")
    tied = e.where("u <> v")
    tied = tied.unionByName(tied.select(F.col("v").alias("u"), "v")) if settled else tied.repartition(1).mapInArrow(_contract, "u long, v long")
    tied = tied.select(F.col("u").alias("node"), F.col("v").alias("root"))
    alone = e.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tied.unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))


def tie_records(df: DataFrame, record: str, runs: list[str], code: str) -> DataFrame:
    """(record, first): every record with the smallest record it is tied to, itself included.

    Two records are tied by one value of any of ``runs`` (whichever column) or by
    one ``person_key`` of ``code``. Nulls tie nothing. Repeated rows count once;
    rows without a record id are dropped. Ids must lie within +-2^61.
    """
    cols = [F.col(c).cast("long") for c in runs]
    slim = df.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("record"), *[c.alias(f"r{i}") for i, c in enumerate(cols)], person_key(F.col(code)).alias("person"))
    slim = slim.withColumn("anchor", F.coalesce(*[F.col(f"r{i}") * 2 for i in range(len(runs))], F.col("record") * 2 + 1))
    rows = materialize(slim.distinct())
    # every row ties its anchor to its other runs; a person or a record ties its anchors to their least one
    direct = rows.select("anchor", F.explode(F.array("anchor", *[F.col(f"r{i}") * 2 for i in range(1, len(runs))])).alias("b")).where("b IS NOT NULL").select(F.col("anchor").alias("a"), "b")
    people = materialize(rows.where("person IS NOT NULL").select("person", "anchor").distinct())
    known = join_unique(people, people.groupBy("person").agg(F.min("anchor").alias("b")), "person").select(F.col("anchor").alias("a"), "b")
    unlike = rows.groupBy("record").agg(F.min("anchor").alias("a"), F.max("anchor").alias("b"), F.count("*").alias("n"), F.collect_set("anchor").alias("all")).where("n > 1")
    same = unlike.select("a", F.explode("all").alias("b"))  # rows of one record with unlike fields: as many as its repeats
    root = materialize(components(direct.unionByName(known).unionByName(same).distinct()))
    placed = materialize(join_unique(materialize(rows.groupBy("record").agg(F.min("anchor").alias("node"))), root, "node").select("record", "root"))
    least = placed.groupBy("root").agg(F.min("record").alias("first"))
    return join_unique(placed, least, "root").select("record", "first")


def difference_bins(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each weight by largest differencing over ``bins`` bins."""
    order = np.argsort(-weights, kind="stable")
    heap = []
    for g, a in enumerate(range(0, len(order), bins)):
        members = [[i] for i in order[a : a + bins].tolist()]
        members += [[] for _ in range(bins - len(members))]
        sums = [float(weights[m[0]]) if m else 0.0 for m in members]
        heap.append((-(max(sums) - min(sums)), g, sums, members))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, g, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heapq.heappop(heap)
        i1 = sorted(range(bins), key=s1.__getitem__, reverse=True)
        i2 = sorted(range(bins), key=s2.__getitem__)
        sums, members = [0.0] * bins, [None] * bins
        for k in range(bins):
            a, b = m1[i1[k]], m2[i2[k]]
            if len(a) < len(b):
                a, b = b, a
            a.extend(b)
            sums[k], members[k] = s1[i1[k]] + s2[i2[k]], a
        heapq.heappush(heap, (-(max(sums) - min(sums)), g, sums, members))
    out = np.zeros(len(weights), dtype=np.int64)
    if heap:
        for k, m in enumerate(heap[0][3]):
            out[m] = k
    return out


def allocate(sums: np.ndarray, targets: dict[str, float]) -> list[str]:
    """Split of each bin: heaviest first, to the split that lacks most of its target."""
    total = float(sums.sum())
    lack = {k: v * total for k, v in targets.items()}
    out = [""] * len(sums)
    for i in np.argsort(-sums, kind="stable").tolist():
        name = max(lack, key=lambda k: lack[k])
        out[i] = name
        lack[name] -= float(sums[i])
    return out


def assign_splits(ties: DataFrame, targets: dict[str, float], bins: int = 200, per_task: int = 200_000) -> DataFrame:
    """(record, split) from (record, first): components stay whole, shares come as near as they allow.

    Components are balanced in tasks of about ``per_task``, each of which leaves
    ``bins`` sums. The sums of all tasks are balanced in the same way, level by
    level, until one task is left; only its ``bins`` sums reach the driver.
    """
    ties = materialize(ties)
    weight = ties.groupBy("first").agg(F.count("*").alias("w"))

    def balance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = [b for b in batches if b.num_rows]
        if not there:
            return
        t = pa.Table.from_batches(there)
        task, item, w = (t.column(c).to_numpy() for c in ("task", "item", "w"))
        for k in np.unique(task):
            at = np.flatnonzero(task == k)
            got = difference_bins(w[at].astype(float), bins)
            yield pa.RecordBatch.from_arrays([pa.array(item[at]), pa.array(w[at]), pa.array(task[at] * bins + got)], ["item", "w", "bin"])

    def level(items: DataFrame, tasks: int) -> DataFrame:
        spread = items.withColumn("task", F.pmod(F.xxhash64("item"), F.lit(tasks))).repartition(tasks, "task").sortWithinPartitions("task", "item")
        return materialize(spread.mapInArrow(balance, "item long, w long, bin long"))

    weight = materialize(weight.select(F.col("first").alias("item"), "w"))
    n = weight.count()
    where = None
    while True:
        tasks = max(1, -(-n // per_task))
        placed = level(weight, tasks)
        own = placed.select("item", "bin")
        where = own.withColumnRenamed("item", "first") if where is None else where.join(own.withColumnRenamed("bin", "up"), where["bin"] == F.col("item")).select("first", F.col("up").alias("bin"))
        weight = placed.groupBy("bin").agg(F.sum("w").alias("w")).select(F.col("bin").alias("item"), "w")
        if tasks == 1:
            break
        n = tasks * bins
    sums = sorted(map(tuple, weight.collect()))  # at most `bins` rows
    split = dict(zip([b for b, _ in sums], allocate(np.array([w for _, w in sums], dtype=float), targets), strict=True))
    named = F.create_map(*[F.lit(x) for kv in split.items() for x in kv]) if split else F.create_map(F.lit(0), F.lit(""))
    return join_unique(ties, where.select("first", F.element_at(named, F.col("bin")).alias("split")), "first").select("record", "split")
