"""Most similar vectors for every vector, by anisotropic four-bit quantisation.

Vectors are put into cells of a coarse codebook. Seen from its cell's centre c a
vector is r = x - c and a query p = q - c, and the nearest x has the largest inner
product of (p, 1) with (r, -|r|^2/2). The norm is stored as it is; r is split into
short subvectors, each replaced by one of 16 codewords, two codes a byte. For a
query near x, p is near r, so an error of the code along r moves large products
while one across it does not: codewords are chosen, and moved, by the score-aware
loss that weighs the parallel error more.

A query first scans the codes of its nearest cells by table lookups (one table of
256 sums a byte) and reranks the best exactly; what it finds bounds the distance
of its true neighbours. The length of each code's error is stored too, so a code
tells how near its vector can be at most: whatever the bound doesn't exclude is
compared exactly, in these cells and then in every cell that the bound doesn't
exclude as a whole. The result is that of brute force.

Codebooks are fitted on a bounded sample (``FIT_ROWS``); every vector is indexed
and every vector is a query. Cells are scanned in blocks of at most ``BLOCK``
vectors, so no task holds a whole cell. Equal vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasefold.session import materialize

from .skew import join_unique

FIT_ROWS = 40_000
BLOCK = 4_000
SCAN = 256  # queries scanned at once
GROUP = 40_000  # most queries, on average, that a task of the comparison with all vectors holds


def nearest_centres(x: np.ndarray, c: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest rows of c for each row of x, nearest first."""
    half = (c * c).sum(1) / 2
    out = np.empty((len(x), min(n, len(c))), dtype=np.int64)
    for a in range(0, len(x), 2048):
        s = half - x[a : a + 2048] @ c.T
        if n == 1:
            out[a : a + 2048, 0] = s.argmin(1)
        else:
            k = out.shape[1]
            top = np.argpartition(s, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
            out[a : a + 2048] = np.take_along_axis(top, np.take_along_axis(s, top, 1).argsort(1, kind="stable"), 1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centres(x, c)[:, 0]
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(own, weights=x[:, j], minlength=len(c))
            c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
    return c


@dataclass
class Codebook:
    """Coarse centres, subvectors (column slices) and 16 codewords for each; ``eta`` weighs parallel error."""

    centres: np.ndarray
    cuts: list[tuple[int, int]]
    words: list[np.ndarray]
    eta: float

    def codes(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Codewords by coordinate descent on |e|^2 + (eta - 1) (e.r/|r|)^2, and e, the error of r."""
        r = x - self.centres[cell]
        unit = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
        codes = np.empty((len(x), len(self.cuts)), dtype=np.uint8)
        along = np.zeros(len(x))  # parallel error of all subvectors so far
        part = np.zeros((len(x), len(self.cuts)))
        err = r.copy()
        for sweep in range(sweeps):
            for m, (a, b) in enumerate(self.cuts):
                e = r[:, None, a:b] - self.words[m][None]
                flat = (e * e).sum(2)
                par = (e * unit[:, None, a:b]).sum(2)
                rest = along - part[:, m]
                best = (flat + (self.eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
                at = np.arange(len(x)), best
                codes[:, m], err[:, a:b] = best, e[at]
                along += par[at] - part[:, m]
                part[:, m] = par[at]
        return codes, err

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte: the even subvector in the lower half."""
        if codes.shape[1] % 2:
            codes = np.column_stack([codes, np.zeros(len(codes), dtype=np.uint8)])
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, cell: int, p: np.ndarray) -> list[np.ndarray]:
        """For each byte the products of each query with its 256 pairs of codewords."""
        one = [(p[:, a:b] @ w.T).astype(np.float32) for (a, b), w in zip(self.cuts, self.words, strict=True)]
        one = [np.pad(t, ((0, 0), (0, 16 - t.shape[1]))) for t in one]
        if len(one) % 2:
            one.append(np.zeros_like(one[0]))
        return [(hi[:, :, None] + lo[:, None, :]).reshape(len(p), 256) for lo, hi in zip(one[::2], one[1::2], strict=True)]


def fit_codebook(sample: np.ndarray, cells: int, width: int = 3, eta: float = 4.0, seed: int = 11) -> Codebook:
    rng = np.random.default_rng(seed)
    centres = k_means(sample, cells, 6, rng)
    few = rng.choice(len(sample), size=min(len(sample), 10_000), replace=False)
    x = sample[few]
    cell = nearest_centres(x, centres)[:, 0]
    r = x - centres[cell]
    cuts = [(a, min(a + width, sample.shape[1])) for a in range(0, sample.shape[1], width)]
    book = Codebook(centres, cuts, [k_means(r[:, a:b], 16, 6, rng) for a, b in cuts], eta)
    unit = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    for _ in range(3):  # codewords move to where the loss of the vectors they stand for is least
        codes, err = book.codes(x, cell)
        for m, (a, b) in enumerate(cuts):
            u, t = unit[:, a:b], r[:, a:b]
            rest = (err * unit).sum(1) - (err[:, a:b] * u).sum(1)
            for w in range(len(book.words[m])):
                i = np.flatnonzero(codes[:, m] == w)
                if len(i):
                    left = len(i) * np.eye(b - a) + (eta - 1) * u[i].T @ u[i]
                    right = t[i].sum(0) + (eta - 1) * (u[i] * (rest[i] + (u[i] * t[i]).sum(1))[:, None]).sum(0)
                    book.words[m][w] = np.linalg.solve(left, right)
            codes, err = book.codes(x, cell, 1)
    return book


class Block:
    """One block of a cell: ids, vectors, packed codes and the lengths of the codes' errors."""

    def __init__(self, book: Codebook, cell: int, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, err: np.ndarray):
        self.book, self.cell, self.ids, self.x = book, cell, ids, x
        self.bytes = [packed[:, j].astype(np.intp) for j in range(packed.shape[1])]
        r = x - book.centres[cell]
        self.norm = (r * r).sum(1).astype(np.float32)
        self.err = err
        # |r - e|^2 from the words themselves: what the codes stand for
        self.size = np.zeros(len(x), dtype=np.float32)
        for m, w in enumerate(book.words):
            of = packed[:, m // 2] >> 4 if m % 2 else packed[:, m // 2] & 15
            self.size += ((w * w).sum(1).astype(np.float32))[of]

    def scan(self, p: np.ndarray) -> np.ndarray:
        """Products of each query (from the centre) with what the codes stand for."""
        out = np.zeros((len(p), len(self.ids)), dtype=np.float32)
        for t, at in zip(self.book.tables(self.cell, p), self.bytes, strict=True):
            out += np.take(t, at, axis=1)
        return out

    def search(self, q: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance) of up to k vectors within each query's limit, exactly those nearest."""
        p = q - self.book.centres[self.cell]
        product = self.scan(p)
        limit = limit.copy()
        if rerank < len(self.ids):  # the best by their scores tighten the limits
            at = np.argpartition(self.norm / 2 - product, rerank - 1, axis=1)[:, :rerank]
            d = self.x[at] - q[:, None]
            d = np.sqrt((d * d).sum(2))
            d[self.ids[at] == own[:, None]] = np.inf
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] if rerank >= k else np.inf)
        # the distance is at least that from the code's vector less its error; float32 sums get some room
        square = (p * p).sum(1)
        room = 1e-5 * (square[:, None] + self.size)
        near = np.sqrt(np.maximum(square[:, None] - 2 * product + self.size - room, 0))
        open_ = near - self.err <= limit[:, None] * (1 + 1e-9)
        if open_.mean() > 0.02:  # many left: one matrix product tells most of them apart before they are gathered
            size = (q * q).sum(1)[:, None] + (self.x * self.x).sum(1)
            open_ &= size - 2 * (q @ self.x.T) <= limit[:, None] ** 2 + 1e-9 * size
        i, j = np.nonzero(open_)
        d = np.sqrt(((self.x[j] - q[i]) ** 2).sum(1))
        ok = (self.ids[j] != own[i]) & (d <= limit[i])
        i, j, d = i[ok], j[ok], d[ok]
        order = np.lexsort((self.ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[top], j[top], d[top]


def wanted_cells(q: np.ndarray, near: np.ndarray, limit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Whether each cell may hold something within a query's limit.

    A vector of the cell lies on the cell's side of the plane midway to any other
    centre, and the query's distance from that plane bounds its distance.
    """
    half = (centres * centres).sum(1)
    norm = (q * q).sum(1)
    to = norm[:, None] - 2 * q @ centres.T + half
    keep = np.ones(to.shape, dtype=bool)
    for m in range(near.shape[1]):
        own = near[:, m]
        gap = np.sqrt(np.maximum(half[own][:, None] + half - 2 * centres[own] @ centres.T, 0))
        keep &= to - to[np.arange(len(q)), own][:, None] <= 2 * gap * limit[:, None] + 1e-9 * (to + norm[:, None])
    return keep


class Nearest:
    """The k nearest of every query among the cells shown to it, exactly.

    ``want`` says which cells may hold something for each query and ``limit`` a
    distance beyond which nothing is wanted. Ties go by the smaller id.
    """

    def __init__(self, q: np.ndarray, ids: np.ndarray, want: np.ndarray, limit: np.ndarray, k: int):
        self.q, self.ids, self.want, self.limit, self.k = q, ids, want, limit.copy(), k
        self.norm = (q * q).sum(1)
        self.d = np.full((len(q), k), np.inf)
        self.other = np.zeros((len(q), k), dtype=np.int64)

    def look(self, cell: int, ids: np.ndarray, x: np.ndarray) -> None:
        want = np.flatnonzero(self.want[:, cell])
        norm = (x * x).sum(1)
        for a in range(0, len(want), 2048):
            w = want[a : a + 2048]
            size = self.norm[w, None] + norm
            i, j = np.nonzero(size - 2 * (self.q[w] @ x.T) <= self.limit[w, None] ** 2 + 1e-9 * size)
            if len(i):
                self._keep(w[i], ids[j], np.sqrt(((x[j] - self.q[w[i]]) ** 2).sum(1)))

    def _keep(self, who: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        ok = (other != self.ids[who]) & (d <= self.limit[who])
        who, other, d = who[ok], other[ok], d[ok]
        hit = np.unique(who)
        who = np.concatenate([who, np.repeat(hit, self.k)])
        other, d = np.concatenate([other, self.other[hit].ravel()]), np.concatenate([d, self.d[hit].ravel()])
        order = np.lexsort((other, d, who))
        who, other, d = who[order], other[order], d[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < self.k
        self.d[who[top], rank[top]], self.other[who[top], rank[top]] = d[top], other[top]
        self.limit[hit] = np.minimum(self.limit[hit], self.d[hit, self.k - 1])


def similar(df: DataFrame, row_id: str, vector: Column, dims: int, k: int = 5, probes: int = 3, rerank: int = 32, per_cell: int = 400, most_cells: int = 8192, within: float = float("inf")) -> DataFrame:
    """(id, other, rank, distance): the k nearest other rows of every row, ties by the smaller id.

    ``vector`` is an ARRAY<DOUBLE>; rows with a null id, a null array, another
    length than ``dims`` or a null, NaN or infinite element are incomplete and
    take no part. Of rows with one id the one with the smallest vector holds.
    Fewer than k other rows are returned whole. Empty in, empty out. Neighbours
    farther than ``within`` are left out, and the search spares what they would
    cost. ``probes`` and ``rerank`` change the cost only, never the result: where
    distances exclude few cells (many dimensions, no ``within``), each vector is
    compared with nearly all others.
    """
    spark = df.sparkSession
    whole = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    slim = df.select(F.col(row_id).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    slim = slim.where((F.size("v") == dims) & whole).groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(slim)
    # equal vectors: one representative, of whose members the k + 1 smallest ids can ever be named
    reps = materialize(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    total = reps.count()
    if total == 0:
        return spark.createDataFrame([], "id long, other long, rank int, distance double")
    share = min(1_000_000, -(-1_000_000 * FIT_ROWS // total))
    drawn = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < share).orderBy("rep").select("v").toArrow()["v"]
    sample = np.array(drawn.to_pylist() or reps.select("v").first()[0], dtype=float).reshape(-1, dims)
    book = fit_codebook(sample, max(1, min(most_cells, total // per_cell, len(sample) // 8)))
    shared = spark.sparkContext.broadcast(book)  # at most most_cells x dims numbers and the codewords
    probes = min(probes, len(book.centres))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)

    def lists(b: pa.RecordBatch, name: str) -> np.ndarray:
        return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bk = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b)
            near = nearest_centres(x, bk.centres, probes)
            codes, e = bk.codes(x, near[:, 0])
            err = (np.sqrt((e * e).sum(1)) * (1 + 1e-6) + 1e-12).astype(float)
            packed = [c.tobytes() for c in bk.pack(codes)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), pa.array(list(near), pa.list_(pa.int64())), pa.array(packed, pa.binary()), pa.array(err)], ["rep", "v", "near", "code", "err"])

    placed = materialize(reps.select("rep", "v").mapInArrow(place, "rep long, v array<double>, near array<long>, code binary, err double").withColumn("cell", F.col("near")[0]))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))  # at most most_cells rows
    base = placed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(0).alias("role"), "rep", "v", "code", "err")

    def ask(queries: DataFrame) -> DataFrame:
        """(rep, near_rep, distance) from the cells that (rep, v, cell, limit) names: k of each block at most."""
        asked = queries.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "rep", "v", F.lit(None).cast("binary").alias("code"), F.col("limit").alias("err"))
        return base.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "role", "rep").mapInArrow(search, "rep long, near_rep long, distance double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bk = shared.value
        at_key, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cell, number, role, rep, err = (b.column(c).to_numpy() for c in ("cell", "block", "role", "rep", "err"))
            v = matrix(b)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(role) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                key = (cell[a], number[a])
                if key != at_key:
                    at_key, held, block = key, [], None
                if role[a] == 0:
                    packed = np.frombuffer(b"".join(b.column("code").slice(a, z - a).to_pylist()), dtype=np.uint8).reshape(z - a, -1)
                    held.append((rep[a:z], v[a:z], packed, err[a:z]))
                    continue
                if block is None and held:
                    block, held = Block(bk, int(cell[a]), *map(np.concatenate, zip(*held, strict=True))), []
                if block is None:
                    continue
                for s in range(a, z, SCAN):
                    e = min(z, s + SCAN)
                    i, j, d = block.search(v[s:e], rep[s:e], err[s:e], k, rerank)
                    yield pa.RecordBatch.from_arrays([pa.array(rep[s:e][i]), pa.array(block.ids[j]), pa.array(d)], ["rep", "near_rep", "distance"])

    def nearest(found: DataFrame) -> DataFrame:
        best = found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("near_rep").alias("rep")))).alias("all"))  # k of each block looked at
        return best.select("rep", F.slice("all", 1, k).alias("near"))

    first = materialize(nearest(ask(placed.select("rep", "v", F.explode("near").alias("cell"), F.lit(float(within)).alias("limit")))))
    bound = F.when(F.size("found") >= k, F.least(F.element_at("found", k)["distance"], F.lit(float(within)))).otherwise(F.lit(float(within)))
    known = placed.join(first.withColumnRenamed("near", "found"), "rep", "left").select("rep", "v", "near", bound.alias("limit"))

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bk = shared.value
        for b in batches:
            if b.num_rows:
                near = lists(b, "near")
                want = wanted_cells(matrix(b), near, b.column("limit").to_numpy(), bk.centres)
                np.put_along_axis(want, near, False, axis=1)  # settled already
                cells = pa.array([np.flatnonzero(w) for w in want], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), b.column("limit"), cells], ["rep", "v", "limit", "cells"])

    opened = materialize(known.mapInArrow(open_cells, "rep long, v array<double>, limit double, cells array<long>"))
    visits = opened.agg(F.sum(F.size("cells"))).first()[0] or 0
    groups = max(spark.sparkContext.defaultParallelism, -(-total // GROUP))
    if visits <= groups * total:  # fewer rows to shuffle than by showing all vectors to every task
        more = ask(opened.select("rep", "v", F.explode("cells").alias("cell"), "limit"))
    else:
        more = _all_pairs(opened, placed, groups, len(book.centres), dims, k)
    old = first.select("rep", F.explode("near").alias("s")).select("rep", F.col("s.rep").alias("near_rep"), "s.distance")
    best = nearest(old.unionByName(more))
    if reps.where("n > 1").isEmpty():
        out = best.select(F.col("rep").alias("id"), F.posexplode("near").alias("p", "s"))
        return out.select("id", F.col("s.rep").alias("other"), (F.col("p") + 1).alias("rank"), F.col("s.distance").alias("distance"))
    return _with_copies(rows, reps, materialize(best), k)


def _all_pairs(opened: DataFrame, placed: DataFrame, groups: int, cells: int, dims: int, k: int) -> DataFrame:
    """(rep, near_rep, distance) where distances exclude few cells: each task holds some queries and is shown all vectors."""
    queries = opened.select(F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("long").alias("g"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("cell"), "rep", "v", "limit", "cells")
    shown = placed.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("role"), "cell", "rep", "v", F.lit(None).cast("double").alias("limit"), F.lit(None).cast("array<long>").alias("cells"))
    task = queries.unionByName(shown).repartition(groups, "g").sortWithinPartitions("g", "role", "cell", "rep")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_now, held, known = None, [], None

        def answers() -> Iterator[pa.RecordBatch]:
            if known is not None:
                ok = np.isfinite(known.d).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(known.ids, k)[ok]), pa.array(known.other.ravel()[ok]), pa.array(known.d.ravel()[ok])], ["rep", "near_rep", "distance"])

        for b in batches:
            if not b.num_rows:
                continue
            g, role, cell, rep = (b.column(c).to_numpy() for c in ("g", "role", "cell", "rep"))
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(role) != 0) | ((np.diff(cell) != 0) & (role[1:] == 1))) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if g[a] != g_now:
                    yield from answers()
                    g_now, held, known = g[a], [], None
                if role[a] == 0:
                    want = np.zeros((z - a, cells), dtype=bool)
                    some = b.column("cells").slice(a, z - a)
                    size = some.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    want[np.repeat(np.arange(z - a), size), some.flatten().to_numpy(zero_copy_only=False)] = True
                    held.append((v[a:z], rep[a:z], want, b.column("limit").slice(a, z - a).to_numpy(zero_copy_only=False)))
                    continue
                if known is None and held:
                    known, held = Nearest(*map(np.concatenate, zip(*held, strict=True)), k), []
                if known is not None:
                    known.look(int(cell[a]), rep[a:z], v[a:z])
        yield from answers()

    return task.mapInArrow(settle, "rep long, near_rep long, distance double")


def _with_copies(rows: DataFrame, reps: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Neighbours of all rows from those of the representatives of equal vectors."""
    copied = materialize(reps.where("n > 1").select("v", "rep", "n"))
    # copies of one vector go to salted parts, each of which keeps its smallest ids
    member = materialize(join_unique(rows.withColumn("__k", F.xxhash64("v")), copied.select(F.xxhash64("v").alias("__k"), F.col("v").alias("w"), "rep").groupBy("__k").agg(F.collect_list(F.struct("w", "rep")).alias("same")), "__k").select("id", F.explode("same").alias("s"), "v").where("s.w = v").select("id", F.col("s.rep").alias("rep")))
    part = member.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("rep", "salt").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    names = part.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("names"))
    far = best.select("rep", F.explode("near").alias("s")).select("rep", "s.distance", F.col("s.rep").alias("other"))
    far = far.join(names.withColumnRenamed("rep", "other"), "other", "left").select("rep", "distance", F.explode(F.coalesce("names", F.array("other"))).alias("other"))
    own = names.select("rep", F.lit(0.0).alias("distance"), F.explode("names").alias("other"))
    lists = materialize(far.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, 2 * k + 1).alias("near")))
    owner = rows.select("id").join(member, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    each = join_unique(materialize(owner), lists, "rep").select("id", F.slice(F.filter("near", lambda s: s["other"] != F.col("id")), 1, k).alias("near"))
    out = each.select("id", F.posexplode("near").alias("p", "s"))
    return out.select("id", F.col("s.other").alias("other"), (F.col("p") + 1).alias("rank"), F.col("s.distance").alias("distance"))


def mutual(pairs: DataFrame, limit: float) -> DataFrame:
    """(first_id, second_id) of rows that name each other within ``limit``, the smaller id first."""
    close = pairs.where(F.col("distance") <= limit).select(F.least("id", "other").alias("first_id"), F.greatest("id", "other").alias("second_id"))
    return close.groupBy("first_id", "second_id").count().where("count = 2").select("first_id", "second_id")
