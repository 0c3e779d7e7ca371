"""Queries of the state-space operators over series made from the driver's tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasefold.functions import scoring
from phasefold.operators import crossmap, crossval, generate, multiview, selection, simplex, smap, surrogates, sweeps
from phasefold.operators.embedding import library, query, regular_series
from phasefold.operators.neighbors import neighbors
from phasefold.session import shared_dir
from phasefold.sources import results, tables


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly shipped quantity, one run."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return regular_series(li, F.col("l_shipdate"), F.col("l_quantity"), "week")


def by_flag(spark: SparkSession, d: str) -> DataFrame:
    """Weekly shipped quantity, one run for each line status."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return regular_series(li, F.col("l_shipdate"), F.col("l_quantity"), "week", F.when(F.col("l_linestatus") == "F", 0).otherwise(1))


def wide(spark: SparkSession, d: str) -> DataFrame:
    """Weekly quantity, number of lines and mean discount as three variables."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    parts = [regular_series(li, F.col("l_shipdate"), c, "week").withColumnRenamed("v", n) for n, c in (("v", F.col("l_quantity")), ("a", F.col("l_discount") * 100), ("b", F.col("l_tax") * 100))]
    return parts[0].join(parts[1], ["run_id", "pos"]).join(parts[2], ["run_id", "pos"])


def spine_hourly(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    return regular_series(ev, F.col("ts"), F.col("value"), "hour").select("pos", "v")


def lag_states(spark: SparkSession, d: str) -> DataFrame:
    s = query(weekly(spark, d), ["v"], 3, -1, 0)
    return s.select("pos", *[F.get("state", F.lit(i)).alias(f"s{i}") for i in range(3)])


def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = library(weekly(spark, d), ["v"], ["v"], 2, -3, 2)
    return s.select("pos", F.get("state", F.lit(0)).alias("s0"), F.get("state", F.lit(1)).alias("s1"), F.get("y", F.lit(0)).alias("y"))


def _near(spark: SparkSession, d: str, k: int, radius: int) -> DataFrame:
    w = weekly(spark, d)
    return neighbors(library(w, ["v"], ["v"], 3), query(w, ["v"], 3), k, True, radius)


def knn_inside(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 4, 0).select("pos", "rank", "l_pos", F.round("d", 6).alias("d"))


def knn_radius(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 4, 5).select("pos", "rank", "l_pos", F.round("d", 6).alias("d"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("run_id", "pos", F.round("pred", 4).alias("pred"), F.round("variance", 2).alias("variance"))


def simplex_weekly(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(simplex.simplex(weekly(spark, d), ["v"], ["v"], dimensions=3))


def simplex_back(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(simplex.simplex(weekly(spark, d), ["v"], ["v"], dimensions=2, horizon=-2))


def simplex_runs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(simplex.simplex(by_flag(spark, d), ["v"], ["v"], dimensions=2, radius=2))


def simplex_split(spark: SparkSession, d: str) -> DataFrame:
    w = weekly(spark, d)
    test = w.where("pos >= 200").withColumn("pos", F.col("pos") - 200)
    return _rounded(simplex.simplex(w.where("pos < 200"), ["v"], ["v"], test, dimensions=3))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """All scores of the forecast 'as last week'."""
    w = weekly(spark, d).withColumn("p", F.lag("v").over(Window.partitionBy("run_id").orderBy("pos")))
    y, p = F.col("v"), F.col("p")
    f = {"corr": scoring.correlation, "corr0": scoring.correlation_or_zero, "r2": scoring.r2, "max_ae": scoring.max_absolute_error, "sum_ae": scoring.sum_absolute_error, "rmse": scoring.rmse}
    return w.agg(*[F.round(g(y, p), 6).alias(n) for n, g in f.items()], F.round(scoring.clamped_correlation(y, F.lit(1.0)), 6).alias("flat_clamped"), scoring.correlation(y, F.lit(1.0)).alias("flat"))


def smap_global(spark: SparkSession, d: str) -> DataFrame:
    """Theta 0, one dimension, out of sample: ordinary least squares."""
    w = weekly(spark, d)
    test = w.where("pos >= 200").withColumn("pos", F.col("pos") - 200)
    return smap.smap(w.where("pos < 200"), ["v"], ["v"], test, dimensions=1).select("pos", F.round("pred", 4).alias("pred"), F.round(F.get("coef", F.lit(1)), 6).alias("slope"))


def smap_local(spark: SparkSession, d: str) -> DataFrame:
    """Theta 2, one dimension, in sample: the weighted closed form."""
    return smap.smap(weekly(spark, d), ["v"], ["v"], dimensions=1, theta=2.0).select("pos", F.round("pred", 3).alias("pred"))


def smap_three(spark: SparkSession, d: str) -> DataFrame:
    """Theta 3, three dimensions: the weighted normal equations."""
    got = smap.smap(weekly(spark, d), ["v"], ["v"], dimensions=3, theta=3.0)
    return got.select("pos", F.round("pred", 3).alias("pred"), F.round("variance", 1).alias("variance"), F.round(F.get("coef", F.lit(1)), 5).alias("c1"), F.round(F.get("coef", F.lit(3)), 5).alias("c3"))


def simplex_mask(spark: SparkSession, d: str) -> DataFrame:
    """Every third row may not train; all are predicted."""
    w = weekly(spark, d).withColumn("m", F.col("pos") % 3 != 0)
    return _rounded(simplex.simplex(w, ["v"], ["v"], dimensions=2, mask="m"))


def forecast_score(spark: SparkSession, d: str) -> DataFrame:
    """Correlation and the user's own score (mean absolute error) over all runs together."""
    s = by_flag(spark, d)
    made = simplex.simplex(s, ["v"], ["v"], dimensions=2, radius=2)
    own = simplex.score(made, s, ["v"], lambda a, p: F.avg(F.abs(a - p))).withColumnRenamed("score", "mean_ae")
    return simplex.score(made, s, ["v"]).join(own, "target").select("target", F.round("score", 5).alias("score"), F.round("mean_ae", 4).alias("mean_ae"))


def embedding_skill(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.embedding_sweep(weekly(spark, d), ["v"], ["v"], dimensions=4).select("e", F.round("skill", 5).alias("skill"))


def best_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Dimension at which each variable best predicts itself, on the rows complete at the largest."""
    got = sweeps.best_dimension(sweeps.embedding_sweep(wide(spark, d), ["v", "a", "b"], dimensions=3, shared_rows=True))
    return got.select("variable", "e", F.round("skill", 5).alias("skill"))


def candidate_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Dimension at which each candidate's history best predicts v."""
    return selection.candidate_dimensions(wide(spark, d), ["v", "a", "b"], "v", dimensions=3).select("variable", "e", F.round("skill", 5).alias("skill"))


def horizon_skill(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.horizon_sweep(weekly(spark, d), ["v"], ["v"], dimensions=2, horizons=[1, 2, 3]).select("horizon", F.round("skill", 5).alias("skill"))


def horizon_shared(spark: SparkSession, d: str) -> DataFrame:
    """One search at the largest horizon, its neighbours' targets at each."""
    return sweeps.horizon_sweep(weekly(spark, d), ["v"], ["v"], dimensions=2, horizons=[1, 2, 3], shared_neighbors=True).select("horizon", F.round("skill", 5).alias("skill"))


def theta_skill(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.theta_sweep(weekly(spark, d), ["v"], ["v"], dimensions=1, thetas=THETAS).select("theta", F.round("skill", 5).alias("skill"))


THETAS = (0.0, 0.5, 2.0, 8.0)


def _rule(n: int, sizes: tuple[int, ...]) -> list[tuple[int, int, np.ndarray]]:
    """Library subsets by a rule that SQL can follow too: (i * 7919) mod n below the size."""
    return [(s, 0, np.flatnonzero((np.arange(n) * 7919) % n < s)) for s in sizes]


def cross_map_rule(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    got = crossmap.cross_map(w, ["v"], ["a", "b"], dimensions=2, subsets=_rule(w.count() - 1, (30, 80, 200)))
    return got.select("lib_size", "target", F.round("skill", 5).alias("skill"))


def cross_map_all(spark: SparkSession, d: str) -> DataFrame:
    """Every variable maps every variable, each pair at its own dimension; training states are scored."""
    w = wide(spark, d)
    own = {("v", "v"): 1, ("v", "a"): 2, ("a", "v"): 2, ("a", "a"): 1}
    got = crossmap.cross_map(w, ["v", "a"], dimensions=own, subsets=_rule(w.count() - 1, (80,)), mode="sample", horizon=0)
    return got.select("source", "target", F.round("skill", 5).alias("skill"))


def cross_map_flat(spark: SparkSession, d: str) -> DataFrame:
    """A constant target: about 0 where the denominator is clamped, null for training states."""
    w = wide(spark, d).withColumn("k", F.lit(1.5))
    two = {m: crossmap.cross_map(w, ["v"], ["k"], dimensions=1, sizes=[50], repeats=1, mode=m) for m in ("variables", "sample")}
    return two["variables"].withColumn("mode", F.lit("variables")).unionByName(two["sample"].withColumn("mode", F.lit("sample"))).select("mode", F.round("skill", 4).alias("skill"))


def cross_map_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Sizes beyond the library take all of it, so every draw is alike."""
    got = crossmap.cross_map(wide(spark, d), ["v"], ["a"], dimensions=2, sizes=[100_000], repeats=2)
    return got.select("lib_size", "repeat", F.round("skill", 5).alias("skill"))


def cross_map_slope(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    n = w.count() - 1
    got = crossmap.cross_map(w, ["v"], ["a", "b"], dimensions=2, subsets=_rule(n, (30, 80, 200)))
    return crossmap.convergence(got, n).select("target", F.round("slope", 4).alias("slope"))


def multiview_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Three views of two columns, the best two kept."""
    return multiview.multiview(wide(spark, d), ["v", "a", "b"], ["v"], dimensions=1, view_size=2, top=2)[0].select("pos", F.round("pred", 4).alias("pred"))


def multiview_ranks(spark: SparkSession, d: str) -> DataFrame:
    got = multiview.multiview(wide(spark, d), ["v", "a", "b"], ["v"], dimensions=2, view_size=2, top=3)[1]
    return got.select("rank", F.get("combo", F.lit(0)).alias("c0"), F.get("combo", F.lit(1)).alias("c1"), F.round("corr", 5).alias("corr"), F.round("max_ae", 3).alias("max_ae"), F.round("sum_ae", 2).alias("sum_ae"), F.round("rmse", 3).alias("rmse"))


def first_choice(spark: SparkSession, d: str) -> DataFrame:
    """Score of every candidate alone."""
    return selection.candidate_scores(wide(spark, d), ["v", "a", "b"], "v").select("variable", F.round("score", 5).alias("score"))


def greedy_choice(spark: SparkSession, d: str) -> DataFrame:
    """Three steps; a constant column never enters."""
    w = wide(spark, d).withColumn("k", F.lit(2.0))
    steps = selection.select_variables(w, ["k", "v", "a", "b"], "v", most=3, spread=0.01)
    return spark.createDataFrame(steps, "step int, variable string, score double, slope double").select("step", "variable", F.round("score", 5).alias("score"))


def target_choice(spark: SparkSession, d: str) -> DataFrame:
    """The target's own column comes first and counts; all candidates' scores of the one step left."""
    got = selection.choose(wide(spark, d), ["a", "b"], "v", most=2, include_target=True)
    table = spark.createDataFrame(got.scores, "step int, variable string, score double")
    return table.select("step", "variable", F.round("score", 5).alias("score"), F.col("variable").isin(got.variables).alias("chosen"))


def selected_forecast(spark: SparkSession, d: str) -> DataFrame:
    return selection.predict_selected(wide(spark, d), ["v", "b"], "v").select("pos", F.round("pred", 4).alias("pred"))


FOLD_CHOICE = [(f, [(1, "v", 0.0, None), (2, "a", 0.0, None)]) for f in range(3)]


def fold_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Each fold's block predicted from the other blocks by given variables."""
    return crossval.fold_predictions(wide(spark, d), FOLD_CHOICE, "v", 3).select("fold", "pos", F.round("pred", 4).alias("pred"))


def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    return crossval.fold_scores(w, crossval.fold_predictions(w, FOLD_CHOICE, "v", 3), "v", 3).select("fold", F.round("score", 5).alias("score"))


def fold_runs(spark: SparkSession, d: str) -> DataFrame:
    """One fold a run."""
    return crossval.with_folds(by_flag(spark, d)).groupBy("run_id").agg(F.max("fold").cast("long").alias("fold"), F.count("*").alias("n"))


def fold_blocks(spark: SparkSession, d: str) -> DataFrame:
    return crossval.with_folds(weekly(spark, d), 4).groupBy("fold").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).select(F.col("fold").cast("long").alias("fold"), "first", "last", "n")


def cross_map_folds(spark: SparkSession, d: str) -> DataFrame:
    got = crossval.cross_map_by_fold(wide(spark, d), ["v"], ["a"], folds=3, dimensions=1, subsets=_rule(200, (30, 90)))
    return got.select("lib_size", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def generate_weekly(spark: SparkSession, d: str) -> DataFrame:
    return generate.generate(weekly(spark, d), ["v"], 4, 2).select("pos", F.round("value", 3).alias("value"))


def generate_linear(spark: SparkSession, d: str) -> DataFrame:
    """S-map at theta 0 in one dimension: the regression line applied again and again."""
    return generate.generate(weekly(spark, d), ["v"], 4, 1, theta=0.0).select("pos", F.round("value", 3).alias("value"))


def _moved(s: DataFrame, w: DataFrame) -> DataFrame:
    return s.join(w.select("pos", "v"), "pos")


def surrogate_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Shuffling keeps the values and moves most of them."""
    w = weekly(spark, d)
    s = _moved(surrogates.surrogates(w, "v", "random_shuffle", 5), w)
    return s.groupBy("surrogate_id").agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 0).alias("squares"), F.min("value").alias("low"), F.max("value").alias("high"), (F.sum((F.col("value") != F.col("v")).cast("int")) * 2 > F.count("*")).alias("moved"))


def surrogate_phase(spark: SparkSession, d: str) -> DataFrame:
    """Turned phases keep mean, scatter and circular autocovariance (to the length's last digit) and move the values."""
    w = weekly(spark, d)
    s = _moved(surrogates.surrogates(w, "v", "ebisuzaki", 3), w)
    n = F.count("*").over(Window.partitionBy("surrogate_id"))
    each = s.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("surrogate_id"))).withColumn("n", n)
    for k in (1, 2, 5):
        o = each.select("surrogate_id", F.pmod(F.col("pos") - k, F.col("n")).alias("pos"), F.col("c").alias(f"c{k}"))
        each = each.join(o, ["surrogate_id", "pos"])
    return each.groupBy("surrogate_id").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_pop("value"), 3).alias("sd"), *[F.round(F.sum(F.col("c") * F.col(f"c{k}")) / 1e4, 1).alias(f"lag{k}") for k in (1, 2, 5)], (F.sum((F.abs(F.col("value") - F.col("v")) > 1).cast("int")) * 2 > F.count("*")).alias("moved"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved_forecast(spark: SparkSession, d: str) -> DataFrame:
    """A forecast saved as a record and loaded again."""
    path = _folder(spark, "record")
    results.save(path, "simplex", {"dimensions": 3}, predictions=simplex.simplex(weekly(spark, d), ["v"], ["v"], dimensions=3))
    kind, parameters, loaded = results.load(spark, path)
    return _rounded(loaded["predictions"]).withColumn("kind", F.lit(kind)).withColumn("dimensions", F.lit(parameters["dimensions"]))


def csv_series(spark: SparkSession, d: str) -> DataFrame:
    """A series written as CSV with words among the numbers, read as runs of positions and values."""
    path = _folder(spark, "csv")
    s = by_flag(spark, d).select("run_id", F.col("pos").alias("Week No"), F.when(F.col("pos") % 10 == 3, "n/a").otherwise(F.col("v").cast("string")).alias("Var 1"))
    s.write.option("header", True).csv(path)
    return tables.read_series(spark, path, ["Var 1"], order="Week No", run="run_id").withColumnRenamed("Var 1", "v")


def surrogate_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "surrogates")
    surrogates.write_csv(surrogates.surrogates(weekly(spark, d), "v", "random_shuffle", 2), path)
    back = spark.read.option("header", True).schema("surrogate_id int, run_id long, pos long, value double").csv(path)
    return back.groupBy("surrogate_id").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """The lagged samples of three species as runs: the row of each state that holds, time as position; grows with the data."""
    b = spark.read.parquet(f"{d}/block_3sp.parquet").where("state_id IS NOT NULL AND run_id IS NOT NULL AND time IS NOT NULL")
    one = b.groupBy("run_id", "time").agg(*[F.min(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("x_t", "y_t", "z_t")])
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("time")) - 1
    return one.select("run_id", at.cast("long").alias("pos"), "x_t", "y_t", "z_t")


def simplex_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every sample's next z from all runs' histories of x."""
    s = samples(spark, d).withColumn("z_t", F.coalesce("z_t", F.lit(0.0)))
    return _rounded(simplex.simplex(s, ["x_t"], ["z_t"], dimensions=2))


def vector_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of every 50th ready-made state among all embeddings, itself aside."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.lit(0).alias("run_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("state"))
    q = e.where("pos % 50 = 0").withColumn("out_pos", F.col("pos"))
    return neighbors(e.withColumn("y", F.array(F.lit(0.0))), q, 5, True, 0).select("pos", "rank", "l_pos")


QUERIES = {
    f.__name__: f
    for f in (
        spine_hourly, lag_states, training_pairs, knn_inside, knn_radius, simplex_weekly, simplex_back, simplex_runs, simplex_split, simplex_mask, forecast_score, scores, smap_global, smap_local, smap_three, embedding_skill, best_embedding, candidate_dimensions,
        horizon_skill, horizon_shared, theta_skill, cross_map_rule, cross_map_all, cross_map_flat, cross_map_clamp, cross_map_slope, multiview_weekly, multiview_ranks, first_choice, greedy_choice, target_choice, selected_forecast, fold_blocks, fold_runs, fold_forecast,
        fold_scores, cross_map_folds, generate_weekly, generate_linear, surrogate_shuffle, surrogate_phase, surrogate_csv, saved_forecast, csv_series, simplex_samples, vector_neighbors,
    )
}


def _series(name: str, table: str, t: str, v: str, unit: str, run: str = "0") -> str:
    return f"""
{name}_s AS (SELECT {run} AS run_id, date_trunc('{unit}', {t}) AS t, round(sum({v}), 4) AS v FROM {table} GROUP BY ALL),
{name}_t AS (SELECT unnest(generate_series((SELECT min(t) FROM {name}_s), (SELECT max(t) FROM {name}_s), INTERVAL 1 {unit})) AS t),
{name} AS (SELECT r.run_id, CAST(row_number() OVER (PARTITION BY r.run_id ORDER BY x.t) - 1 AS BIGINT) AS pos, coalesce(s.v, 0) AS v
  FROM (SELECT DISTINCT run_id FROM {name}_s) r CROSS JOIN {name}_t x LEFT JOIN {name}_s s ON s.run_id = r.run_id AND s.t = x.t)"""


_WEEK = _series("w", "lineitem", "l_shipdate", "l_quantity", "week")
_FLAG = _series("w", "lineitem", "l_shipdate", "l_quantity", "week", "CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END")
_WIDE = ",".join(_series(n, "lineitem", "l_shipdate", c, "week") for n, c in (("wv", "l_quantity"), ("wa", "l_discount * 100"), ("wb", "l_tax * 100")))
_WIDE += ", w AS (SELECT run_id, pos, wv.v AS v, wa.v AS a, wb.v AS b FROM wv JOIN wa USING (run_id, pos) JOIN wb USING (run_id, pos))"


def _simplex(states: list[str], y: str, h: int, k: int, train: str = "w", test: str = "w", inside: bool = True, radius: int = 0, extra: str = "TRUE", tag: str = "", asked: str = "TRUE") -> str:
    """CTEs l, q, n and p{tag}: library, queries, neighbours and predictions."""
    win = "OVER (PARTITION BY run_id ORDER BY pos)"
    cols = ", ".join(f"{s} AS s{i}" for i, s in enumerate(states)).replace("@", win)
    full = " AND ".join(f"s{i} IS NOT NULL" for i in range(len(states)))
    dist = "sqrt(" + " + ".join(f"(q.s{i} - l.s{i}) * (q.s{i} - l.s{i})" for i in range(len(states))) + ")"
    lead = f"lead({y}, {h}) {win}" if h > 0 else f"lag({y}, {-h}) {win}" if h < 0 else y
    allowed = f"NOT (q.run_id = l.run_id AND abs(q.pos - l.pos) <= {radius})" if inside else "TRUE"
    gap = "CASE WHEN q.run_id = l.run_id THEN abs(q.pos - l.pos) ELSE 1099511627776 END" if inside else "0"
    return f"""
l{tag} AS (SELECT * FROM (SELECT run_id, pos, {cols}, {lead} AS y FROM {train}) WHERE {full} AND y IS NOT NULL AND {extra}),
q{tag} AS (SELECT *, pos + {h} AS out_pos FROM (SELECT run_id, pos, {cols}, max(pos) OVER (PARTITION BY run_id) AS last FROM {test}) WHERE {full} AND pos + {h} BETWEEN 0 AND last AND {asked}),
n{tag} AS (SELECT * FROM (SELECT q.run_id, q.pos, q.out_pos, l.pos AS l_pos, l.y, {dist} AS d,
  row_number() OVER (PARTITION BY q.run_id, q.pos ORDER BY {dist}, {gap}, l.run_id, l.pos) AS rank FROM q{tag} q JOIN l{tag} l ON {allowed}) WHERE rank <= {k}),
e{tag} AS (SELECT *, exp(-d / greatest(min(d) OVER (PARTITION BY run_id, pos), 1e-6)) AS w FROM n{tag}),
m{tag} AS (SELECT run_id, out_pos, sum(w * y) / sum(w) AS pred FROM e{tag} GROUP BY ALL),
p{tag} AS (SELECT e.run_id, e.out_pos AS pos, any_value(m.pred) AS pred, sum(w * (y - m.pred) * (y - m.pred)) / sum(w) AS variance
  FROM e{tag} e JOIN m{tag} m USING (run_id, out_pos) GROUP BY ALL)"""


_LAG = ["v", "lag(v, 1) @", "lag(v, 2) @"]
_OUT = "SELECT w.run_id, w.pos, round(p.pred, 4) AS pred, round(p.variance, 2) AS variance FROM w LEFT JOIN p USING (run_id, pos)"
_SPLIT = ", a AS (SELECT * FROM w WHERE pos < 200), b AS (SELECT run_id, pos - 200 AS pos, v FROM w WHERE pos >= 200)"


def _skill(label: str, value, states: list[str], h: int, k: int, y: str = "v", base: str = "w", extra: str = "TRUE", tag: str = "", asked: str = "TRUE") -> tuple[str, str]:
    return _simplex(states, y, h, k, base, base, tag=tag, extra=extra, asked=asked), f"SELECT {value} AS {label}, round(corr(p.pred, w.{y}), 5) AS skill FROM p{tag} p JOIN w USING (run_id, pos)"


def _union(parts: list[tuple[str, str]], base: str) -> str:
    return f"WITH {base}," + ",".join(p[0] for p in parts) + " " + " UNION ALL ".join(p[1] for p in parts)


_RULE = "(SELECT count(*) - 1 FROM w)"



def _local(theta: float, tag: int = 2) -> str:
    """CTE f{tag}(pos, pred): the weighted regression line in one dimension, in sample."""
    return f"""
l{tag} AS (SELECT * FROM (SELECT pos, v AS s, lead(v) OVER (ORDER BY pos) AS y FROM w) WHERE y IS NOT NULL),
n{tag} AS (SELECT q.pos, q.s AS qs, l.s - q.s AS s, l.y, abs(q.s - l.s) AS d FROM l{tag} q JOIN l{tag} l ON q.pos <> l.pos),
e{tag} AS (SELECT *, exp(-{theta} * d / greatest(avg(d) OVER (PARTITION BY pos), 1e-10)) AS u FROM n{tag}),
c{tag} AS (SELECT pos, sum(u * u) AS n0, sum(u * u * s) AS n1, sum(u * u * s * s) AS n2, sum(u * u * y) AS m0, sum(u * u * s * y) AS m1 FROM e{tag} GROUP BY pos),
f{tag} AS (SELECT pos + 1 AS pos, (m0 * n2 - m1 * n1) / (n0 * n2 - n1 * n1) AS pred FROM c{tag})"""


def _det(m: list[list[str]]) -> str:
    """Determinant of a matrix of SQL terms."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} {m[0][j]} * {_det([r[:j] + r[j + 1 :] for r in m[1:]])}" for j in range(len(m))) + ")"


def _local_three(theta: float) -> str:
    """The weighted map in three dimensions around each query: normal equations by Cramer's rule."""
    cols = ["1", "a", "b", "c"]
    sums = [f"sum(u * u * {x} * {y}) AS m{i}{j}" for i, x in enumerate(cols) for j, y in enumerate(cols) if j >= i] + [f"sum(u * u * {x} * y) AS r{i}" for i, x in enumerate(cols)]
    m = [[f"m{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
    put = lambda k: [[f"r{i}" if j == k else m[i][j] for j in range(4)] for i in range(4)]
    return f"""
l AS (SELECT * FROM (SELECT pos, v AS a, lag(v, 1) OVER (ORDER BY pos) AS b, lag(v, 2) OVER (ORDER BY pos) AS c, lead(v) OVER (ORDER BY pos) AS y FROM w) WHERE c IS NOT NULL AND y IS NOT NULL),
n AS (SELECT q.pos, l.a - q.a AS a, l.b - q.b AS b, l.c - q.c AS c, l.y, sqrt((l.a - q.a) * (l.a - q.a) + (l.b - q.b) * (l.b - q.b) + (l.c - q.c) * (l.c - q.c)) AS d FROM l q JOIN l ON q.pos <> l.pos),
e AS (SELECT *, exp(-{theta} * d / greatest(avg(d) OVER (PARTITION BY pos), 1e-10)) AS u FROM n),
s AS (SELECT pos, {', '.join(sums)} FROM e GROUP BY pos),
f AS (SELECT pos, {_det(put(0))} / {_det(m)} AS pred, {_det(put(1))} / {_det(m)} AS c1, {_det(put(3))} / {_det(m)} AS c3 FROM s),
g AS (SELECT e.pos + 1 AS pos, any_value(f.pred) AS pred, any_value(f.c1) AS c1, any_value(f.c3) AS c3, sum(u * (y - f.pred) * (y - f.pred)) / sum(u) AS variance FROM e JOIN f USING (pos) GROUP BY e.pos)
SELECT w.pos, round(pred, 3) AS pred, round(variance, 1) AS variance, round(c1, 5) AS c1, round(c3, 5) AS c3 FROM w LEFT JOIN g USING (pos)"""


def _views(columns: list[str], names: list[str]) -> str:
    """CTEs x(i, pos, pred) and best(rank, i, ...): every pair of columns as a view, ranked."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    each = ",".join(_simplex([columns[i], columns[j]], "v", 1, 3, tag=f"_{i}_{j}") for i, j in pairs)
    x = " UNION ALL ".join(f"SELECT {n} AS i, {i} AS c0, {j} AS c1, pos, pred FROM p_{i}_{j}" for n, (i, j) in enumerate(pairs))
    return f"""{each}, x AS ({x}),
r AS (SELECT i, c0, c1, corr(x.pred, w.v) AS c, max(abs(x.pred - w.v)) AS m, sum(abs(x.pred - w.v)) AS t, sqrt(avg((x.pred - w.v) * (x.pred - w.v))) AS r FROM x JOIN w USING (pos) GROUP BY i, c0, c1),
best AS (SELECT CAST(row_number() OVER (ORDER BY c DESC, i) AS INTEGER) AS rank, * FROM r)"""


_VIEWS1 = _views(["v", "a", "b"], [])
_VIEWS2 = _views([x for c in "vab" for x in (c, f"lag({c}, 1) @")], [])


def _own_skills(target: str | None) -> str:
    """The best of three dimensions for each variable, on the rows complete at the third."""
    each = [(c, e) for c in "vab" for e in (1, 2, 3)]
    made = ",".join(_simplex([c, *[f"lag({c}, {i}) @" for i in range(1, e)]], target or c, 1, e + 1, extra="pos >= 2", asked="pos >= 2", tag=f"{c}{e}") for c, e in each)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS variable, {e} AS e, corr(p.pred, w.{target or c}) AS skill FROM p{c}{e} p JOIN w USING (run_id, pos)" for c, e in each)
    return f"{made}, k AS ({rows}) SELECT variable, e, round(skill, 5) AS skill FROM k QUALIFY row_number() OVER (PARTITION BY variable ORDER BY skill DESC, e) = 1"


_PAIRS = [("v", "v", 1), ("v", "a", 2), ("a", "v", 2), ("a", "a", 1)]
_CCM = ",".join(_simplex(["v", "lag(v, 1) @"], y, 0, 3, extra=f"((pos - 1) * 7919) % {_RULE} < {s}", tag=f"{y}{s}") for y in "ab" for s in (30, 80, 200))
_CCM_OUT = " UNION ALL ".join(f"SELECT {s} AS lib_size, '{y}' AS target, corr(p.pred, w.{y}) AS skill FROM p{y}{s} p JOIN w USING (run_id, pos)" for y in "ab" for s in (30, 80, 200))
_STEPS = (
    ",".join(_simplex(list(c), "v", 1, len(c) + 1, tag=c) for c in ("v", "a", "b", "va", "vb", "ab", "vab"))
    + ", one AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, corr(p.pred, w.v) AS s FROM p{c} p JOIN w USING (run_id, pos)" for c in "vab")
    + "), two AS (" + " UNION ALL ".join(f"SELECT '{c[0]}' AS c, '{c[1]}' AS d, corr(p.pred, w.v) AS s FROM p{c} p JOIN w USING (run_id, pos)" for c in ("va", "vb", "ab"))
    + "), three AS (SELECT corr(p.pred, w.v) AS s FROM pvab p JOIN w USING (run_id, pos))"
)
_FOLDS = "z AS (SELECT count(*) AS n FROM w), " + "".join(
    f"te{f} AS (SELECT 1 AS run_id, row_number() OVER (ORDER BY pos) - 1 AS pos, v, a, b FROM w, z WHERE pos >= floor(n * {f} / 3) AND pos < floor(n * {f + 1} / 3)), "
    f"tr{f} AS (SELECT side AS run_id, row_number() OVER (PARTITION BY side ORDER BY pos) - 1 AS pos, v, a, b FROM (SELECT *, CASE WHEN pos < floor(n * {f} / 3) THEN 0 ELSE 2 END AS side FROM w, z WHERE NOT (pos >= floor(n * {f} / 3) AND pos < floor(n * {f + 1} / 3)))), "
    for f in range(3)
)


def _first(fold: int, rows: int, size: int) -> str:
    """Training rows of a fold among the first ``rows``, by the rule."""
    i = f"(pos + CASE WHEN run_id = 2 THEN (SELECT count(*) FROM tr{fold} WHERE run_id = 0) ELSE 0 END)"
    return f"{i} < {rows} AND ({i} * 7919) % {rows} < {size}"


def _grown(steps: int) -> str:
    """Closed loop of simplex forecasts in two dimensions, one CTE a step."""
    out = "l AS (SELECT * FROM (SELECT pos, v AS a, lag(v) OVER (ORDER BY pos) AS b, lead(v) OVER (ORDER BY pos) AS y FROM w) WHERE b IS NOT NULL AND y IS NOT NULL), g0 AS (SELECT max(pos) AS pos, arg_max(v, pos) AS a, (SELECT v FROM w WHERE pos = (SELECT max(pos) - 1 FROM w)) AS b FROM w)"
    for i in range(steps):
        out += f""",
n{i} AS (SELECT g.pos, g.a AS was, l.y, sqrt((l.a - g.a) * (l.a - g.a) + (l.b - g.b) * (l.b - g.b)) AS d FROM l, g{i} g ORDER BY d, l.pos LIMIT 3),
g{i + 1} AS (SELECT pos + 1 AS pos, sum(y * exp(-d / greatest(m, 1e-6))) / sum(exp(-d / greatest(m, 1e-6))) AS a, any_value(was) AS b FROM n{i}, (SELECT min(d) AS m FROM n{i}) GROUP BY pos)"""
    return out + " " + " UNION ALL ".join(f"SELECT pos, round(a, 3) AS value FROM g{i + 1}" for i in range(steps))


ORACLE = {
    "spine_hourly": f"WITH {_series('w', 'events', 'ts', 'value', 'hour')} SELECT pos, v FROM w",
    "lag_states": f"WITH {_WEEK} SELECT * FROM (SELECT pos, v AS s0, lag(v, 1) OVER (ORDER BY pos) AS s1, lag(v, 2) OVER (ORDER BY pos) AS s2 FROM w) WHERE s2 IS NOT NULL",
    "training_pairs": f"WITH {_WEEK} SELECT * FROM (SELECT pos, v AS s0, lag(v, 3) OVER (ORDER BY pos) AS s1, lead(v, 2) OVER (ORDER BY pos) AS y FROM w) WHERE s1 IS NOT NULL AND y IS NOT NULL",
    "knn_inside": f"WITH {_WEEK}, {_simplex(_LAG, 'v', 1, 4)} SELECT pos, rank, l_pos, round(d, 6) AS d FROM n",
    "knn_radius": f"WITH {_WEEK}, {_simplex(_LAG, 'v', 1, 4, radius=5)} SELECT pos, rank, l_pos, round(d, 6) AS d FROM n",
    "simplex_weekly": f"WITH {_WEEK}, {_simplex(_LAG, 'v', 1, 4)} {_OUT}",
    "simplex_back": f"WITH {_WEEK}, {_simplex(_LAG[:2], 'v', -2, 3)} {_OUT}",
    "simplex_runs": f"WITH {_FLAG}, {_simplex(_LAG[:2], 'v', 1, 3, radius=2)} {_OUT}",
    "simplex_split": f"WITH {_WEEK}{_SPLIT}, {_simplex(_LAG, 'v', 1, 4, 'a', 'b', False)} " + _OUT.replace("FROM w LEFT", "FROM b w LEFT"),
    "scores": f"""WITH {_WEEK}, f AS (SELECT v AS y, lag(v) OVER (ORDER BY pos) AS p FROM w), g AS (SELECT * FROM f WHERE p IS NOT NULL)
SELECT round(corr(y, p), 6) AS corr, round(corr(y, p), 6) AS corr0, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(max(abs(y - p)), 6) AS max_ae,
  round(sum(abs(y - p)), 6) AS sum_ae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, CAST(0 AS DOUBLE) AS flat_clamped, CAST(NULL AS DOUBLE) AS flat FROM g""",
    "smap_global": f"""WITH {_WEEK}{_SPLIT}, l AS (SELECT v AS s, lead(v) OVER (ORDER BY pos) AS y FROM a), f AS (SELECT regr_slope(y, s) AS m, regr_intercept(y, s) AS c FROM l WHERE y IS NOT NULL)
SELECT b.pos, round(c + m * u.v, 4) AS pred, CASE WHEN u.v IS NOT NULL THEN round(m, 6) END AS slope FROM b CROSS JOIN f LEFT JOIN b u ON u.pos = b.pos - 1""",
    "smap_local": f"WITH {_WEEK}, {_local(2)} SELECT w.pos, round(pred, 3) AS pred FROM w LEFT JOIN f2 USING (pos)",
    "theta_skill": f"WITH {_WEEK}, " + ", ".join(_local(t, i) for i, t in enumerate(THETAS)) + " " + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS theta, round(corr(pred, v), 5) AS skill FROM f{i} JOIN w USING (pos)" for i, t in enumerate(THETAS)),
    "smap_three": f"WITH {_WEEK}, {_local_three(3)}",
    "simplex_mask": f"WITH {_WEEK}, {_simplex(_LAG[:2], 'v', 1, 3, extra='pos % 3 <> 0')} {_OUT}",
    "forecast_score": f"WITH {_FLAG}, {_simplex(_LAG[:2], 'v', 1, 3, radius=2)} SELECT 'v' AS target, round(corr(p.pred, w.v), 5) AS score, round(avg(abs(p.pred - w.v)), 4) AS mean_ae FROM p JOIN w USING (run_id, pos)",
    "embedding_skill": _union([_skill("e", e, ["v", *[f"lag(v, {i}) @" for i in range(1, e)]], 1, e + 1, tag=str(e)) for e in range(1, 5)], _WEEK),
    "horizon_skill": _union([_skill("horizon", h, _LAG[:2], h, 3, tag=str(h)) for h in (1, 2, 3)], _WEEK),
    "cross_map_rule": f"WITH {_WIDE}, {_CCM} SELECT lib_size, target, round(skill, 5) AS skill FROM ({_CCM_OUT})",
    "multiview_weekly": f"WITH {_WIDE}, {_VIEWS1} SELECT w.pos, round(avg(x.pred), 4) AS pred FROM w LEFT JOIN (SELECT x.pos, x.pred FROM x JOIN best USING (i) WHERE rank <= 2) x USING (pos) GROUP BY w.pos",
    "multiview_ranks": f"WITH {_WIDE}, {_VIEWS2} SELECT rank, c0, c1, round(c, 5) AS corr, round(m, 3) AS max_ae, round(t, 2) AS sum_ae, round(r, 3) AS rmse FROM best WHERE rank <= 3",
    "first_choice": f"WITH {_WIDE}," + ",".join(_simplex([c], "v", 1, 2, tag=c) for c in "vab") + " " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr(p.pred, w.v), 5) AS score FROM p{c} p JOIN w USING (run_id, pos)" for c in "vab"),
    "best_embedding": f"WITH {_WIDE}, {_own_skills(None)}",
    "candidate_dimensions": f"WITH {_WIDE}, {_own_skills('v')}",
    "horizon_shared": _union([_skill("horizon", h, _LAG[:2], h, 3, tag=str(h), extra="pos + 3 <= (SELECT max(pos) FROM w)", asked="pos + 3 <= last") for h in (1, 2, 3)], _WEEK),
    "cross_map_all": f"WITH {_WIDE}," + ",".join(_simplex([s, f"lag({s}, 1) @"][:e], t, 0, e + 1, extra=f"((pos - 1) * 7919) % {_RULE} < 80 AND pos >= 1", asked="pos >= 1", tag=s + t) for s, t, e in _PAIRS) + " " + " UNION ALL ".join(f"SELECT '{s}' AS source, '{t}' AS target, round(corr(p.pred, w.{t}), 5) AS skill FROM p{s}{t} p JOIN w USING (run_id, pos)" for s, t, _ in _PAIRS),
    "cross_map_flat": "SELECT 'variables' AS mode, CAST(0 AS DOUBLE) AS skill UNION ALL SELECT 'sample', NULL",
    "cross_map_clamp": f"WITH {_WIDE}, {_simplex(_LAG[:2], 'a', 0, 3)} SELECT 100000 AS lib_size, CAST(r AS INTEGER) AS repeat, round(corr(p.pred, w.a), 5) AS skill FROM p JOIN w USING (run_id, pos), range(2) x(r) GROUP BY r",
    "cross_map_slope": f"WITH {_WIDE}, {_CCM}, k AS ({_CCM_OUT}) SELECT target, round(regr_slope(skill, lib_size / (SELECT count(*) - 1.0 FROM w)), 4) AS slope FROM k GROUP BY target",
    "greedy_choice": f"""WITH {_WIDE}, {_STEPS},
c1 AS (SELECT c, s FROM one ORDER BY s DESC LIMIT 1),
c2 AS (SELECT CASE WHEN t.c = c1.c THEN t.d ELSE t.c END AS c, t.s FROM two t, c1 WHERE c1.c IN (t.c, t.d) ORDER BY t.s DESC LIMIT 1),
c3 AS (SELECT o.c, t.s FROM one o, three t, c1, c2 WHERE o.c NOT IN (c1.c, c2.c)),
r AS (SELECT 1 AS step, c AS variable, s FROM c1 UNION ALL SELECT 2, c, s FROM c2 UNION ALL SELECT 3, c, s FROM c3)
SELECT step, variable, round(s, 5) AS score FROM r""",
    "target_choice": f"WITH {_WIDE}, {_STEPS}, t AS (SELECT d AS v, s FROM two WHERE c = 'v') SELECT 1 AS step, v AS variable, round(s, 5) AS score, s = (SELECT max(s) FROM t) AS chosen FROM t",
    "selected_forecast": f"WITH {_WIDE}, {_simplex(['v', 'b'], 'v', 1, 3)} SELECT w.pos, round(p.pred, 4) AS pred FROM w LEFT JOIN p USING (run_id, pos)",
    "fold_forecast": f"WITH {_WIDE}, {_FOLDS}" + ",".join(_simplex(["v", "a"], "v", 1, 3, f"tr{f}", f"te{f}", False, tag=f"f{f}") for f in range(3)) + " " + " UNION ALL ".join(f"SELECT {f} AS fold, t.pos, round(p.pred, 4) AS pred FROM te{f} t LEFT JOIN pf{f} p USING (run_id, pos)" for f in range(3)),
    "fold_scores": f"WITH {_WIDE}, {_FOLDS}" + ",".join(_simplex(["v", "a"], "v", 1, 3, f"tr{f}", f"te{f}", False, tag=f"f{f}") for f in range(3)) + " " + " UNION ALL ".join(f"SELECT {f} AS fold, round(corr(p.pred, t.v), 5) AS score FROM te{f} t JOIN pf{f} p USING (run_id, pos)" for f in range(3)),
    "fold_runs": f"WITH {_FLAG} SELECT CAST(run_id AS INTEGER) AS run_id, CAST(dense_rank() OVER (ORDER BY run_id) - 1 AS BIGINT) AS fold, count(*) AS n FROM w GROUP BY run_id",
    "cross_map_folds": f"WITH {_WIDE}, {_FOLDS}" + ",".join(_simplex(["v"], "a", 0, 2, f"tr{f}", f"te{f}", False, extra=_first(f, 200, n), tag=f"f{f}_{n}") for f in range(3) for n in (30, 90)) + ", k AS (" + " UNION ALL ".join(f"SELECT {n} AS lib_size, corr(p.pred, t.a) AS skill FROM te{f} t JOIN pf{f}_{n} p USING (run_id, pos)" for f in range(3) for n in (30, 90)) + ") SELECT lib_size, round(avg(skill), 5) AS mean, round(stddev_pop(skill), 5) AS std FROM k GROUP BY lib_size",
    "generate_weekly": f"WITH {_WEEK}, " + _grown(4),
    "generate_linear": f"""WITH RECURSIVE {_WEEK}, l AS (SELECT v AS s, lead(v) OVER (ORDER BY pos) AS y FROM w), f AS (SELECT regr_slope(y, s) AS m, regr_intercept(y, s) AS c FROM l WHERE y IS NOT NULL),
g AS (SELECT pos, v FROM w WHERE pos = (SELECT max(pos) FROM w) UNION ALL SELECT g.pos + 1, f.c + f.m * g.v FROM g, f WHERE g.pos < (SELECT max(pos) + 4 FROM w))
SELECT pos, round(v, 3) AS value FROM g WHERE pos > (SELECT max(pos) FROM w)""",
    "surrogate_phase": f"""WITH {_WEEK}, n AS (SELECT count(*) AS n, avg(v) AS m FROM w), c AS (SELECT pos, v - m AS c FROM w, n),
k AS (SELECT x.pos, x.c, a.c AS c1, b.c AS c2, e.c AS c5 FROM c x CROSS JOIN n JOIN c a ON a.pos = (x.pos + 1) % n JOIN c b ON b.pos = (x.pos + 2) % n JOIN c e ON e.pos = (x.pos + 5) % n)
SELECT CAST(i AS INTEGER) AS surrogate_id, (SELECT round(avg(v), 3) FROM w) AS mean, (SELECT round(stddev_pop(v), 3) FROM w) AS sd, round(sum(c * c1) / 1e4, 1) AS lag1, round(sum(c * c2) / 1e4, 1) AS lag2, round(sum(c * c5) / 1e4, 1) AS lag5, TRUE AS moved FROM k, range(3) r(i) GROUP BY i""",
    "surrogate_csv": f"WITH {_WEEK} SELECT CAST(i AS INTEGER) AS surrogate_id, round(sum(v), 2) AS total, count(*) AS n FROM w, range(2) r(i) GROUP BY i",
    "saved_forecast": f"WITH {_WEEK}, {_simplex(_LAG, 'v', 1, 4)} " + _OUT.replace("SELECT ", "SELECT 'simplex' AS kind, 3 AS dimensions, "),
    "csv_series": f"WITH {_FLAG} SELECT CAST(run_id AS BIGINT) AS run_id, pos, CASE WHEN pos % 10 <> 3 THEN v END AS v FROM w",
    "simplex_samples": f"""WITH o AS (SELECT run_id, "time", min(CASE WHEN NOT isnan(x_t) THEN x_t END) AS v, min(CASE WHEN NOT isnan(z_t) THEN z_t END) AS z FROM block_3sp WHERE state_id IS NOT NULL AND run_id IS NOT NULL AND "time" IS NOT NULL GROUP BY 1, 2),
w AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY "time") - 1 AS pos, v, coalesce(z, 0) AS z FROM o), {_simplex(_LAG[:2], 'z', 1, 3)} {_OUT}""",
    "fold_blocks": f"""WITH {_WEEK}, n AS (SELECT count(*) AS n FROM w), e AS (SELECT i, CAST(floor(n * i / 4) AS BIGINT) AS a, CAST(floor(n * (i + 1) / 4) AS BIGINT) AS b FROM n, range(4) r(i))
SELECT i AS fold, a AS first, b - 1 AS last, b - a AS n FROM e""",
    "surrogate_shuffle": f"WITH {_WEEK} SELECT CAST(i AS INTEGER) AS surrogate_id, round(sum(v), 2) AS total, round(sum(v * v), 0) AS squares, TRUE AS moved, min(v) AS low, max(v) AS high FROM w, range(5) r(i) GROUP BY i",
    "vector_neighbors": """SELECT pos, rank, l_pos FROM (SELECT q.vec_id AS pos, l.vec_id AS l_pos,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])), abs(q.vec_id - l.vec_id), l.vec_id) AS INTEGER) AS rank
  FROM embeddings q JOIN embeddings l ON q.vec_id <> l.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
}
