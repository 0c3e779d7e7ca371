"""State-space operators against naive numpy and their invariants."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasefold.estimators import CrossMap, CrossMapFolds, Multiview, Selection, SelectionFolds, Simplex, SMap
from phasefold.functions import scoring
from phasefold.operators import crossmap, crossval, generate, multiview, neighbors, selection, simplex, smap, surrogates, sweeps
from phasefold.operators.embedding import library, query
from phasefold.plans import blocks, cells
from phasefold.sources.results import load, pack, save
from phasefold.sources.tables import read_series
from phasefold.streaming.forecast import forecast_each, windowed


def chaos(n: int = 90, seed: int = 0) -> np.ndarray:
    """Three coupled logistic maps."""
    rng = np.random.default_rng(seed)
    x = np.empty((n, 3))
    x[0] = rng.uniform(0.2, 0.6, 3)
    for t in range(n - 1):
        a, b, c = x[t]
        x[t + 1] = a * (3.8 - 3.8 * a - 0.02 * b), b * (3.5 - 3.5 * b - 0.1 * a), c * (3.7 - 3.7 * c)
    return x


def frame(spark, runs: list[np.ndarray]):
    rows = [(r, t, *[None if np.isnan(v) else float(v) for v in x]) for r, run in enumerate(runs) for t, x in enumerate(run)]
    return spark.createDataFrame(rows, "run_id long, pos long, a double, b double, c double")


def naive(runs, e, step, h, k, radius, column=0, target=0):
    """In-sample simplex, one query at a time."""
    lib = []
    for r, x in enumerate(runs):
        for t in range(len(x)):
            s = [x[t + i * step, column] if 0 <= t + i * step < len(x) else np.nan for i in range(e)]
            if np.isfinite(s).all() and 0 <= t + h < len(x):
                lib.append((r, t, np.array(s), x[t + h, target]))
    out = {}
    for r, t, s, _ in lib:
        near = sorted((np.sqrt(((s - u) ** 2).sum()), abs(t - v) if r == q else 1 << 40, q, v, y) for q, v, u, y in lib if not (q == r and abs(v - t) <= radius))[:k]
        d = np.array([n[0] for n in near])
        w = np.exp(-d / max(d.min(), 1e-6))
        out[r, t + h] = float((w * [n[4] for n in near]).sum() / w.sum())
    return out


@pytest.mark.parametrize("e, step, h, radius, runs", [(3, -1, 1, 0, 1), (2, -2, 0, 3, 2), (2, 1, -1, 0, 2), (1, -1, 2, 1, 1)])
def test_simplex_matches_naive(spark, e, step, h, radius, runs):
    data = [chaos(60, i) for i in range(runs)]
    data[0][7, 0] = np.nan
    got = simplex.simplex(frame(spark, data), ["a"], ["a"], dimensions=e, step=step, horizon=h, radius=radius).collect()
    want = naive(data, e, step, h, e + 1, radius)
    assert len(got) == sum(map(len, data))
    for r in got:
        w = want.get((r["run_id"], r["pos"]), np.nan)
        assert (r["pred"] is None) == bool(np.isnan(w))
        assert r["pred"] is None or abs(r["pred"] - w) < 1e-9


def test_simplex_errors(spark):
    s = frame(spark, [chaos(20)])
    with pytest.raises(ValueError):
        simplex.simplex(s, ["a"], ["a"], s, radius=2)
    with pytest.raises(ValueError):
        simplex.simplex(s, ["a"], ["a"], k=19)
    with pytest.raises(ValueError):
        simplex.simplex(s, ["a"], ["a"], dimensions=40)
    with pytest.raises(ValueError):
        query(s, ["a"], 2, 0)


def test_neighbors_in_blocks_equal_broadcast(spark):
    s = frame(spark, [np.round(chaos(80), 1)])  # many exact ties
    lib, qry = library(s, ["a", "b"], ["c"]), query(s, ["a", "b"])
    one, many, blocks = (sorted(map(tuple, neighbors.neighbors(lib, qry, 4, True, 1, *b).select("pos", "rank", "l_pos", "d").collect())) for b in ((10**6, 1000), (10, 1000), (10, 20)))
    assert one == many == blocks


def test_neighbors_in_cells_equal_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 30)
    monkeypatch.setattr(cells, "LEAST_LANDMARKS", 150)
    monkeypatch.setattr(cells, "LEAF", 8)
    monkeypatch.setattr(blocks, "MOST_QUERIES", 10)  # so cells are laid out several times
    monkeypatch.setattr(neighbors, "fan_out", lambda to: 1.0)  # blocks shuffle less here
    runs = [np.round(chaos(200, i), 3 - i) for i in range(3)]  # distinct states, many exact ties and one state of many rows
    runs[1][20:70] = 0.5
    s = frame(spark, runs)
    for dimensions, inside, radius in ((2, True, 2), (1, True, 0), (2, False, 0)):
        lib, qry = library(s, ["a"], ["c"], dimensions), query(s if inside else frame(spark, [chaos(200, 7)]), ["a"], dimensions)
        to = neighbors._cells(lib, 4, inside, radius, lib.count(), qry.count(), dimensions)
        assert to is not None and to.depth >= 3
        one, parts = (sorted(map(tuple, neighbors.neighbors(lib, qry, 4, inside, radius, *b).select("run_id", "pos", "out_pos", "rank", "l_run", "l_pos", "d", "y").collect())) for b in ((10**6,), (10, 1000, None, dimensions)))
        assert one == parts and len(one) == 4 * qry.count()
    lib, qry = library(s, ["a"], ["c"], 2), query(s, ["a"], 2)
    flat = library(frame(spark, [np.full((300, 3), 0.5)]), ["a"], ["c"], 2)
    assert neighbors._cells(flat, 4, True, 0, 298, 298, 2) is None  # one state in all rows: blocks spread it
    few = neighbors.neighbors(lib.where("run_id = 0 AND pos < 5"), qry, 4, True, 1, 10, 1000, None, 2)  # fewer candidates than k
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, neighbors.neighbors(lib.where("run_id = 0 AND pos < 5"), qry, 4, True, 1).collect()))


def test_simplex_of_many_states_shows_no_task_the_whole_library(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_NUMBERS", 15_000)  # half of the library's numbers
    rng = np.random.default_rng(2)
    v = rng.normal(size=(250, 42))
    run, pos = np.divmod(np.arange(v.size), 42)
    s = spark.createDataFrame(pd.DataFrame({"run_id": run, "pos": pos, "a": v.ravel()}))
    got = simplex.simplex(s, ["a"], ["a"], dimensions=2).toPandas().set_index(["run_id", "pos"]).pred
    assert len(got) == v.size and got.isna().sum() == 500
    S, y = np.column_stack([v[:, 1:-1].ravel(), v[:, :-2].ravel()]), v[:, 2:].ravel()
    for i in rng.choice(len(S), 200, False):
        d = np.hypot(*(S - S[i]).T)
        d[i] = np.inf
        at = np.argsort(d)[:3]
        w = np.exp(-d[at] / d[at].min())
        assert abs(got[i // 40, i % 40 + 2] - (w * y[at]).sum() / w.sum()) < 1e-9


def test_smap_theta_0_is_least_squares(spark):
    x = chaos(80)
    got = smap.smap(frame(spark, [x[:60]]), ["a"], ["b"], frame(spark, [x[60:]]), dimensions=2).toPandas()
    S, Q = np.column_stack([x[1:59, 0], x[:58, 0]]), np.column_stack([x[61:79, 0], x[60:78, 0]])
    c = np.linalg.lstsq(np.column_stack([np.ones(len(S)), S]), x[2:60, 1], rcond=None)[0]
    want = dict(zip(range(2, 20), c[0] + Q @ c[1:], strict=True))
    assert len(got) == 20 and set(got.pos[got.pred.notna()]) == set(want)
    assert all(abs(r.pred - want[r.pos]) < 1e-9 for r in got.itertuples() if r.pos in want)


def test_smap_skips_missing_targets(spark):
    x = chaos(40)
    x[10, 1] = np.nan
    got = smap.smap(frame(spark, [x]), ["a"], ["b"], theta=2.0).toPandas()
    assert got.pred.notna().sum() == 39 and len(got) == 40 and got.coef.isna().sum() == 1


def test_scores(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(size=30), rng.normal(size=30)
    rows = [(float(a), float(b)) for a, b in zip(y, p, strict=True)] + [(None, 1.0), (1.0, float("nan")), (float("inf"), 2.0)]
    df = spark.createDataFrame(rows, "y double, p double")
    f = [scoring.correlation, scoring.r2, scoring.max_absolute_error, scoring.sum_absolute_error, scoring.rmse]
    got = df.agg(*[g(F.col("y"), F.col("p")).alias(str(i)) for i, g in enumerate(f)]).first()
    want = [np.corrcoef(y, p)[0, 1], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs(y - p).max(), abs(y - p).sum(), np.sqrt(((y - p) ** 2).mean())]
    assert np.allclose(list(got), want)
    flat = df.agg(scoring.correlation(F.col("y"), F.lit(2.0)), scoring.correlation_or_zero(F.col("y"), F.lit(2.0)), scoring.clamped_correlation(F.col("y"), F.lit(2.0))).first()
    assert flat[0] is None and flat[1] == 0.0 and abs(flat[2]) < 1e-9
    assert df.limit(3).agg(scoring.rmse(F.col("y"), F.col("p"))).first()[0] is None
    with pytest.raises(ValueError):
        scoring.metric("none")


def test_sweeps(spark):
    s = frame(spark, [chaos(70)])
    got = {(r["e"]): r["skill"] for r in sweeps.embedding_sweep(s, ["a"], ["a"], dimensions=3).collect()}
    for e in (1, 2, 3):
        w = naive([chaos(70)], e, -1, 1, e + 1, 0)
        pos = sorted(w)
        assert abs(got[e] - np.corrcoef([w[q] for q in pos], [chaos(70)[q[1], 0] for q in pos])[0, 1]) < 1e-9
    best = sweeps.best_dimension(sweeps.embedding_sweep(s, ["a", "b"], dimensions=3)).collect()
    assert {r["variable"] for r in best} == {"a", "b"}
    assert sweeps.horizon_sweep(s, ["a"], ["a"], horizons=[1, 5]).orderBy("horizon").first()["skill"] > 0.9
    assert sweeps.theta_sweep(s, ["a"], ["a"], thetas=(0.0, 4.0)).count() == 2


def test_cross_map_converges_and_repeats(spark):
    s = frame(spark, [chaos(150)])
    a = crossmap.cross_map(s, ["b"], ["a"], dimensions=2, sizes=[15, 60, 140], repeats=4, seed=3)
    m = {r["lib_size"]: r["skill"] for r in crossmap.mean_skill(a).collect()}
    assert m[140] > m[15]
    assert crossmap.convergence(a, 149).first()["slope"] > 0
    again = crossmap.cross_map(s, ["b"], ["a"], dimensions=2, sizes=[15, 60, 140], repeats=4, seed=3, mode="sample")
    assert np.allclose(*[d.orderBy("lib_size", "repeat").toPandas().skill for d in (a, again)])
    with pytest.raises(ValueError):
        crossmap.cross_map(s, ["b"], ["a"], s, mode="sample")


def test_multiview_and_selection(spark):
    s = frame(spark, [chaos(80)])
    pred, ranked = multiview.multiview(s, ["a", "b", "c"], ["a"], dimensions=2, view_size=2)
    assert ranked.count() == 3 and pred.where("pred IS NOT NULL").count() == 78
    steps = selection.select_variables(s, ["a", "b", "c"], "a", most=2)
    assert steps[0][1] == "a" and len(steps) <= 2
    by_score = selection.candidate_scores(s, ["a", "b", "c"], "a").orderBy(F.desc("score")).first()
    assert by_score["variable"] == "a" and abs(by_score["score"] - steps[0][2]) < 1e-12
    kept = selection.select_variables(s, ["b", "c"], "a", most=2, include_target=True, gate="post", least_slope=-5.0)
    assert len(kept) == 1
    with pytest.raises(ValueError):
        selection.select_variables(s, ["b"], "a", gate=True)


def test_folds(spark):
    assert crossval.fold_edges(10, 4) == [(0, 2), (2, 5), (5, 7), (7, 10)]
    s = frame(spark, [chaos(10), chaos(10)])
    marked = crossval.with_folds(s, 4)
    train, test = crossval.split(marked, 1)
    assert test.count() == 6 and train.count() == 14
    assert train.select("run_id").distinct().count() == 4
    assert crossval.with_folds(s).select("fold").distinct().count() == 2
    got = CrossMapFolds(["a"], ["b"], {"folds": 2, "dimensions": 1, "sizes": [3], "repeats": 1}).fit(frame(spark, [chaos(40)]))
    assert got.count() == 1
    assert crossval.best_fold([(0, []), (1, [(1, "a", 0.5, None)]), (2, [(1, "b", 0.5, None)])]) == 1
    assert crossval.frequent_variables([(0, [(1, "b", 0.5, None)]), (1, [(1, "a", 0.5, None), (2, "b", 0.6, None)])], 1) == ["b"]


def test_generation_stays_in_range_and_surrogates_keep_their_moments(spark):
    x = chaos(60)
    s = frame(spark, [x, chaos(50, 2)])
    g = generate.generate(s, ["a"], 15, 2).toPandas()
    assert len(g) == 30 and g.value.between(x[:, 0].min() - 0.2, x[:, 0].max() + 0.2).all()
    with pytest.raises(ValueError):
        generate.generate(s, ["a"], 5, 2, step=1)
    one = frame(spark, [x])
    for method in surrogates.METHODS[:2]:
        for _, d in surrogates.surrogates(one, "a", method, 3).toPandas().groupby("surrogate_id"):
            assert abs(d.value.mean() - x[:, 0].mean()) < 1e-9 and abs(d.value.std(ddof=0) - x[:, 0].std()) < 1e-9
    assert surrogates.surrogates(one, "a", "seasonal", 2).count() == 120


def test_estimators_and_results(spark, tmp_path):
    s = frame(spark, [chaos(40)])
    est = Simplex(["a"], ["b"], {"dimensions": 2})
    df = est.fit(s)
    save(str(tmp_path / "r"), "simplex", {"dimensions": 2}, predictions=df)
    kind, parameters, tables = load(spark, str(tmp_path / "r"))
    assert kind == "simplex" and parameters == {"dimensions": 2} and tables["predictions"].count() == 40
    assert simplex.score(df, s, ["b"]).first()["score"] is not None
    assert Selection(["a", "b", "c"], ["a"], {"most": 1, "gate": False}).fit(s)["a"][0][1] == "a"


def test_read_series(spark, tmp_path):
    pd.DataFrame({"Time": ["x", "y", "z"], "Var 1": ["1", "n/a", "3"]}).to_csv(tmp_path / "s.csv", index=False)
    got = read_series(spark, str(tmp_path / "s.csv"), ["Var 1"]).orderBy("pos").collect()
    assert [r["Var 1"] for r in got] == [1.0, None, 3.0] and [r["pos"] for r in got] == [0, 1, 2]


def test_masked_rows_predict_but_do_not_train(spark):
    x = chaos(60)
    s = frame(spark, [x]).withColumn("m", F.when(F.col("pos") != 5, F.col("pos") % 3 != 0))
    got = {r["pos"]: r["pred"] for r in simplex.simplex(s, ["a"], ["b"], dimensions=2, mask="m").collect()}
    use = [t for t in range(1, 59) if t % 3 and t != 5]
    for t in range(1, 59):
        near = sorted((np.hypot(x[t, 0] - x[u, 0], x[t - 1, 0] - x[u - 1, 0]), abs(t - u), u) for u in use if u != t)[:3]
        d = np.array([n[0] for n in near])
        w = np.exp(-d / max(d.min(), 1e-6))
        assert abs(got[t + 1] - (w * x[[n[2] + 1 for n in near], 1]).sum() / w.sum()) < 1e-9
    assert got[0] is None and got[1] is None


def test_smap_coefficients_and_singular_values(spark):
    x = chaos(50)
    got = smap.smap(frame(spark, [x]), ["a", "b"], ["c"], theta=3.0, k=20, radius=2).toPandas().set_index("pos")
    for t in (10, 30, 48):
        d = np.hypot(*(x[:49, :2] - x[t, :2]).T)
        d[max(0, t - 2) : t + 3] = np.inf
        at = np.lexsort((np.arange(49), np.abs(np.arange(49) - t), d))[:20]
        w = np.exp(-3 * d[at] / d[at].mean())
        A = np.column_stack([np.ones(20), x[at, :2]]) * w[:, None]
        c = np.linalg.lstsq(A, x[at + 1, 2] * w, rcond=None)[0]
        row = got.loc[t + 1]
        assert np.allclose(row.coef, c, atol=1e-8) and np.allclose(row.sv, np.linalg.svd(A, compute_uv=False)) and abs(row.pred - c @ [1, *x[t, :2]]) < 1e-9
        assert abs(row.variance - (w * (x[at + 1, 2] - row.pred) ** 2).sum() / w.sum()) < 1e-9
    with pytest.raises(ValueError):
        smap.smap(frame(spark, [x]), ["a"], ["b"], k=49)
    with pytest.raises(ValueError):
        smap.smap(frame(spark, [x]), ["a"], ["none"])


def naive_skill(S, y, rows, queries, k):
    pred = []
    for q in queries:
        d = np.array([np.inf if r == q else np.sqrt(((S[r] - S[q]) ** 2).sum()) for r in rows])
        at = np.lexsort((np.arange(len(rows)), np.abs(rows - q), d))[:k]
        w = np.where(np.isfinite(d[at]), np.exp(-d[at] / max(d[at].min(), 1e-6)), 0)
        pred.append((w * y[rows[at]]).sum() / w.sum())
    return np.corrcoef(pred, y[queries])[0, 1]


def test_cross_map_draws_equal_numpy_and_dimensions_are_searched(spark):
    x = chaos(70)
    s = frame(spark, [x])
    got = crossmap.cross_map(s, ["b"], ["a"], dimensions=2, sizes=[20, 50], repeats=2, seed=9).collect()
    S = np.column_stack([x[1:, 1], x[:-1, 1]])
    want = {(size, r): naive_skill(S, x[1:, 0], np.sort(at), np.arange(69), 3) for size, r, at in crossmap.draws(69, [20, 50], 2, 9)}
    assert all(abs(r["skill"] - want[r["lib_size"], r["repeat"]]) < 1e-9 for r in got) and len(got) == 4
    own = sweeps.own_dimension(s, ["a", "b"], dimensions=4, horizon=1)
    found = crossmap.cross_map(s, ["a", "b"], dimensions=None, max_dimensions=4, sizes=[30], repeats=1, horizon=1)
    given = crossmap.cross_map(s, ["a", "b"], dimensions=own, sizes=[30], repeats=1, horizon=1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, given.collect())) and found.count() == 4
    tables = crossmap.dimension_table({"a": 2, ("b", "a"): 3, ("b", "b"): 1}, ["a", "b"], ["a", "b"])
    assert tables == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 3, ("b", "b"): 1}
    assert crossmap.cross_map(s, ["b"], ["a"], dimensions=1).select("lib_size").distinct().count() == 5


def test_gates_and_candidate_dimensions(spark):
    x = chaos(90)
    rng = np.random.default_rng(0)
    rows = [(0, t, *map(float, v), float(rng.normal())) for t, v in enumerate(x)]
    s = spark.createDataFrame(rows, "run_id long, pos long, a double, b double, c double, z double")
    args = dict(most=2, percents=(20, 50, 80), repeats=3, max_dimensions=3)
    slopes = selection.convergence_slopes(s, ["b", "z"], "a", 2, 89, (20, 50, 80), 3, 0, -1, 1, 0)
    skills = crossmap.mean_skill(crossmap.cross_map(s, ["a"], ["b", "z"], dimensions=2, horizon=1, sizes=[17, 44, 71], repeats=3, mode="sample")).toPandas()
    for c, g in skills.groupby("target"):
        assert abs(slopes[c] - np.polyfit(g.lib_size / 89, g.skill, 1)[0]) < 1e-9
    assert selection.convergence_slopes(s, ["b"], "a", 2, 89, (50,), 3, 0, -1, 1, 0) == {"b": 0.5}
    high = max(slopes.values()) + 1
    for gate in ("pre", "post"):
        assert selection.choose(s, ["b", "z"], "a", gate=gate, least_slope=high, dimensions=2, **args).steps == []
        some = selection.choose(s, ["b", "z"], "a", gate=gate, least_slope=-9.0, dimensions=None, **args)
        assert some.variables and {v for v, _, _ in some.dimensions} == {"b", "z"}
        assert (some.steps[0][3] is None) == (gate == "pre")
    peaks = {v: p for v, _, p in some.dimensions}
    kept = selection.choose(s, ["b", "z"], "a", gate="pre", least_slope=-9.0, dimensions=None, least_peak=peaks["b"], **args)
    assert kept.variables == ["b"]
    own = selection.candidate_scores(s, ["b", "z"], "a", metric=lambda t, p: -F.avg(F.abs(t - p)))
    assert own.where("score < 0").count() == 2


def test_folds_predict_and_reselect(spark):
    x = chaos(60)
    s = frame(spark, [x])
    est = SelectionFolds(["a", "b", "c"], ["a"], {"folds": 3, "gate": False, "most": 2})
    got = est.fit(s)["a"]
    assert len(got) == 3 and est.best_folds()["a"] in (0, 1, 2)
    made = est.fold_predictions()
    assert made.count() == 60 and made.where("pred IS NOT NULL").count() == 57
    score = {r["fold"]: r["score"] for r in crossval.fold_scores(s, made, "a", 3).collect()}
    assert all(abs(score[f] - steps[-1][2]) < 1e-9 for f, steps in got)
    assert [t[2] for t in crossval.stepwise_scores(got) if t[0] == 0] == [g[1] for g in got[0][1]]
    for how in crossval.FINAL:
        est.settings["how"] = how
        chosen = est.variables()["a"]
        assert chosen and set(chosen) <= {"a", "b", "c"}
    assert est.predict(frame(spark, [chaos(20, 5)])).where("pred IS NOT NULL").count() == 19
    assert crossval.fold_predictions(s, [(0, [])], "a", 3).where("pred IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        crossval.final_variables(s, got, ["a"], "a", "other")


def test_estimators_run(spark):
    s, t = frame(spark, [chaos(50)]), frame(spark, [chaos(30, 3)])
    assert SMap(["a"], ["b"], {"theta": 1.0}).fit(s, t).count() == 30
    pred, ranked = Multiview(["a", "b"], ["a"], {"view_size": 1, "rank_inside": False}).fit(s, t)
    assert pred.count() == 30 and ranked.count() == 1
    assert CrossMap(["a"], ["b"], {"dimensions": 1, "sizes": [10], "repeats": 2}).fit(s).count() == 1
    est = Selection(["a", "b"], ["a", "b"], {"gate": False, "most": 1})
    est.fit(s)
    assert est.predict(t).count() == 60 and est.predict(t, theta=1.0).where("target = 'a' AND pred IS NOT NULL").count() == 29


def test_records_are_packed(spark):
    df = spark.createDataFrame([(1, "a", "b", 0.5, 9)], "lib_size long, source string, target string, skill double, more int")
    assert pack("cross_map", "skills", df).dtypes == [("lib_size", "int"), ("source", "string"), ("target", "string"), ("skill", "double")]
    with pytest.raises(ValueError):
        pack("cross_map", "skills", df.drop("skill"))
    with pytest.raises(ValueError):
        pack("cross_map", "other", df)


def test_generation_by_linear_map_and_seasonal_trend(spark):
    x = chaos(40)
    got = generate.generate(frame(spark, [x, chaos(30, 4)]), ["a"], 3, 1, theta=0.0).where("run_id = 0").orderBy("pos").toPandas().value
    m, c = np.polyfit(x[:-1, 0], x[1:, 0], 1)
    want, v = [], x[-1, 0]
    for _ in range(3):
        v = c + m * v
        want.append(v)
    assert np.allclose(got, want)
    v = np.random.default_rng(3).normal(size=25).cumsum()
    d = np.diff(np.eye(25), 2, axis=0)
    assert np.allclose(surrogates.smoothed(v, 100.0), np.linalg.solve(np.eye(25) + 100 * d.T @ d, v))
    assert np.allclose(surrogates.smoothed(v[:2], 5.0), v[:2])


def test_blocks_refuse_what_does_not_fit(spark, monkeypatch):
    s = frame(spark, [chaos(30)])
    lib, qry = blocks.frames(s, ["a"], ["b"])
    monkeypatch.setattr(blocks, "MOST_NUMBERS", 10)
    with pytest.raises(Exception, match="too large for a task"):
        blocks.over_blocks(lib, qry, lambda p: iter(()), "x long", True).count()
    with pytest.raises(ValueError):
        blocks.over_blocks(lib.where("false"), qry, lambda p: iter(()), "x long", True)


def test_streamed_windows_are_forecast(spark, tmp_path):
    pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=300, freq="20min").astype("datetime64[us]"), "value": np.arange(300.0)}).to_parquet(tmp_path / "in.parquet")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "*.parquet"))
    seen = []
    q = forecast_each(windowed(stream, "ts", "value"), lambda df: df.withColumn("next", F.col("v") * 2), lambda df, n: seen.extend(df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    first = sorted(seen)[0]
    assert len(seen) >= 95 and first["v"] == 3.0 and first["next"] == 6.0
