"""Kernels, expressions, the chain language, frames and streams on small hand-made cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.frame import Expr, Frame
from tessera.functions import exprs, kernels
from tessera.functions import special as sp
from tessera.operators import graph, joins, models
from tessera.plans import chain
from tessera.streaming import buckets


def test_special_functions():
    assert sp.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert sp.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95)
    assert sp.f_cdf(4.102821, 2, 10) == pytest.approx(0.95, abs=1e-6)
    assert sp.norm_ppf(0.975) == pytest.approx(1.959963984540054)
    assert sp.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert sp.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert sp.binom_cdf(3, 10, 0.5) == pytest.approx(sum(math.comb(10, k) for k in range(4)) / 1024)


def test_kendall_against_pairs():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 6, 40), r.integers(0, 6, 40)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(40) for j in range(i))
    t = [sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1]) for v in (x, y)]
    assert kernels.kendall(x, y) == pytest.approx(s / math.sqrt((780 - t[0]) * (780 - t[1])))


def test_series_kernels():
    r = np.random.default_rng(2)
    x = r.normal(size=400)
    assert kernels.acf(np.ones(5), 2).tolist() == [1, 1, 1]
    assert abs(kernels.dfa(x) - 0.5) < 0.15 and abs(kernels.higuchi(x) - 2) < 0.15
    assert kernels.adf(x, 2) < -5 and kernels.kpss(x) < 0.7
    assert kernels.permutation_entropy(np.arange(10.0)) == 0
    ar = np.zeros(3000)
    for t in range(1, 3000):
        ar[t] = 0.6 * ar[t - 1] + r.normal()
    assert kernels.ar_fit(ar, 1)["coefficients"][0] == pytest.approx(0.6, abs=0.06)
    assert kernels.bocpd(np.concatenate([r.normal(0, 0.1, 50), r.normal(5, 0.1, 50)]))
    f, p = kernels.periodogram(np.sin(2 * np.pi * 0.1 * np.arange(200)))
    assert f[p.argmax()] == pytest.approx(0.1)
    knots = np.array([0.0, 1, 2, 3])
    assert kernels.interpolate("lagrange", knots, knots**3, [1.5])[0] == pytest.approx(3.375)
    assert kernels.wynn(np.cumsum([(-1) ** i / (i + 1) for i in range(12)])) == pytest.approx(math.log(2), abs=1e-8)
    path = kernels.viterbi(np.array([0, 0, 1, 1]), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.9, 0.1], [0.1, 0.9]]))
    assert path.tolist() == [0, 0, 1, 1]


def test_chain_parser_and_lints():
    steps = chain.parse("normalize().kmeans(k=3, 'a b').train.linear(1, 2.5, x=[1, 2])  # note")
    assert [s.name for s in steps] == ["normalize", "kmeans", "train.linear"]
    assert steps[1].named == {"k": 3} and steps[1].args == ["a b"] and steps[2].args == [1, 2.5] and steps[2].named["x"] == [1, 2]
    assert [c for c, _ in chain.lint(chain.parse("kmeans(k=2).normalize()"))] == ["L001", "L006"]
    for bad in ("mean(", "mean()std()", "3()", "mean(a b)"):
        with pytest.raises(chain.ChainError):
            chain.parse(bad)


def test_chain_runs(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=500), r.normal(1, 2, size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    out = dict(chain.run(df, "mean().std(col=1).median().welch_t().mann_whitney().kendall().gcd(12, 18).using(method='pearson').correlation()").outputs)
    assert out["mean"] == pytest.approx(x.mean()) and out["std"] == pytest.approx(y.std(ddof=1)) and out["gcd"] == 6
    assert out["correlation"] == {"method": "pearson", "value": pytest.approx(np.corrcoef(x, y)[0, 1])}
    assert out["mann_whitney"]["statistic"] == pytest.approx(kernels.mann_whitney(x, y)["statistic"])
    with pytest.raises(chain.ChainError):
        chain.run(df, "no_such_verb()")


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 2.0)], "a double, b double")
    rows = df.select(exprs.div("a", "b").alias("q"), exprs.ln("a").alias("l"), (Expr("a") > 0).column.alias("g")).collect()
    assert rows[0].q == math.inf and rows[1].q == -math.inf and math.isnan(rows[2].q) and math.isnan(rows[1].l) and rows[2].l == -math.inf
    assert [r.g for r in rows] == [1.0, 0.0, 0.0, 0.0]
    assert df.limit(1).select(exprs.phi("v > 0 ? v < 2 ? 1.0 : 2.0 : 3.0", v="a").alias("x")).first().x == 1


def test_frame_edges(spark):
    with pytest.raises(ValueError):
        Frame.from_dict(spark, {"a": [1], "b": [1, 2]})
    f = Frame.from_dict(spark, {"k": [1, 1, 2], "v": [1.0, 2.0, 3.0]}, order="v")
    with pytest.raises(KeyError):
        f["nope"]
    with pytest.raises(NotImplementedError):
        f.join(f, "k", "left")
    assert f.filter(f["v"] - 2).df.count() == 1
    assert f.head(1).df.first().v == 1.0 and f.sort("k", False).df.first().v == 3.0
    empty = Frame(f.df.limit(0))
    assert empty.groupby("k").agg("v").df.count() == 0 and empty.describe().df.count() == 2


def test_graph_against_brute_force(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 5.0), (3, 4, 1.0)], "src long, dst long, w double")
    assert {r.node: r.d for r in graph.shortest_paths(e, 0, 5).collect()} == {0: 0.0, 1: 1.0, 2: 3.0}
    assert {r.node: r.component for r in graph.components(e, 6).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    assert sum(r["rank"] for r in graph.pagerank(e, 5).collect()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "src long, dst long, w double"), 0, 2)


def test_dbscan_and_within(spark):
    r = np.random.default_rng(4)
    p = np.concatenate([r.normal(0, 0.1, (30, 2)), r.normal(5, 0.1, (30, 2)), [[10, 10]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, a double, b double")
    want = {(i, j) for i in range(61) for j in range(i + 1, 61) if ((p[i] - p[j]) ** 2).sum() <= 0.05}
    assert {(x.i, x.j) for x in joins.within(df, "id", ["a", "b"], 0.05).collect()} == want
    labels = {x.id: x.label for x in models.dbscan(df, "id", ["a", "b"], 0.2, 3).collect()}
    assert labels[0] == 0 and labels[30] == 1 and labels[60] == -1


def plain_dbscan(x, radius2, least):
    """Labels of cores (None: no core), and each row's near rows."""
    near = sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(x.shape[1])) <= radius2
    np.fill_diagonal(near, True)
    core, label, k = near.sum(1) >= least, [None] * len(x), 0
    for i in np.flatnonzero(core):
        if label[i] is None:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] is None:
                    label[j] = k
                    stack += list(np.flatnonzero(near[j] & core))
            k += 1
    return label, near


@pytest.mark.parametrize(("least", "columns"), [(1, 2), (8, 2), (4, 4)])
def test_neighbours_of_repeated_places(spark, least, columns):
    """Rows that share places, and odd ones: pairs, clusters and the least near core of the rest, against plain loops."""
    r = np.random.default_rng(least)
    x = np.round(r.uniform(-2, 2, (260, columns)), 1)
    x[:40] = x[0]
    x[-1, 0], x[-2, -1] = np.nan, np.inf
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"c{k} double" for k in range(columns)))
    names = [f"c{k}" for k in range(columns)]
    with np.errstate(invalid="ignore"):
        label, near = plain_dbscan(x, 0.05, least)
    want = {(i, j) for i in range(260) for j in range(i + 1, 260) if near[i, j]}
    got = [(p.i, p.j) for p in joins.within(df, "id", names, 0.05).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    label = [next((label[j] for j in np.flatnonzero(near[i]) if label[j] is not None), -1) if label[i] is None else label[i] for i in range(260)]
    own = {p.id: p.label for p in models.dbscan(df, "id", names, 0.05, least).collect()}
    kept = [i for i in range(260) if np.isfinite(x[i]).all()]
    assert {i: own[i] for i in kept} == {i: label[i] for i in kept} and len(own) == 260


def test_rows_of_one_place_pass_as_arrays(spark):
    """Joins of repeated places grow by places, not rows: no plan broadcasts rows, and none joins single rows."""
    df = spark.range(50_000).select("id", (F.col("id") % 10).cast("double").alias("a"))
    labels = models.dbscan(df, "id", ["a"], 0.25, 3)
    assert {tuple(r) for r in labels.groupBy("label").count().collect()} == {(k, 5000) for k in range(10)}
    plan = joins.within(df, "id", ["a"], 0.25)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "collect_list" in plan


def test_tiles_of_neighbours():
    """A task's k nearest by tiles equal those of all distances, and take the memory of one tile (64 MB for all distances)."""
    import tracemalloc

    r, n, k = np.random.default_rng(5), 2900, 4
    x, ids = np.round(r.normal(size=(n, 3)), 1) + 50, np.arange(n)
    held, keys, bad = np.full((n, k), np.inf), np.full((n, k), n), np.zeros(n, bool)
    tracemalloc.start()
    for at in range(0, n, joins.TILE):
        joins.nearer(ids, x, held, keys, bad, ids[at : at + joins.TILE], x[at : at + joins.TILE])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = sum((x[:, None, c] - x[None, :, c]) ** 2 for c in range(3))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    assert (keys == want).all() and (held == np.take_along_axis(d, want, 1)).all() and not bad.any() and peak < 48e6


def test_pairs_of_two_columns_by_sorting(monkeypatch):
    """Medians of slopes, distance correlation and energy distance without arrays of all pairs, against those with them."""
    import tracemalloc

    from tessera.functions import samples

    r = np.random.default_rng(6)
    cases = [(r.normal(size=n), r.normal(size=n)) for n in (40, 41, 60)] + [(r.integers(0, 9, 70) * 1.0, r.integers(0, 5, 70) * 1.0)]
    want = [(kernels.theil_sen(x, y)["slope"], samples.distance_correlation(x, y)) for x, y in cases]
    monkeypatch.setattr(kernels, "DIRECT", 10)
    got = [(kernels.theil_sen(x, y)["slope"], samples.distance_correlation(x, y)) for x, y in cases]
    assert np.array(got) == pytest.approx(np.array(want), rel=1e-9, abs=1e-9)
    d = lambda a, b: np.abs(a[:, None] - b[None]).mean()
    for x, y in cases:
        assert samples.energy_distance(x, y[:-3]) == pytest.approx(2 * d(x, y[:-3]) - d(x, x) - d(y[:-3], y[:-3]))
    x, y = r.normal(size=(2, 4000))
    tracemalloc.start()
    kernels.theil_sen(x, y), samples.distance_correlation(x, y), samples.energy_distance(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6


def test_garch_asks_each_point_once(monkeypatch):
    """The search over a series equals the recurrence by hand at its end, and takes one likelihood a point tried (numpy, not scalars)."""
    asked, log = [], np.log
    r = np.random.default_rng(7).normal(size=200)
    monkeypatch.setattr(kernels.np, "log", lambda x: asked.append(len(x)) or log(x))
    found = kernels.garch(r, 5)
    monkeypatch.undo()
    h, total = float(r.var()), 0.0
    for x in r:
        total -= 0.5 * (math.log(2 * math.pi * h) + x * x / h)
        h = found["omega"] + found["alpha"] * x * x + found["beta"] * h
    assert found["loglik"] == pytest.approx(total, rel=1e-9) and 0 < len(asked) <= 1 + 5 * 8 and set(asked) == {200}


def test_ordered_statistics_take_ranges(spark, monkeypatch):
    """Statistics of a column in order need no task of all rows, and equal the kernels over the whole column."""
    from tessera.functions import dynamics, samples

    x = np.random.default_rng(8).normal(size=3000)
    x[100:120] = x[100]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(5000, None), (5001, float("nan"))], "i long, x double").repartition(7)
    monkeypatch.setattr(chain.Context, "compute_on", staticmethod(lambda *a: pytest.fail("one task of all rows")))
    text = "zero_crossing_rate().cesaro_sum().harmonic_r_stat().entropy().sign_test(median=0.1).realized_variance().realized_volatility()"
    got = [v for _, v in chain.run(df, text, ["x"], ["i"]).outputs]
    want = [dynamics.zero_crossing_rate(x), dynamics.cesaro(x), dynamics.spacing_ratio(x), samples.histogram_entropy(x), samples.sign_test(x, 0.1), (x * x).sum(), (x * x).sum() ** 0.5]
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_stream_equals_batch(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = buckets.bucketed(stream, "1 hour").writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = ["event_type", "start"]
    got = spark.table("buckets").toPandas().sort_values(key).reset_index(drop=True)
    want = buckets.bucketed(rows, "1 hour").toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    q = buckets.running_moments(stream).writeStream.format("memory").queryName("moments").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("moments").groupBy("event_type").agg(F.max_by("mean", "n").alias("m")).toPandas().set_index("event_type").m
    assert last.to_dict() == pytest.approx(rows.groupBy("event_type").agg(F.avg("value").alias("m")).toPandas().set_index("event_type").m.to_dict())


def test_matrix_verbs(spark):
    from tessera.functions import matrix

    r = np.random.default_rng(9)
    a = r.normal(size=(4, 4))
    spd = a @ a.T + np.eye(4)
    p, low, u = matrix.lu(a)
    assert np.allclose(p @ a, low @ u) and np.allclose(matrix.expm(np.zeros((3, 3))), np.eye(3))
    assert np.allclose(matrix.function_of(spd, np.sqrt) @ matrix.function_of(spd, np.sqrt), spd)
    assert np.allclose(matrix.conjugate_gradient(spd, np.ones(4)), np.linalg.solve(spd, np.ones(4)))
    assert matrix.persistence_h0(np.array([[0.0], [1], [3]])).tolist() == [1, 2]
    assert np.allclose(matrix.stationary(np.array([[0.9, 0.1], [0.5, 0.5]])), [5 / 6, 1 / 6])
    df = spark.createDataFrame(pd.DataFrame(spd, columns=list("abcd")))
    out = dict(chain.run(df, "det().log_det().cronbachs_alpha().kl_divergence()").outputs)
    assert out["det"] == pytest.approx(np.linalg.det(spd)) and out["log_det"] == pytest.approx(np.log(np.linalg.det(spd)))


def test_panel_and_discontinuity(spark):
    from tessera.plans import verbs_more

    r = np.random.default_rng(10)
    unit, x = r.integers(0, 5, 300), r.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + unit * 10.0, "u": unit}))
    assert verbs_more.panel_fixed_effects(df, "u", ["x"], "y")[0] == pytest.approx(2)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x + 3.0 * (x >= 0)}))
    assert verbs_more.rdd(df, "x", "y", 0.0) == pytest.approx(3)
    assert verbs_more.brownian(spark, 2, 10).count() == 20


def test_long_steady_runs_have_no_change_points():
    r = np.random.default_rng(3)
    steady = r.normal(0, 1, 1200)
    found = kernels.bocpd(steady)
    assert len(found) <= 2 and found == kernels.bocpd(steady, negligible=0.0)
    step = kernels.bocpd(np.concatenate([steady, r.normal(4, 1, 300)]))
    assert step[: len(found)] == found and step[len(found) :] and all(abs(k - 1200) <= 3 for k in step[len(found) :])
