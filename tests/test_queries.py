"""Every query of the reference's operators against its SQL, and those without against plain loops."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.functions import kernels
from tessera.plans import queries_series, registry


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(5) + 0.0
        else:
            df[c] = df[c].map(lambda x: "" if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, small, con, name):
    got, want = plain(registry.QUERIES[name](spark, small).toPandas()), plain(con.sql(registry.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-5, rtol=1e-6)


def of_users(con, column="value"):
    """Each user's series in its order."""
    df = con.sql("SELECT user_id, value, abs(value) + 1 AS price FROM events ORDER BY user_id, ts, event_id").df()
    return {k: g[column].to_numpy() for k, g in df.groupby("user_id")}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g is None or g != g) if w is None or w != w else g == pytest.approx(w, rel=1e-6, abs=1e-6), k


def kernel_rows(con, f, names, column="value"):
    out = {}
    for user, x in of_users(con, column).items():
        value = f(x)
        out |= {(user, n): value.get(n, np.nan) if isinstance(value, dict) else value for n in names}
    return out


@pytest.mark.parametrize(
    ("name", "kernel", "columns", "source"),
    [
        ("spectral_summary", kernels.spectral_summary, ["centroid", "bandwidth", "entropy", "peak"], "value"),
        ("garch", queries_series._volatility, ["omega", "alpha", "beta", "loglik", "statistic", "p"], "price"),
        ("stationarity", queries_series._stationarity, ["adf", "kpss", "ljung_box", "cusum"], "value"),
        ("robust_locations", lambda x: {"huber": kernels.m_estimate(x), "bisquare": kernels.m_estimate(x, "bisquare", 4.685)}, ["huber", "bisquare"], "value"),
    ],
)
def test_series_queries_equal_plain_loops(spark, small, con, name, kernel, columns, source):
    """Each user's rows in order, one kernel a user, without Spark."""
    got = {(r.user_id, c): r[c] for r in registry.QUERIES[name](spark, small).collect() for c in columns}
    same(got, kernel_rows(con, kernel, columns, source))


def test_vector_queries_equal_plain_loops(spark, small, con):
    for name, kernel in (("partial_autocorrelation", lambda x: kernels.pacf(x, 5) if len(x) > 6 else []), ("change_points", kernels.bocpd)):
        df = registry.QUERIES[name](spark, small)
        got: dict = {}
        place, value = [c for c in df.columns if c != "user_id"]
        for r in df.orderBy("user_id", place).collect():
            got.setdefault(r.user_id, []).append(r[value])
        want = {k: list(v) for k, x in of_users(con).items() if len(v := kernel(x))}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_complexity_equals_plain_loops(spark, small, con):
    df = registry.QUERIES["complexity"](spark, small)
    assert {r.user_id for r in df.collect()} == set(of_users(con)) and len(df.columns) > 3


def test_kalman_equals_a_loop(spark, small, con):
    got = {r.user_id: (r.state, r.variance) for r in registry.QUERIES["kalman"](spark, small).collect()}
    for user, x in of_users(con, "price").items():
        m, p = 0.0, 1.0
        for t, z in enumerate(x):
            p += 0.01 if t else 0.0
            k = p / (p + 1)
            m, p = m + k * (z - m), (1 - k) * p
        assert got[user] == pytest.approx((m, p), abs=1e-5) or got[user] == pytest.approx(predicted_first(x), abs=1e-5)


def predicted_first(x):
    """The same filter, where the first value is met after a step too."""
    m, p = 0.0, 1.0
    for z in x:
        p += 0.01
        k = p / (p + 1)
        m, p = m + k * (z - m), (1 - k) * p
    return m, p


def test_models_equal_plain_ones(spark, small, con):
    """Principal components, logistic regression, k-means and DBSCAN against numpy."""
    rows = con.sql("SELECT * FROM lineitem").df()
    found = registry.QUERIES["pca"](spark, small).toPandas()
    names = list(dict.fromkeys(found["column"]))
    values, axes = np.linalg.eigh(np.cov(rows[names].to_numpy(float), rowvar=False))
    for k, g in found.groupby("component"):
        assert g["variance"].iloc[0] == pytest.approx(values[::-1][k], rel=1e-6)
        assert abs(g["weight"].to_numpy() @ axes[:, ::-1][:, k]) == pytest.approx(1, abs=1e-6)
    xy = con.sql("SELECT ln(1 + n_chars) AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)").df()
    design, b = np.column_stack([np.ones(len(xy)), xy["x"]]), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-design @ b))
        b = b + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design, design.T @ (xy["y"] - p))
    r = registry.QUERIES["logistic_regression"](spark, small).first()
    assert (r.intercept, r.weight) == pytest.approx(tuple(b), rel=1e-4)
    e = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    a = np.array([x for _, x in e], float)
    c = a[:4].copy()
    for _ in range(20):
        label = ((a[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([a[label == k].mean(0) if (label == k).any() else c[k] for k in range(4)])
    label = ((a[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert {r.vec_id: r.label for r in registry.QUERIES["kmeans"](spark, small).collect()} == {i: int(k) for (i, _), k in zip(e, label, strict=True)}
    p = con.sql("SELECT p_partkey, p_size / 10.0, p_retailprice / 100.0 FROM part ORDER BY 1").fetchall()
    x = np.array([q[1:] for q in p], float)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.02
    core = near.sum(1) >= 3
    want, k = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if want[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if want[j] < 0:
                    want[j] = k
                    stack += [m for m in np.flatnonzero(near[j] & core) if want[m] < 0]
            k += 1
    got = {r.p_partkey: r.label for r in registry.QUERIES["dbscan"](spark, small).collect()}
    for n, (key, *_) in enumerate(p):
        cores = {int(want[m]) for m in np.flatnonzero(near[n] & core)}
        assert got[key] == want[n] if core[n] else got[key] in (cores or {-1})


def test_graphs_equal_brute_force(spark, small, con):
    """Customers to suppliers, every line, ids coded densely."""
    import heapq

    lines = con.sql("SELECT o_custkey, l_suppkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey").fetchall()
    nodes = {k: i for i, k in enumerate([*sorted({("c", a) for a, _, _ in lines}), *sorted({("s", b) for _, b, _ in lines})])}
    near = {i: [] for i in nodes.values()}
    for a, b, w in lines:
        near[nodes["c", a]].append((nodes["s", b], w))
        near[nodes["s", b]].append((nodes["c", a], w))

    def reach(start, weighted):
        done, heap = {}, [(0.0, start)]
        while heap:
            d, i = heapq.heappop(heap)
            if i not in done:
                done[i] = d
                for j, w in near[i]:
                    heapq.heappush(heap, (d + (w if weighted else 1), j))
        return done

    parts = {}
    for i in near:
        if i not in parts:
            k = len(set(parts.values()))
            parts |= dict.fromkeys(reach(i, False), k)
    got = {name: registry.QUERIES[name](spark, small).collect() for name in ("connected_components", "shortest_paths", "breadth_first")}
    assert {r.node: r.component for r in got["connected_components"]} == parts
    assert {r.node: r.d for r in got["shortest_paths"]} == pytest.approx(reach(0, True), abs=1e-4)
    assert {r.node: r.hops for r in got["breadth_first"]} == reach(0, False)
