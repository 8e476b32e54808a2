"""Verbs of the chain language against plain formulas, known values and brute force."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dynamics as dy
from tessera.functions import exprs
from tessera.functions import kernels as kn
from tessera.functions import multivariate as mv
from tessera.functions import samples as sm
from tessera.functions import special as sp
from tessera.functions import topology as tp
from tessera.plans import chain


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(r.normal(0, 1, 80), r.normal(0.5, 1.2, 80), r.normal(0, 1, 80).cumsum(), strict=True))]
    return spark.createDataFrame(rows, "i long, x double, y double, z double").repartition(5)


def last(df, text, columns=None, order=None):
    return chain.run(df, text, columns, order).outputs[-1][1]


def cols(df):
    rows = df.orderBy("i").collect()
    return [np.array([r[c] for r in rows]) for c in ("x", "y", "z")]


def test_ordered_verbs_follow_the_order_column(spark, frame):
    z = cols(frame)[2]
    got = last(frame, "acf(max_lag=3, col=2)", ["x", "y", "z"], ["i"])
    assert np.allclose(got, kn.acf(z, 3)) and np.allclose(last(frame, "ema(alpha=0.2, col=2)", ["x", "y", "z"], ["i"])[-1], kn.ses(z, 0.2)[-1])
    d = last(frame, "difference(d=1, col=2)", ["x", "y", "z"], ["i"])
    assert np.allclose(d, np.diff(z))


def test_two_samples(frame):
    x, y, _ = cols(frame)
    c = ["x", "y", "z"]
    assert last(frame, "rank_biserial()", c) == pytest.approx(1 - 2 * min(sum((a > b) + 0.5 * (a == b) for a in x for b in y), sum((a < b) + 0.5 * (a == b) for a in x for b in y)) / 6400)
    assert last(frame, "energy_distance()", c) == pytest.approx(2 * np.mean([abs(a - b) for a in x for b in y]) - np.mean([abs(a - b) for a in x for b in x]) - np.mean([abs(a - b) for a in y for b in y]))
    assert last(frame, "concordance_correlation()", c) == pytest.approx(2 * np.cov(x, y, ddof=0)[0, 1] / (x.var() + y.var() + (x.mean() - y.mean()) ** 2))
    two = last(frame, "ols_two_predictor()", c)
    b = np.linalg.lstsq(np.column_stack([np.ones(80), x, y]), cols(frame)[2], rcond=None)[0]
    assert [two["intercept"], two["slope_x"], two["slope_m"]] == pytest.approx(b.tolist())
    assert last(frame, "permutation_test(n_perms=400)", c)["p"] < 0.05 and last(frame, "sweep_two_sample()", c)["modal"] > 0.5


def test_corrections():
    p = np.array([0.01, 0.04, 0.03, 0.005])
    assert sm.adjusted(p, "bonferroni").tolist() == pytest.approx([0.04, 0.16, 0.12, 0.02])
    assert sm.adjusted(p, "holm").tolist() == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert sm.adjusted(p, "benjamini_hochberg").tolist() == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_known_values():
    x = np.array([2.0, 4, 4, 4, 5, 5, 7, 9])
    assert sm.l_moments(np.arange(1.0, 6))["l2"] == pytest.approx(1.0) and sm.l_moments(np.arange(1.0, 6))["l3"] == pytest.approx(0.0, abs=1e-12)
    assert sm.tetrachoric(10, 5, 5, 10) == pytest.approx(math.cos(math.pi / 3)) and sm.cramers_v(np.array([[10.0, 0], [0, 10]])) == pytest.approx(1.0)
    assert sm.sn_scale(x) == pytest.approx(1.1926 * np.median([np.median(np.abs(x - a)) for a in x]))
    assert sm.medcouple(np.array([1.0, 2, 3, 4, 100])) == 0 and sm.medcouple(np.arange(9.0)) == pytest.approx(0.0)
    assert sm.medcouple(np.exp(np.linspace(0, 3, 60))) > 0.2
    assert sm.histogram_entropy(np.arange(1000) / 1000, 10) == pytest.approx(math.log(0.999), abs=1e-3)
    # the weights of n = 3 are exact: W of 0, 1, 3 by hand
    assert sm.shapiro_wilk(np.array([0.0, 1, 3]))["statistic"] == pytest.approx((3 * math.sqrt(0.5)) ** 2 / (14 / 3))
    r = np.random.default_rng(0)
    assert sm.normality(r.normal(size=300)) > 0.05 > sm.normality(r.exponential(size=300))
    assert sm.runs_test(np.tile([0.0, 1.0], 20))["p"] < 1e-6 and sm.sign_test(np.arange(1.0, 21))["p"] < 1e-3
    line = np.arange(20.0)
    y = 2 * line + 1
    y[3] = 500
    assert sm.siegel(y)["slope"] == pytest.approx(2) and sm.lts(line, y)["slope"] == pytest.approx(2)
    assert sm.icc(np.array([1.0, 1, 5, 5, 9, 9]), np.array([0, 0, 1, 1, 2, 2])) == pytest.approx(1.0)


def test_density_against_direct_sums():
    x = np.random.default_rng(2).normal(size=500)
    grid = sm.kde(x, 400)
    h = sm.silverman(x)
    direct = np.exp(-0.5 * ((grid[:, 0, None] - x) / h) ** 2).sum(1) / (500 * h * math.sqrt(2 * math.pi))
    assert np.abs(grid[:, 1] - direct).max() < 2e-3 and np.trapezoid(grid[:, 1], grid[:, 0]) == pytest.approx(1, abs=5e-3)


def test_bootstrap_covers_the_mean():
    b = sm.bootstrap(np.random.default_rng(3).normal(5, 1, 200), 500)
    assert b["lower"] < 5.2 and b["upper"] > 4.8 and b["lower"] < b["estimate"] < b["upper"]


def test_series_kernels():
    x = np.array([1.0, 3, 2, 5, 4])
    assert dy.moving_average(x, 3).tolist() == pytest.approx([2, 2, 10 / 3, 11 / 3, 4.5]) and dy.median_filter(x, 3).tolist() == [2, 2, 3, 4, 4.5]
    assert dy.holt(np.arange(1.0, 6), 0.5, 0.5, 2).tolist() == pytest.approx([6, 7])
    assert dy.zero_crossing_rate(np.array([1.0, -1, 1, 1])) == pytest.approx(2 / 3)
    r = np.random.default_rng(4)
    assert dy.effective_size(r.normal(size=2000)) > 1000 > dy.effective_size(r.normal(size=2000).cumsum())
    assert dy.recurrence(np.tile([0.0, 1.0], 30))["determinism"] > 0.9
    assert dy.multifractal(r.normal(size=4000))["h2"] == pytest.approx(0.5, abs=0.12)
    a = np.empty(400)
    a[0] = 0.4
    for t in range(399):
        a[t + 1] = 3.8 * a[t] * (1 - a[t])
    assert dy.cross_mapping(a, a)["rho_xy"] > 0.99 and 0 < dy.spacing_ratio(r.random(3000)) < 0.42
    terms = np.array([(-1) ** k / (k + 1) for k in range(20)])
    assert dy.euler(terms) == pytest.approx(math.log(2), abs=1e-6) and dy.accelerated(terms) == pytest.approx(math.log(2), abs=1e-6)
    assert dy.accelerated(0.5 ** np.arange(20)) == pytest.approx(2.0) and dy.cesaro(np.array([1.0, -1] * 10)) == pytest.approx(0.5)
    z = r.normal(size=200).cumsum() + r.normal(size=200)
    exact = np.empty(200)
    m, p = 0.0, 1.0
    for t, v in enumerate(z):
        p += 1
        m, p = m + p / (p + 1) * (v - m), p / (p + 1)
        exact[t] = m
    assert np.abs(dy.particle_filter(z, n=4000) - exact).mean() < 0.1
    assert dy.log_likelihood(np.array([0, 1, 1]), *dy.uniform_model(2, 3)) == pytest.approx(-3 * math.log(3))
    assert dy.oscillator(1, 0, 2, math.pi / 2) == pytest.approx((-1, 0), abs=1e-12)
    path = dy.ornstein_uhlenbeck(theta=5, sigma=1, t=400, steps=40000)
    assert path.var() == pytest.approx(0.1, rel=0.15) and len(dy.poisson_events(3, 1000)) == pytest.approx(3000, rel=0.1)
    assert np.diff(dy.walk(1, 10000)).std() == pytest.approx(0.01, rel=0.05) and (dy.walk(s0=2.0, sigma=0.3) > 0).all()


def test_interpolation():
    x, y = np.arange(6.0), np.array([0.0, 1, 4, 9, 16, 25])
    assert kn.interpolate("akima", x, y, np.array([2.0, 2.5]))[0] == 4 and abs(kn.interpolate("akima", x, y, np.array([2.5]))[0] - 6.25) < 0.3
    p = kn.interpolate("pchip", x, np.array([0.0, 0, 1, 1, 2, 2]), np.linspace(0, 5, 101))
    assert (np.diff(p) >= -1e-12).all() and p[20] == 0 and p[40] == 1
    from tessera.plans.verbs_wide import interpolated

    assert [interpolated(k, x, y, 2.5) for k in ("lagrange", "newton")] == pytest.approx([6.25, 6.25]) and interpolated("rbf", x, y, 3.0) == pytest.approx(9)


def test_matrices():
    r = np.random.default_rng(5)
    f = r.normal(size=(500, 1))
    a = f @ np.array([[0.9, 0.8, 0.7, 0.6]]) + r.normal(size=(500, 4)) * np.sqrt(1 - np.array([0.81, 0.64, 0.49, 0.36]))
    fit = mv.principal_axes(mv.correlation(a), 1)
    assert fit["loadings"][:, 0] == pytest.approx([0.9, 0.8, 0.7, 0.6], abs=0.08) and mv.omega(fit["loadings"]) == pytest.approx(0.84, abs=0.04)
    turned = mv.varimax(r.normal(size=(6, 2)))
    assert turned.shape == (6, 2)
    g = np.repeat([0, 1], 250)
    b = a + g[:, None] * np.array([1.0, 0, 0, 0])
    t, m = mv.hotelling_two(b[g == 0], b[g == 1]), mv.manova(b, g)
    assert t["f"] == pytest.approx(m["f"]) and t["p"] == pytest.approx(m["p"], abs=1e-9)
    axis = mv.discriminants(b, g)[:, 0]
    want = np.linalg.solve(mv.scatter(b, g)[0], b[g == 1].mean(0) - b[g == 0].mean(0))
    assert abs(axis @ want / np.linalg.norm(want)) == pytest.approx(1, abs=1e-6)
    assert mv.canonical_correlations(a[:, :1], a[:, 1:2])[0] == pytest.approx(abs(np.corrcoef(a[:, 0], a[:, 1])[0, 1]))
    assert mv.mardia(r.normal(size=(300, 2)))["kurtosis"] == pytest.approx(8, abs=1.2)
    s = r.normal(size=(6, 6)) + 6 * np.eye(6)
    assert mv.gmres(s, np.ones(6)) == pytest.approx(np.linalg.solve(s, np.ones(6)))
    w, h = mv.nmf(np.outer([1.0, 2, 3], [4.0, 5]), 1)
    assert w @ h == pytest.approx(np.outer([1.0, 2, 3], [4.0, 5]), rel=1e-3)
    blobs = np.concatenate([r.normal(0, 0.2, (30, 2)), r.normal(3, 0.2, (30, 2))])
    for labels in (mv.k_means(blobs, 2), mv.spectral_clusters(blobs, 2)):
        assert len(set(labels[:30])) == len(set(labels[30:])) == 1 and labels[0] != labels[-1]
    assert mv.cluster_auto(blobs)["k"] == 2 and mv.cluster_auto(blobs)["hopkins"] > 0.6
    d = mv.squared_distances(mv.tsne(blobs, 10, 400, 50.0))
    np.fill_diagonal(d, np.inf)
    assert ((d.argmin(1) < 30) == (np.arange(60) < 30)).mean() > 0.95


def test_survival_and_item_responses():
    r = np.random.default_rng(6)
    x = r.normal(size=(800, 2))
    time = r.exponential(1 / np.exp(x @ [0.8, -0.5]))
    event = r.random(800) < 0.8
    beta = mv.cox(x, time, event)
    assert beta == pytest.approx([0.8, -0.5], abs=0.15)

    def score(b):  # of the partial likelihood, by its definition
        return sum(x[i] - (w := np.exp(x[time >= time[i]] @ b)) @ x[time >= time[i]] / w.sum() for i in np.flatnonzero(event))

    assert np.abs(score(beta)).max() < 1e-6
    theta, a, b = r.normal(size=1500), np.array([1.0, 1.5, 0.7, 2.0]), np.array([-1.0, 0.0, 0.5, 1.0])
    u = (r.random((1500, 4)) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))).astype(float)
    assert mv.fit_2pl(u, 60)[:, 1] == pytest.approx(b, abs=0.35)
    assert mv.ability_ml(np.array([1.0, 0]), np.ones(2), np.zeros(2)) == pytest.approx(0, abs=1e-9) and mv.ability_mean(np.ones(4), a, b) > 0.5


def brute_matching(a, b, total):
    c = tp._costs(a, b)
    return min((sum if total else max)(c[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(len(c)))) if len(c) else 0.0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(0, 3), st.integers(0, 3))
def test_diagram_distances(seed, n, m):
    r = np.random.default_rng(seed)
    a, b = (np.sort(r.random((k, 2)), 1) for k in (n, m))
    assert tp.bottleneck(a, b) == pytest.approx(brute_matching(a, b, False)) and tp.wasserstein(a, b) == pytest.approx(brute_matching(a, b, True))


def test_loops():
    t = np.linspace(0, 2 * math.pi, 12, endpoint=False)
    circle = np.stack([np.cos(t), np.sin(t)], 1)
    pairs = tp.finite(tp.loops(circle))
    assert len(pairs) == 1 and pairs[0, 0] == pytest.approx(2 * math.sin(math.pi / 12)) and pairs[0, 1] > 1.5
    assert tp.entropy(pairs) == pytest.approx(0) and tp.betti(pairs, np.array([0.1, 1.0, 3.0])).tolist() == [0, 1, 0]
    square = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]])
    assert tp.loops(square).tolist() == [[1.0, pytest.approx(math.sqrt(2))]]


def test_graph_verbs(spark):
    edges = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (4, 5, 1.0)], "s long, d long, w double")
    assert last(edges, "dijkstra(n_nodes=6)").tolist() == [0, 3, 1, 8, math.inf, math.inf] and last(edges, "bellman_ford(n_nodes=6)").tolist()[:4] == [0, 3, 1, 8]
    assert last(edges, "floyd_warshall(n_nodes=6)")[2].tolist() == [math.inf, 2, 0, 7, math.inf, math.inf]
    assert last(edges, "bfs(n_nodes=6)").tolist() == [0, 1, 1, 2, math.inf, math.inf] and last(edges, "dfs(n_nodes=6)") == [0, 1, 3, 2]
    assert last(edges, "kruskal(n_nodes=6)") == 9 and last(edges, "connected_components(n_nodes=6)") == 2
    assert sum(last(edges, "pagerank(n_nodes=6)")) == pytest.approx(1) and last(edges, "degree_centrality(n_nodes=6)").tolist()[:2] == pytest.approx([0.4, 0.2])
    negative = spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "s long, d long, w double")
    with pytest.raises(ValueError, match="negative"):
        last(negative, "bellman_ford(n_nodes=2)")


def test_clusters_label_rows(spark):
    r = np.random.default_rng(7)
    rows = [(float(a), float(b)) for k in (0, 4) for a, b in r.normal(k, 0.3, (40, 2))]
    df = spark.createDataFrame(rows, "x double, y double")
    for verb in ("kmeans(k=2)", "dbscan(epsilon=1.0, min_samples=3)"):
        out = chain.run(df, verb).df.collect()
        assert len({r.label for r in out if r.x < 2}) == len({r.label for r in out if r.x >= 2}) == 1 and len({r.label for r in out}) == 2
    assert last(df, "kmeans(k=2).icc()") > 0.9 and last(df, "kmeans(k=2).mutual_info()") > 0.5 and last(df, "kmeans(k=2).manova()")["p"] < 1e-9
    near = last(df, "knn(k=3)")["neighbours"]
    assert near.count() == 240
    with pytest.raises(chain.ChainError, match="label"):
        last(df, "icc()")


def test_spatial_verbs(spark):
    r = np.random.default_rng(8)
    p = r.random((60, 2))
    smooth = p[:, 0] + p[:, 1]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(p, smooth, strict=True)], "x double, y double, v double")
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    w = np.zeros((60, 60))
    np.put_along_axis(w, np.argsort(d, 1)[:, :4], 1.0, 1)
    z = smooth - smooth.mean()
    assert last(df, "morans_i()") == pytest.approx(60 / w.sum() * (w * np.outer(z, z)).sum() / (z @ z))
    assert last(df, "gearys_c()") == pytest.approx(59 * (w * (z[:, None] - z[None]) ** 2).sum() / (2 * w.sum() * (z @ z)))


def test_kaplan_meier_verb(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (3.0, 1.0), (4.0, 1.0)], "t double, e double")
    assert last(df, "kaplan_meier()") == 3.0
    assert last(df, "survival_analyze()").tolist() == [[1.0, 0.75], [3.0, 0.375], [4.0, 0.0]]


def test_selection_follows_the_columns(spark, frame):
    b = frame.select((F.col("x") > 0).cast("double").alias("a"), (F.col("y") > 0).cast("double").alias("b"), "z", F.exp("x").alias("e"))
    assert last(b, "correlation()")["method"] == "phi" and last(b, "correlation(col_x=0, col_y=2)")["method"] == "point_biserial"
    assert last(frame, "correlation()", ["x", "y"])["method"] == "pearson" and last(b, "correlation(col_x=3, col_y=2)")["method"] == "spearman"
    forced = last(frame, "using(method=kendall).correlation()", ["x", "y"])
    assert forced["method"] == "kendall"
    q = np.array([sp.norm_ppf((i + 0.5) / 60) for i in range(60)])
    groups = lambda f: spark.createDataFrame([(float(v), float(g)) for g in range(3) for v in f(g)], "v double, g double")
    assert last(groups(lambda g: g + q), "anova()")["method"] == "anova"
    assert last(groups(lambda g: g + (1 + 4 * g) * q), "anova()")["method"] == "welch_anova"
    assert last(groups(lambda g: np.exp(q + g)), "anova()")["method"] == "kruskal_wallis"


def test_phi_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 2.0)], "v double, g double")
    rows = df.select(exprs.phi("v/g").alias("d"), exprs.phi("log(v)").alias("l"), exprs.phi("v > 0 ? 1 : -2*v").alias("t"), exprs.phi("v != v").alias("n"), exprs.phi("-(v + 1) * 2 - pow(2, 3) % 3").alias("p")).collect()
    assert rows[0].d == math.inf and rows[1].d == -math.inf and math.isnan(rows[2].d) and math.isnan(rows[1].l) and rows[2].l == -math.inf
    assert [r.t for r in rows[:3]] == [1, 2, 0] and [r.n for r in rows] == [False, False, False, True] and rows[0].p == -6
    for bad in ("v +", "(v", "v v", "v ? 1", "1 $ 2"):
        with pytest.raises(ValueError, match="formula"):
            exprs.phi(bad)


def test_every_verb_is_registered():
    """Names of the script verbs that the language has (fixed values)."""
    names = """normalize describe mean std variance skewness kurtosis cv mode sem percentileofscore lmoment median quantile quartiles iqr mad gini
    geometric_mean harmonic_mean trimmed_mean winsorized_mean correlation_matrix correlation t_test t_test_2 welch_t paired_t chi2 proportion_z anova cohens_d
    hedges_g bonferroni holm benjamini_hochberg spearman kendall pearson_r biserial_correlation rank_biserial distance_correlation concordance_correlation
    cramers_v tetrachoric ols_simple ols_two_predictor mann_whitney ranksums skewtest kurtosistest theilslopes siegelslopes wilcoxon ks_test ks_test_2
    sign_test runs_test bootstrap permutation_test kde cluster_auto dbscan sweep_kmeans sweep_two_sample sweep_ar sweep_moving_average discover_correlation
    discover_regression discover_changepoint discover_stationarity kmeans kmeans_f64 knn train.linear regression train.logistic train.naive_bayes
    gaussian_nb_predict pca tsne mds nmf paf cronbachs_alpha mcdonalds_omega scree_elbow acf pacf ar difference ses holt adf_test time_series fft periodogram
    welch_psd moving_average ema savgol median_filter envelope haar_dwt autocorrelation zero_crossing_rate bayesian.linear ess kaplan_meier cox huber
    bisquare qn_scale sn_scale medcouple lts entropy kl_divergence js_divergence cross_entropy mutual_info hellinger total_variation
    chi_squared_divergence renyi_divergence bhattacharyya wasserstein_1d mmd_rbf energy_distance joint_entropy pmi sample_entropy permutation_entropy hurst dfa
    higuchi_fd lempel_ziv rqa mfdfa ccm phase_transition harmonic_r_stat hankel_r_stat morans_i gearys_c panel.fe rdd icc garch ewma_var realized_variance
    realized_volatility volatility_analyze survival_analyze bayesian_analyze irt_2pl ability_mle ability_eap dijkstra bellman_ford floyd_warshall pagerank
    kruskal connected_components bfs dfs degree_centrality lagrange newton_interp cubic_spline akima pchip rbf polyfit lerp lu qr svd det cond pinv
    solve_linear sym_eigen matrix_exp matrix_log matrix_sqrt log_det effective_rank conjugate_gradient gmres hotelling_t2 hotelling_two_sample manova lda cca
    mardia_normality efa varimax brownian_motion geometric_brownian_motion ornstein_uhlenbeck poisson_process markov_chain black_scholes euler_transform
    wynn_epsilon aitken series_accelerate cesaro_sum is_prime gcd lcm euler_totient factorize rips_h0 persistence_entropy rips_h1 betti_curve
    persistence_statistics bottleneck_distance wasserstein_distance kmo_bartlett spectral_cluster spectral_embedding black_body carnot_efficiency
    ideal_gas_pressure sho haversine kalman_scalar rts_scalar particle_filter hmm_forward_backward hmm_viterbi""".split()
    known = {*chain.VERBS, *chain._SERIES, *chain._TWO, *chain._SCALAR}
    assert [n for n in names if n not in known] == []
