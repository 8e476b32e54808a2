"""More verbs of the chain language: divergences, matrices, factor measures, generators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import matrix
from tessera.operators import divergences, models
from tessera.plans.chain import VERBS, Context, Step

def _divergence(f):
    def run(c: Context, s: Step) -> float:
        return c.one(f(c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)))[0]

    return run


for _names, _f in {
    ("kl_divergence",): divergences.kl, ("js_divergence",): divergences.js, ("cross_entropy",): divergences.cross_entropy,
    ("hellinger", "hellinger_distance"): divergences.hellinger, ("total_variation", "tv_distance"): divergences.total_variation,
    ("chi_squared_divergence", "chi2_divergence", "chi_sq_divergence"): divergences.chi_squared, ("bhattacharyya", "bhattacharyya_distance"): divergences.bhattacharyya,
}.items():
    for _n in _names:
        VERBS[_n] = _divergence(_f)
VERBS["renyi_divergence"] = lambda c, s: c.one(divergences.renyi(c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1), float(s.get("alpha", 2, 1.0))))[0]


for _name, _g in {
    "det": lambda a: float(np.linalg.det(a)), "cond": lambda a: float(np.linalg.cond(a)), "pinv": np.linalg.pinv, "svd": lambda a: np.linalg.svd(a, compute_uv=False),
    "qr": lambda a: np.linalg.qr(a)[1], "lu": lambda a: matrix.lu(a)[2], "sym_eigen": lambda a: np.linalg.eigvalsh(a)[::-1], "matrix_exp": matrix.expm,
    "matrix_log": lambda a: matrix.function_of(a, np.log), "matrix_sqrt": lambda a: matrix.function_of(a, np.sqrt), "log_det": lambda a: float(np.linalg.slogdet(a)[1]),
    "effective_rank": matrix.effective_rank, "markov_chain": matrix.stationary, "rips_h0": matrix.persistence_h0,
    "mds": lambda a: matrix.classical_mds(((a[:, None] - a[None]) ** 2).sum(2)),
}.items():
    VERBS[_name] = lambda c, s, g=_g: c.compute(c.columns, lambda *cols: g(np.column_stack(cols)), paired=True)
for _alias, _of in {"lu_decomp": "lu", "qr_decomp": "qr", "eigendecomp": "sym_eigen", "effective_rank_from_sv": "effective_rank", "stationary_distribution": "markov_chain", "persistent_homology_h0": "rips_h0"}.items():
    VERBS[_alias] = VERBS[_of]
VERBS["solve_linear"] = lambda c, s: c.compute(c.columns, lambda *cols: np.linalg.solve(np.column_stack(cols[:-1]), cols[-1]), paired=True)
VERBS["conjugate_gradient"] = VERBS["cg"] = lambda c, s: c.compute(c.columns, lambda *cols: matrix.conjugate_gradient(np.column_stack(cols[:-1]), cols[-1], float(s.get("tol", 0, 1e-10)), int(s.get("max_iter", 1, 1000))), paired=True)
VERBS["cronbachs_alpha"] = VERBS["cronbach_alpha"] = lambda c, s: matrix.cronbach(models.covariance(c.df, c.columns))
VERBS["kmo_bartlett"] = VERBS["kmo"] = lambda c, s: matrix.kmo(models.correlation(c.df, c.columns))
VERBS["scree_elbow"] = lambda c, s: int(np.diff(np.linalg.eigvalsh(models.correlation(c.df, c.columns))[::-1]).argmin()) + 1


def _hotelling(c: Context, s: Step) -> dict:
    n, sums, _ = models.products(c.df, c.columns)
    return matrix.hotelling(sums / n, models.covariance(c.df, c.columns), n)


VERBS["hotelling_t2"] = VERBS["hotelling_one_sample"] = _hotelling


def panel_fixed_effects(df: DataFrame, unit: str, features: list[str], target: str) -> np.ndarray:
    """Slopes after each unit's means are taken off; means are joined back, so a unit may have any size."""
    cols = [*features, target]
    means = df.groupBy(unit).agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in cols])
    within = df.join(means, unit).select(*[(F.col(c).cast("double") - F.col(f"_m_{c}")).alias(c) for c in cols])
    _, _, p = models.products(within, cols)
    return np.linalg.solve(p[:-1, :-1], p[:-1, -1])


VERBS["panel.fe"] = VERBS["panel_fe"] = lambda c, s: panel_fixed_effects(c.df, c.col(s, "unit_col", 0, len(c.columns) - 1), c.columns[:-2], c.columns[-2])


def rdd(df: DataFrame, x: str, y: str, cutoff: float, width: float = 1.0) -> float:
    """The jump at the cutoff between two local lines."""
    near = df.filter(F.abs(F.col(x) - cutoff) <= width).withColumn("_x", F.col(x) - cutoff)
    right = F.col("_x") >= 0
    a, b = near.agg(F.regr_intercept(F.when(right, F.col(y)), F.when(right, F.col("_x"))), F.regr_intercept(F.when(~right, F.col(y)), F.when(~right, F.col("_x")))).first()
    return a - b


VERBS["rdd"] = VERBS["rdd_sharp"] = lambda c, s: rdd(c.df, c.col(s, "col_x", None, 0), c.col(s, "col_y", None, 1), float(s.get("cutoff", 0, required=True)), float(s.get("bw", 1, 1.0)))


def brownian(spark: SparkSession, paths: int, steps: int, t_end: float = 1.0, seed: int = 42, drift: float = 0.0, sigma: float = 1.0, s0: float | None = None) -> DataFrame:
    """path, step and value; geometric with s0. Each path is a window of its own."""
    dt = t_end / steps
    grid = spark.range(paths * steps).select((F.col("id") / steps).cast("long").alias("path"), (F.col("id") % steps + 1).alias("step"), F.randn(seed).alias("z"))
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    mu = drift - sigma * sigma / 2 if s0 is not None else drift
    walk = F.sum(mu * dt + sigma * dt**0.5 * F.col("z")).over(w)
    return grid.select("path", "step", (s0 * F.exp(walk) if s0 is not None else walk).alias("value"))
