"""The chain language: ``verb(arg, name=value).verb(...)`` over the columns of a frame.

A chain is parsed to steps, checked by lints, and run: transforms give a new frame for the steps after them, others give
results (step, name, i, j, value). ``using(...)`` holds for the next other step only. Columns are picked by number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels, samples
from tessera.functions import special as sp
from tessera.operators import aggregates as agg
from tessera.operators import hypothesis, models


class ChainError(ValueError):
    pass


@dataclass
class Step:
    name: str
    args: list[Any] = field(default_factory=list)
    named: dict[str, Any] = field(default_factory=dict)

    def get(self, name: str, place: int | None = None, default: Any = None, required: bool = False) -> Any:
        if name in self.named:
            return self.named[name]
        if place is not None and place < len(self.args):
            return self.args[place]
        if required:
            raise ChainError(f"{self.name} needs {name}")
        return default


_LEX = re.compile(r"""\s*(?:(?P<number>-?(?:\d+\.\d*(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\.\d+|\d+))|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<mark>[().,=\[\]]))""")


def _tokens(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"#[^\n]*", "", text)
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ChainError(f"unexpected {text[at : at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> list[Step]:
    """Steps of a chain; dotted names such as ``train.linear(...)`` are one verb."""
    tokens, at, steps = _tokens(text), 0, []

    def peek(k: int = 0) -> tuple[str, str]:
        return tokens[at + k] if at + k < len(tokens) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        kind, got = peek()
        if value is not None and got != value or kind == "end":
            raise ChainError(f"expected {value or 'more'}, found {got or 'the end'}")
        at += 1
        return kind, got

    def value() -> Any:
        kind, got = take()
        if kind == "number":
            return float(got) if re.search(r"[.eE]", got) else int(got)
        if kind == "text":
            return re.sub(r"\\(.)", r"\1", got[1:-1])
        if kind == "name":
            return {"true": True, "false": False}.get(got, got)
        if got == "[":
            items = []
            while peek()[1] != "]":
                items.append(value())
                if peek()[1] == ",":
                    take(",")
            take("]")
            return items
        raise ChainError(f"unexpected {got!r}")

    while peek()[0] != "end":
        kind, name = take()
        if kind != "name":
            raise ChainError(f"a verb was expected, not {name!r}")
        while peek()[1] == "." and peek(1)[0] == "name" and peek(2)[1] in ("(", "."):
            take(".")
            name += "." + take()[1]
        step = Step(name)
        take("(")
        while peek()[1] != ")":
            if peek()[0] == "name" and peek(1)[1] == "=":
                key = take()[1]
                take("=")
                step.named[key] = value()
            else:
                step.args.append(value())
            if peek()[1] == ",":
                take(",")
            elif peek()[1] != ")":
                raise ChainError(f"expected , or ), found {peek()[1] or 'the end'}")
        take(")")
        steps.append(step)
        if peek()[0] != "end":
            take(".")
    return steps


#: Verbs by role, for lints.
DISTANCE = {"dbscan", "discover_clusters", "kmeans", "kmeans_f64", "knn", "cluster_auto"}
SUPERVISED = {"train.linear", "train.logistic", "regression"}
EXPLORE = {"describe", "correlation", "correlation_matrix", "mean", "std", "median", "quartiles"}
NORMAL_TESTS = {"test.t", "t_test", "test.t2", "t_test_2", "test.anova", "anova", "test.welch", "welch_t"}
CHECKS = {"skewness", "kurtosis", "skewtest", "kurtosistest", "ks_test", "describe"}


def lint(steps: list[Step]) -> list[tuple[str, str]]:
    out, names = [], [s.name for s in steps]
    for i, s in enumerate(steps):
        before = set(names[:i])
        if s.name in DISTANCE and "normalize" not in before:
            out.append(("L001", f"{s.name} measures distances on columns that are not normalized"))
        if s.name in SUPERVISED and not before & EXPLORE:
            out.append(("L002", f"{s.name} before any exploration"))
        if s.name.endswith("predict") and not before & {"cross_validate", "holdout"}:
            out.append(("L003", f"{s.name} without validation"))
        if s.name in NORMAL_TESTS and not before & CHECKS:
            out.append(("L004", f"{s.name} assumes a distribution that nothing checked"))
        if i and s == steps[i - 1]:
            out.append(("L005", f"{s.name} is repeated"))
        if s.name == "normalize" and before & (DISTANCE | SUPERVISED):
            out.append(("L006", "normalize after a step that should have used it"))
    return out


@dataclass
class Context:
    df: DataFrame
    columns: list[str]
    using: dict[str, Any] = field(default_factory=dict)
    #: Columns that order the rows; without them, the frame's own order holds.
    order: list[str] = field(default_factory=list)
    #: The column of labels that a clustering verb has made.
    label: str | None = None
    #: What spatial verbs have found: what was asked, of which frame, and its values and pairs.
    near: list = field(default_factory=list)

    def col(self, step: Step, name: str = "col", place: int | None = 0, default: int = 0) -> str:
        k = int(step.get(name, place, default))
        if not 0 <= k < len(self.columns):
            raise ChainError(f"{step.name}: no column {k}")
        return self.columns[k]

    def one(self, *exprs) -> tuple:
        return tuple(self.df.agg(*[e.alias(f"v{i}") for i, e in enumerate(exprs)]).first())

    def compute(self, names: list[str], f: Callable, paired: bool = False) -> Any:
        """What a kernel makes of whole columns, in a task of the executors; only the result comes back.

        Rows are in the chain's order. NaN and NULL are left out of each column, or where paired, with their rows.
        """
        order = [F.col(c) for c in self.order] or [F.monotonically_increasing_id()]
        keys = [f"_order{i}" for i in range(len(order))]
        df = self.df.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(names)], *[o.alias(k) for o, k in zip(order, keys, strict=True)])
        return self.compute_on(df, [f"_c{i}" for i in range(len(names))], f, keys, paired)

    @staticmethod
    def compute_on(df: DataFrame, names: list[str], f: Callable, order: list[str], paired: bool = True) -> Any:
        import pickle

        def run(parts):
            held = [[] for _ in names]
            for part in parts:
                for h, n in zip(held, names, strict=True):
                    h.append(part[n].to_numpy(dtype=float, na_value=math.nan))
            cols = [np.concatenate([np.empty(0), *h]) for h in held]
            live = [~np.isnan(c) for c in cols]
            if paired:
                live = [np.logical_and.reduce(live)] * len(cols)
            import pandas as pd

            try:
                out = True, f(*[c[m] for c, m in zip(cols, live, strict=True)])
            except (ValueError, np.linalg.LinAlgError) as e:
                out = False, str(e)
            yield pd.DataFrame({"out": [pickle.dumps(out)]})

        rows = df.select(*dict.fromkeys([*names, *order])).repartition(1).sortWithinPartitions(*order).mapInPandas(run, "out binary").collect()
        done, value = pickle.loads(rows[0].out) if rows else (False, "no rows")
        if not done:
            raise ChainError(value)
        return value


    def folded(self, x: str, f: Callable[[np.ndarray], Any], by_value: bool = False) -> list:
        """What f makes of each batch of a column without NaN and NULL, in the chain's order or that of the values.

        Rows are sorted by ranges, one a task; f gives a few numbers, which are put together in order.
        """
        import pickle

        import pyarrow as pa
        from pyspark import TaskContext

        def run(batches):
            part = TaskContext.get().partitionId()
            for i, b in enumerate(batches):
                if b.num_rows:
                    out = pickle.dumps(f(b.column(0).to_numpy(zero_copy_only=False)))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i]), pa.array([out])], names=["part", "i", "out"])

        v = F.col(x).cast("double")
        order = [F.col("_x")] if by_value else [F.col(f"_o{k}") for k in range(max(len(self.order), 1))]
        keys = [] if by_value else [o.alias(f"_o{k}") for k, o in enumerate([F.col(c) for c in self.order] or [F.monotonically_increasing_id()])]
        rows = self.df.select(v.alias("_x"), *keys).filter("_x IS NOT NULL AND NOT isnan(_x)").orderBy(*order)
        found = rows.select("_x", *[k for k in rows.columns if k != "_x"]).mapInArrow(run, "part int, i long, out binary").collect()
        return [pickle.loads(r.out) for r in sorted(found, key=lambda r: (r.part, r.i))]


VERBS: dict[str, Callable[[Context, Step], Any]] = {}


def verb(*names: str):
    def add(f):
        for n in names:
            VERBS[n] = f
        return f

    return add


def _moment(name: str):
    def f(c: Context, s: Step) -> float:
        return c.one(agg.moments(c.col(s))[name])[0]

    return f


for _verb, _stat in {"mean": "mean", "std": "std", "variance": "variance", "skewness": "skewness", "kurtosis": "kurtosis", "sem": "sem", "standard_error_of_mean": "sem", "coefficient_of_variation": "cv", "cv": "cv"}.items():
    VERBS[_verb] = _moment(_stat)


@verb("normalize")
def _normalize(c: Context, s: Step) -> DataFrame:
    return models.normalized(c.df, c.columns)


@verb("describe")
def _describe(c: Context, s: Step) -> dict:
    keep = ("n", "mean", "variance", "skewness", "kurtosis", "min", "max")
    row = c.df.agg(*[agg.moments(x)[k].alias(f"{x}.{k}") for x in c.columns for k in keep]).first()
    return row.asDict()


@verb("median")
def _median(c: Context, s: Step) -> float:
    return c.one(F.median(c.col(s)))[0]


@verb("quantile")
def _quantile(c: Context, s: Step) -> float:
    return agg.quantile_of_type(c.df, c.col(s), float(s.get("q", 1, required=True)), int(c.using.get("method", 7))).first()[0]


@verb("quartiles")
def _quartiles(c: Context, s: Step) -> list:
    return list(c.one(F.percentile(c.col(s), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])))[0])


@verb("iqr")
def _iqr(c: Context, s: Step) -> float:
    q = _quartiles(c, s)
    return q[2] - q[0]


@verb("mad")
def _mad(c: Context, s: Step) -> float:
    return agg.mad(c.df.withColumn("_one", F.lit(0)), c.col(s), "_one").first()["mad"]


@verb("mode")
def _mode(c: Context, s: Step) -> float:
    x = c.col(s)
    return c.df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(x).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), x))[x]).first()[0]


@verb("geometric_mean")
def _geometric(c: Context, s: Step) -> float:
    return c.one(agg.means(c.col(s))["geometric"])[0]


@verb("harmonic_mean")
def _harmonic(c: Context, s: Step) -> float:
    return c.one(agg.means(c.col(s))["harmonic"])[0]


def _ordered(name: str):
    def f(c: Context, s: Step) -> float:
        return agg.ordered_stats(c.df.withColumn("_one", F.lit(0)), c.col(s, place=None), "_one", float(s.get("fraction", 0, 0.1)) if name != "gini" else 0.1).first()[name]

    return f


for _name in ("gini", "trimmed_mean", "winsorized_mean"):
    VERBS[_name] = _ordered(_name)


@verb("percentileofscore", "percentile_of_score")
def _score(c: Context, s: Step) -> float:
    return c.one(100.0 * F.count_if(F.col(c.col(s)) <= float(s.get("score", 1, required=True))) / F.count("*"))[0]


@verb("pearson_r")
def _pearson(c: Context, s: Step) -> float:
    return c.one(F.corr(c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)))[0]


@verb("spearman")
def _spearman(c: Context, s: Step) -> float:
    return hypothesis.spearman(c.df, c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)).first()[0]


@verb("correlation_matrix")
def _matrix(c: Context, s: Step) -> np.ndarray:
    return models.correlation(c.df, c.columns)


def looks_normal(c: Context, x: str) -> bool:
    """Shapiro and Wilk's test below the threshold of rows, D'Agostino's from it on (by moments, over all rows)."""
    alpha, threshold = float(c.using.get("normality_alpha", 0.05)), int(c.using.get("normality_test_n_threshold", 5000))
    n, g1, g2 = c.one(F.count(x), F.skewness(x), F.kurtosis(x))
    if n < threshold:
        return c.compute([x], lambda v: samples.normality(v, threshold)) > alpha
    if g1 is None or g2 is None:
        return False
    z1, z2 = kernels.skewness_z(n, g1), kernels.kurtosis_z(n, g2)
    return 1 - sp.chi2_cdf(z1 * z1 + z2 * z2, 2) > alpha


def is_binary(c: Context, x: str) -> bool:
    return c.df.select(x).dropna().distinct().limit(3).count() <= 2


@verb("correlation")
def _correlation(c: Context, s: Step) -> dict:
    """phi, point-biserial, Pearson or Spearman, as the columns call for; ``using(method=...)`` overrides."""
    x, y = c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)
    bx, by = is_binary(c, x), is_binary(c, y)
    auto = "phi" if bx and by else "point_biserial" if bx or by else "pearson" if looks_normal(c, x) and looks_normal(c, y) else "spearman"
    method = {"phi_coefficient": "phi", "kendall_tau": "kendall"}.get(str(c.using.get("method", auto)), str(c.using.get("method", auto)))
    cut = lambda v: F.when(F.col(v) > 0.5, 1.0).when(F.col(v).isNotNull(), 0.0)
    if method == "spearman":
        value = hypothesis.spearman(c.df, x, y).first()[0]
    elif method == "kendall":
        value = c.compute([x, y], kernels.kendall, paired=True)
    elif method == "phi":
        value = c.one(F.corr(cut(x), cut(y)))[0]
    elif method == "point_biserial":
        value = c.one(F.corr(cut(x), F.col(y)) if bx or not by else F.corr(cut(y), F.col(x)))[0]
    else:
        method, value = "pearson", c.one(F.corr(x, y))[0]
    return {"method": method, "value": value}


@verb("test.t", "t_test")
def _t(c: Context, s: Step) -> dict:
    return hypothesis.t_test(c.df, c.col(s, place=None), float(s.get("mu", 0, 0.0)))


def _pair(c: Context, s: Step) -> DataFrame:
    x, y = c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)
    return c.df.select(F.explode(F.array(F.struct(F.col(x).cast("double").alias("x"), F.lit(True).alias("g")), F.struct(F.col(y).cast("double").alias("x"), F.lit(False).alias("g")))).alias("r")).select("r.x", "r.g").dropna()


@verb("test.welch", "welch_t")
def _welch(c: Context, s: Step) -> dict:
    t, df = _pair(c, s).agg(hypothesis.welch_t("x", F.col("g")), hypothesis.welch_df("x", F.col("g"))).first()
    return {"statistic": t, "df": df, "p": sp.t_two_sided(t, df)}


@verb("test.paired_t", "paired_t")
def _paired(c: Context, s: Step) -> dict:
    x, y = c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)
    t, n = c.one(hypothesis.paired_t(x, y), F.count(F.col(x) - F.col(y)))
    return {"statistic": t, "df": n - 1, "p": sp.t_two_sided(t, n - 1)}


@verb("mann_whitney", "mann_whitney_u")
def _mw(c: Context, s: Step) -> dict:
    u, z = hypothesis.mann_whitney(_pair(c, s), "x", F.col("g")).first()
    return {"statistic": u, "p": float(2 * sp.norm_cdf(-abs(z)))}


@verb("test.t2", "t_test_2")
def _t2(c: Context, s: Step) -> dict:
    """Pooled t, Welch's t or Mann-Whitney, by normality and equality of variances."""
    x, y = c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)
    if not (looks_normal(c, x) and looks_normal(c, y)):
        return {"method": "mann_whitney"} | _mw(c, s)
    n, m, v, w = c.one(F.count(x), F.count(y), F.var_samp(x), F.var_samp(y))
    p = sp.f_cdf(max(v, w) / max(min(v, w), 1e-300), n - 1, m - 1)
    if p > 0.975:
        return {"method": "welch"} | _welch(c, s)
    t = _pair(c, s).agg(hypothesis.pooled_t("x", F.col("g"))).first()[0]
    return {"method": "pooled", "statistic": t, "df": n + m - 2, "p": sp.t_two_sided(t, n + m - 2)}


@verb("cohens_d")
def _d(c: Context, s: Step) -> float:
    return _pair(c, s).agg(hypothesis.cohens_d("x", F.col("g"))).first()[0]


@verb("hedges_g")
def _g(c: Context, s: Step) -> float:
    n = _pair(c, s).count()
    return _d(c, s) * (1 - 3 / (4 * (n - 2) - 1))


@verb("test.anova", "anova")
def _anova(c: Context, s: Step) -> dict:
    """One-way ANOVA; Welch's where Levene's test finds unequal spreads, Kruskal and Wallis's where a group is not normal."""
    x, g = c.col(s, "col_val", 0, 0), c.col(s, "col_group", 1, min(1, len(c.columns) - 1))
    df = c.df.select(F.col(x).cast("double").alias("x"), F.col(g).cast("long").alias("g")).dropna()
    groups = df.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.median("x").alias("med")).orderBy("g").collect()
    if len(groups) < 2:
        return {"method": "anova", "statistic": math.nan, "p": math.nan}
    alpha = float(c.using.get("normality_alpha", 0.05))
    normal = all(looks_normal(Context(df.filter(F.col("g") == r.g), ["x"], c.using), "x") for r in groups)
    spread = df.join(df.groupBy("g").agg(F.median("x").alias("med")), "g").select(F.abs(F.col("x") - F.col("med")).alias("x"), "g")
    f, a, b, _ = hypothesis.anova(spread, "x", "g").first()
    equal = f is None or 1 - sp.f_cdf(f, a, b) > alpha
    auto = "kruskal_wallis" if not normal else "anova" if equal else "welch_anova"
    method = {"kruskal": "kruskal_wallis", "welch": "welch_anova"}.get(str(c.using.get("method", auto)), str(c.using.get("method", auto)))
    if method == "kruskal_wallis":
        h = hypothesis.kruskal(df, "x", "g").first()[0]
        return {"method": method, "recommended": auto, "statistic": h, "p": 1 - sp.chi2_cdf(h, len(groups) - 1)}
    if method == "welch_anova":
        return {"method": method, "recommended": auto} | samples.welch_anova_of(np.array([r.n for r in groups], float), np.array([r.m for r in groups]), np.array([r.v for r in groups]))
    f, a, b, eta = hypothesis.anova(df, "x", "g").first()
    return {"method": "anova", "recommended": auto, "statistic": f, "df_between": a, "df_within": b, "eta2": eta, "p": 1 - sp.f_cdf(f, a, b)}


@verb("test.chi2", "chi2")
def _chi2(c: Context, s: Step) -> dict:
    o, e = c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)
    x, n = c.one(hypothesis.goodness_of_fit(o, e), F.count("*"))
    return {"statistic": x, "df": n - 1, "p": 1 - sp.chi2_cdf(x, n - 1)}


@verb("test.proportion", "proportion_z")
def _proportion(c: Context, s: Step) -> dict:
    p0, k, n = float(s.get("p0", None, 0.5)), float(s.get("successes", 0, required=True)), float(s.get("n", 1, required=True))
    z = (k / n - p0) / math.sqrt(p0 * (1 - p0) / n)
    return {"statistic": z, "p": float(2 * sp.norm_cdf(-abs(z)))}


@verb("ols_simple")
def _ols(c: Context, s: Step) -> dict:
    x, y = c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)
    a, b, r = c.one(F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_r2(y, x))
    return {"slope": a, "intercept": b, "r2": r}


@verb("train.linear", "regression")
def _linear(c: Context, s: Step) -> dict:
    return models.linear(c.df, c.columns[:-1], c.columns[-1])


@verb("train.logistic")
def _logistic(c: Context, s: Step) -> np.ndarray:
    return models.logistic(c.df, c.columns[:-1], c.columns[-1])


@verb("pca")
def _pca(c: Context, s: Step) -> dict:
    return models.pca(c.df, c.columns, s.get("n_components", 0))


@verb("train.naive_bayes", "gaussian_nb_fit")
def _nb(c: Context, s: Step) -> list:
    return [r.asDict() for r in models.gaussian_nb(c.df, c.columns[:-1], c.columns[-1]).collect()]


_SERIES: dict[str, Callable[[np.ndarray, Step], Any]] = {
    "acf": lambda x, s: kernels.acf(x, int(s.get("max_lag", 0, 20))), "pacf": lambda x, s: kernels.pacf(x, int(s.get("max_lag", 0, 20))),
    "autocorrelation": lambda x, s: kernels.acf(x, int(s.get("max_lag", 0, 20)) - 1),
    "ar": lambda x, s: kernels.ar_fit(x, int(s.get("p", 0, 3))), "ar_fit": lambda x, s: kernels.ar_fit(x, int(s.get("p", 0, 3))),
    "difference": lambda x, s: np.diff(x, int(s.get("d", 0, 1))), "ses": lambda x, s: kernels.ses(x, float(s.get("alpha", 0, 0.3))),
    "adf_test": lambda x, s: kernels.adf(x, int(s.get("n_lags", 0, 5))), "adf": lambda x, s: kernels.adf(x, int(s.get("n_lags", 0, 5))),
    "fft": lambda x, s: np.stack([np.fft.rfft(x).real, np.fft.rfft(x).imag], 1), "periodogram": lambda x, s: np.stack(kernels.periodogram(x, float(s.get("fs", 0, 1.0))), 1),
    "welch_psd": lambda x, s: np.stack(kernels.welch(x, int(s.get("segment_len", 0, 256)), s.get("overlap", 1)), 1),
    "savgol": lambda x, s: kernels.savgol(x, int(s.get("window", 0, 5)), int(s.get("order", 1, 2))), "envelope": lambda x, s: kernels.envelope(x),
    "haar_dwt": lambda x, s: np.stack(kernels.haar(x), 1), "sample_entropy": lambda x, s: kernels.sample_entropy(x, int(s.get("m", None, 2)), float(s.get("r", None, 0.2))),
    "permutation_entropy": lambda x, s: kernels.permutation_entropy(x, int(s.get("m", None, 3)), int(s.get("tau", None, 1))),
    "hurst": lambda x, s: kernels.hurst_rs(x), "hurst_rs": lambda x, s: kernels.hurst_rs(x), "dfa": lambda x, s: kernels.dfa(x, int(s.get("min_box", None, 4)), s.get("max_box", None)),
    "higuchi_fd": lambda x, s: kernels.higuchi(x, int(s.get("kmax", None, 10))), "lempel_ziv": lambda x, s: kernels.lempel_ziv(x),
    "huber": lambda x, s: kernels.m_estimate(x, "huber", float(s.get("k", None, 1.345))), "huber_m": lambda x, s: kernels.m_estimate(x, "huber", float(s.get("k", None, 1.345))),
    "bisquare": lambda x, s: kernels.m_estimate(x, "bisquare", float(s.get("k", None, 4.685))), "skewtest": lambda x, s: kernels.skewtest(x), "kurtosistest": lambda x, s: kernels.kurtosistest(x),
    "wilcoxon": lambda x, s: kernels.wilcoxon(x), "garch": lambda x, s: kernels.garch(x, int(s.get("max_iter", None, 100))), "aitken": lambda x, s: kernels.aitken(x), "wynn_epsilon": lambda x, s: kernels.wynn(x),
    "bocpd": lambda x, s: kernels.bocpd(x),
}
_TWO: dict[str, Callable[[np.ndarray, np.ndarray], Any]] = {
    "kendall": kernels.kendall, "kendall_tau": kernels.kendall, "ks_test_2": kernels.ks_two, "ks_test_two_sample": kernels.ks_two,
    "wasserstein_1d": kernels.wasserstein, "wasserstein": kernels.wasserstein, "theilslopes": kernels.theil_sen, "theil_sen": kernels.theil_sen,
}
_SCALAR: dict[str, Callable[[Step], Any]] = {
    "gcd": lambda s: math.gcd(int(s.get("a", 0, required=True)), int(s.get("b", 1, required=True))), "lcm": lambda s: math.lcm(int(s.get("a", 0, required=True)), int(s.get("b", 1, required=True))),
    "is_prime": lambda s: kernels.is_prime(int(s.get("n", 0, required=True))), "euler_totient": lambda s: kernels.totient(int(s.get("n", 0, required=True))), "factorize": lambda s: kernels.factorize(int(s.get("n", 0, required=True))),
    "black_body": lambda s: 5.670374419e-8 * float(s.get("emissivity", None, 1.0)) * float(s.get("area", None, 1.0)) * float(s.get("temperature", 0, required=True)) ** 4,
    "carnot_efficiency": lambda s: 1 - float(s.get("t_cold", 1, required=True)) / float(s.get("t_hot", 0, required=True)),
    "ideal_gas_pressure": lambda s: float(s.get("n_mol", 0, required=True)) * 8.314462618 * float(s.get("temperature", 1, required=True)) / float(s.get("volume", 2, required=True)),
}


def _black_scholes(s: Step) -> float:
    spot, strike, years = (float(s.get(n, i, required=True)) for i, n in enumerate(("s", "k", "t")))
    rate, vol = float(s.get("r", None, 0.05)), float(s.get("sigma", None, 0.2))
    d1 = (math.log(spot / strike) + (rate + vol * vol / 2) * years) / (vol * math.sqrt(years))
    d2, sign = d1 - vol * math.sqrt(years), 1 if s.get("call", None, True) else -1
    return float(sign * (spot * sp.norm_cdf(sign * d1) - strike * math.exp(-rate * years) * sp.norm_cdf(sign * d2)))


_SCALAR["black_scholes"] = _black_scholes


@dataclass
class Result:
    outputs: list[tuple[str, Any]]
    df: DataFrame
    lints: list[tuple[str, str]]


def run(df: DataFrame, chain: str | list[Step], columns: list[str] | None = None, order: list[str] | None = None) -> Result:
    """Runs a chain over the numeric columns (all, unless named), for ordered verbs in the order of the given columns."""
    steps = parse(chain) if isinstance(chain, str) else chain
    columns = columns or [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    c, outputs = Context(df, columns, order=list(order or [])), []
    for s in steps:
        if s.name == "using":
            c.using |= s.named
            continue
        if s.name in VERBS:
            value = VERBS[s.name](c, s)
        elif s.name in _SERIES:
            value = c.compute([c.col(s, place=None)], lambda x, s=s: _SERIES[s.name](x, s))
        elif s.name in _TWO:
            value = c.compute([c.col(s, "col_x", 0, 0), c.col(s, "col_y", 1, 1)], lambda x, y, s=s: _TWO[s.name](x, y))
        elif s.name in _SCALAR:
            value = _SCALAR[s.name](s)
        else:
            raise ChainError(f"unsupported operation {s.name}")
        if isinstance(value, DataFrame):
            c.df, value = value, None
        outputs.append((s.name, value))
        c.using = {}
    return Result(outputs, c.df, lint(steps))


from tessera.plans import verbs_more, verbs_wide  # noqa: E402,F401  (they register their verbs)
