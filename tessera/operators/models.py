"""Models: least squares and PCA from one aggregate of products, naive Bayes, logistic regression, k-means, DBSCAN."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import num
from tessera.operators.aggregates import correlation_sums
from tessera.operators.stages import written


def products(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """n, sums and sums of products of rows without NULLs; one pass, d*d numbers to the driver."""
    row = df.select(*[num(c).alias(c) for c in columns]).dropna().agg(*correlation_sums(columns)).first()
    d = len(columns)
    p = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            p[i, j] = p[j, i] = row[f"p_{i}_{j}"]
    return row.n, np.array([row[f"s_{i}"] for i in range(d)]), p


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    n, s, p = products(df, columns)
    return (p - np.outer(s, s) / n) / (n - 1)


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    c = covariance(df, columns)
    sd = np.maximum(np.sqrt(np.diag(c)), 1e-15)
    return c / np.outer(sd, sd)


def linear(df: DataFrame, features: list[str], target: str) -> dict:
    """Least squares with an intercept by Cholesky; ValueError with too few rows or a singular design."""
    n, s, p = products(df, [*features, target])
    d = len(features)
    if n <= d + 1:
        raise ValueError("too few rows")
    gram = np.block([[np.array([[n]]), s[None, :d]], [s[:d, None], p[:d, :d]]])
    right = np.concatenate([[s[d]], p[:d, d]])
    try:
        low = np.linalg.cholesky(gram)
    except np.linalg.LinAlgError as e:
        raise ValueError("singular design") from e
    b = np.linalg.solve(low.T, np.linalg.solve(low, right))
    sse = float(p[d, d] - b @ right)
    sst = float(p[d, d] - s[d] ** 2 / n)
    return {"intercept": b[0], "coefficients": b[1:], "r2": 1 - sse / sst if sst > 0 else float("nan"), "sigma2": sse / (n - d - 1)}


def pca(df: DataFrame, columns: list[str], k: int | None = None) -> dict:
    """Variances and axes (largest entry positive), by descending variance."""
    values, vectors = np.linalg.eigh(covariance(df, columns))
    order = np.argsort(values)[::-1][: k or len(columns)]
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    return {"variances": values[order], "axes": axes, "explained": values[order] / values.sum()}


def normalized(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population's deviation; constant columns are only centred. One aggregate row is broadcast."""
    stats = df.agg(*[f(num(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    x = df.crossJoin(F.broadcast(stats))
    for c in columns:
        x = x.withColumn(c, (num(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-15, 1.0).otherwise(F.col(f"_s_{c}")))
    return x.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def gaussian_nb(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """label, prior, and mean and variance (plus 1e-9) of each feature."""
    total = df.agg(F.count("*").alias("_t"))
    per = df.groupBy(label).agg(F.count("*").alias("_n"), *[F.avg(num(c)).alias(f"mean_{c}") for c in features], *[(F.var_pop(num(c)) + 1e-9).alias(f"var_{c}") for c in features])
    return per.crossJoin(F.broadcast(total)).withColumn("prior", F.col("_n") / F.col("_t")).drop("_n", "_t")


def gaussian_nb_predict(df: DataFrame, model: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """key and the likeliest class, ties to the smaller; the classes' parameters are one row each."""
    classes = [r.asDict() for r in model.orderBy(label).collect()]
    options = []
    for m in classes:
        s = F.lit(float(np.log(m["prior"])))
        for c in features:
            v = float(m[f"var_{c}"])
            s = s - 0.5 * (float(np.log(2 * np.pi * v)) + (num(c) - float(m[f"mean_{c}"])) * (num(c) - float(m[f"mean_{c}"])) / v)
        options.append(F.struct((-s).alias("s"), F.lit(m[label]).alias("c")))
    best = F.array_min(F.array(*options))["c"]
    return df.select(key, best.alias("predicted"))


def logistic(df: DataFrame, features: list[str], target: str, rounds: int = 25, tol: float = 1e-8) -> np.ndarray:
    """Intercept and weights by Newton's method; each round is one aggregate over all rows."""
    d = len(features)
    rows = df.select(*[num(c).alias(c) for c in [*features, target]]).dropna()
    b = np.zeros(d + 1)
    xs = [F.lit(1.0), *[F.col(c) for c in features]]
    for _ in range(rounds):
        z = sum((float(b[i]) * xs[i] for i in range(1, d + 1)), F.lit(float(b[0])))
        p = 1 / (1 + F.exp(-z))
        g = [F.sum(x * (F.col(target) - p)).alias(f"g{i}") for i, x in enumerate(xs)]
        h = [F.sum(xs[i] * xs[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
        row = rows.agg(*g, *h).first()
        grad = np.array([row[f"g{i}"] for i in range(d + 1)])
        hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)])
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        b = b + step
        if np.abs(step).max() < tol:
            break
    return b


def kmeans(df: DataFrame, key: str, vector: str, centres: list[list[float]], rounds: int = 100) -> tuple[DataFrame, np.ndarray]:
    """key, label and d2 of Lloyd's algorithm from given centres, and the centres. Tasks sum their rows; k rows a task are merged."""
    import pyarrow as pa

    c = np.array(centres, float)
    x = df.select(key, vector)

    def nearest(batch: pa.RecordBatch, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.array(batch.column(vector).to_pylist(), float).reshape(batch.num_rows, c.shape[1])
        d = np.stack([((v - row) ** 2).sum(1) for row in c], 1)
        label = d.argmin(1)
        return v, label, d[np.arange(len(v)), label]

    def sums(c: np.ndarray) -> DataFrame:
        def run(batches):
            n, s = np.zeros(len(c)), np.zeros(c.shape)
            for batch in batches:
                v, label, _ = nearest(batch, c)
                n += np.bincount(label, minlength=len(c))
                np.add.at(s, label, v)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c))), pa.array(n), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["label", "n", "s"])

        part = x.mapInArrow(run, "label long, n double, s array<double>")
        total = part.select("label", "n", F.posexplode("s").alias("j", "v")).groupBy("label", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        return total

    for _ in range(rounds):
        new = c.copy()
        for r in sums(c).collect():
            if r.n:
                new[r.label, r.j] = r.v / r.n
        if np.allclose(new, c, rtol=0, atol=1e-12):
            break
        c = new

    def run(batches):
        for batch in batches:
            _, label, d2 = nearest(batch, c)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(label.astype(np.int64)), pa.array(d2)], names=[key, "label", "d2"])

    return x.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, label long, d2 double"), c


def dbscan(df: DataFrame, key: str, columns: list[str], radius2: float, min_samples: int) -> DataFrame:
    """key and label (-1: noise). Cores have min_samples rows within the radius, themselves included; labels are numbered by first core.

    Distinct places are dealt into cells, small enough that (but in many columns) all places of a cell are near each other: a
    cell's box tells. Then a cell of min_samples rows has cores only, the cores of a cell are one cluster, and places only meet
    where they lie in smaller cells, or to find whether two cells with cores touch, within the reach of each other's boxes. A row
    that is no core takes the label of the near core with the least key. Rows with NULL or NaN are near to themselves only.
    """
    from tessera.operators import graph
    from tessera.operators.joins import around, celled, places, squared

    d, parts = len(columns), max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    reach = math.ceil(d**0.5) if d <= 3 else 1
    side = max(radius2, 1e-300) ** 0.5 / (d**0.5 * (1 + 1e-9) if d <= 3 else 1)
    x, c = [f"x{k}" for k in range(d)], [f"c{k}" for k in range(d)]
    y = [F.col(v).alias(f"y{k}") for k, v in enumerate(x)]
    box = [f(v).alias(f"{n}{k}") for k, v in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))]

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        return around(a, d, reach).repartition(parts, *c).join(b.repartition(parts, *c).hint("merge"), c)

    found = celled(places(df, columns, key), d, side)
    cells = found.groupBy(*c).agg(F.sum("n").alias("total"), *box)
    small = squared(d, "hi", "lo") <= radius2
    found = written(found.join(cells.select(*c, "total", small.alias("small")).hint("merge"), c).withColumn("dense", F.expr(f"small AND total >= {min_samples}")), "places")
    unsure = found.filter("NOT dense")
    near = lambda a, b: meet(a, b.select("m", *y, *c)).filter(squared(d) <= radius2)
    counted = near(unsure.select("p", *x, *c), found.select(F.col("n").alias("m"), *x, *c)).groupBy("p").agg(F.sum("m").alias("m"))
    lone = counted.filter(F.col("m") >= min_samples).select("p")
    cores = found.filter("dense").union(unsure.join(lone.hint("merge"), "p").select(*found.columns))
    first = cores.filter("small").groupBy(*c).agg(F.min("p").alias("first"))
    cores = written(cores.join(first.hint("merge"), c, "left").select("p", *x, *c, F.when(F.col("small"), F.col("first")).otherwise(F.col("p")).alias("g")), "cores")

    groups = cores.groupBy("g", *c).agg(*box)
    other = groups.select(F.col("g").alias("h"), *c, *[F.col(f"{n}{k}").alias(f"{n}{k}_") for k in range(d) for n in ("lo", "hi")])
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(lo[0]) - F.col(hi[1]), F.col(lo[1]) - F.col(hi[0]))
    gaps = [gap((f"lo{k}", f"lo{k}_"), (f"hi{k}", f"hi{k}_")) for k in range(d)]
    spans = [F.greatest(F.col(f"hi{k}") - F.col(f"lo{k}_"), F.col(f"hi{k}_") - F.col(f"lo{k}")) for k in range(d)]
    square = lambda v: sum((q * q for q in v[1:]), v[0] * v[0])
    beside = written(meet(groups, other).filter("g < h").filter(square(gaps) <= radius2).withColumn("sure", square(spans) <= radius2), "beside")
    to = lambda k: F.greatest(F.lit(0.0), F.col(f"x{k}") - F.col(f"hi{k}_"), F.col(f"lo{k}_") - F.col(f"x{k}"))
    back = lambda k: F.greatest(F.lit(0.0), F.col(f"y{k}") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"y{k}"))
    open_ = beside.filter("NOT sure")
    ours = open_.join(cores.select("g", *x).hint("merge"), "g").filter(square([to(k) for k in range(d)]) <= radius2).select("g", "h", *x)
    theirs = open_.join(cores.select(F.col("g").alias("h"), *y).hint("merge"), "h").filter(square([back(k) for k in range(d)]) <= radius2).select("g", "h", *[f"y{k}" for k in range(d)])
    touch = ours.repartition(parts, "g", "h").join(theirs.repartition(parts, "g", "h").hint("merge"), ["g", "h"]).filter(squared(d) <= radius2).select("g", "h").distinct()
    links = written(beside.filter("sure").select("g", "h").union(touch), "links")

    odd = F.lit(False)
    for v in columns:
        odd = odd | F.col(v).isNull() | F.isnan(F.col(v).cast("double"))
    rows = df.select(F.col(key).alias("id"), *[F.col(v).cast("double").alias(n) for v, n in zip(columns, x, strict=True)], odd.alias("odd"))
    nodes = cores.select(F.col("g").alias("node")).distinct()
    if min_samples <= 1:
        nodes = nodes.union(rows.filter("odd").select("id"))
    labels = written(graph.components(links.select(F.col("g").alias("src"), F.col("h").alias("dst")), nodes=nodes).select("node", F.col("component").alias("label")), "components")
    cored = written(cores.join(labels.hint("merge"), cores["g"] == labels["node"]).select("p", *x, *c, "label"), "cored")
    beyond = unsure.join(cores.select("p").hint("merge"), "p", "left_anti").select("p", *x, *c)
    edge = near(beyond, cored.select(F.struct("p", "label").alias("m"), *x, *c)).groupBy("p", *x).agg(F.min("m")["label"].alias("label"))
    told = cored.select(*x, "label").union(edge.select(*x, "label"))
    out = rows.filter("NOT odd").join(told.hint("merge"), x, "left").select("id", "label")
    lost = rows.filter("odd").select("id", F.lit(None).cast("long").alias("label"))
    if min_samples <= 1:
        lost = rows.filter("odd").select("id").join(labels.hint("merge"), F.col("id") == labels["node"]).select("id", "label")
    return out.union(lost).select(F.col("id").alias(key), F.coalesce("label", F.lit(-1)).cast("long").alias("label"))
