"""Graph operators on edge tables (src, dst, w) over nodes 0..n-1, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stages import written


def degree_centrality(edges: DataFrame, n: int) -> DataFrame:
    """Out-degree over n - 1 for every node."""
    out = edges.filter((F.col("src") < n) & (F.col("dst") < n)).groupBy("src").agg(F.count("*").alias("d"))
    nodes = edges.sparkSession.range(n).withColumnRenamed("id", "node")
    return nodes.join(out, nodes["node"] == out["src"], "left").select("node", (F.coalesce("d", F.lit(0)) / max(n - 1, 1)).alias("centrality"))


def pagerank(edges: DataFrame, n: int, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """Start 1/n; dangling mass is spread evenly; parallel edges count each; stops at an L1 change below tol."""
    edges = written(edges.filter((F.col("src") < n) & (F.col("dst") < n)).groupBy("src", "dst").agg(F.count("*").alias("k")), "edges")
    degree = edges.groupBy("src").agg(F.sum("k").alias("deg"))
    nodes = edges.sparkSession.range(n).withColumnRenamed("id", "node")
    weights = written(edges.join(degree, "src").select("src", "dst", (F.col("k") / F.col("deg")).alias("share")), "shares")
    ranks = nodes.join(degree, nodes["node"] == degree["src"], "left").select("node", F.lit(1.0 / n).alias("rank"), F.col("deg").isNull().alias("dangling"))
    ranks = written(ranks, "ranks")
    dangling = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
    lost = ranks.agg(dangling).first()[0]
    for _ in range(rounds):
        got = weights.join(ranks, weights["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("in"))
        new = ranks.join(got, ranks["node"] == got["dst"], "left").select("node", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + lost / n)).alias("rank"), "dangling", F.col("rank").alias("old"))
        new = written(new, "ranks")
        change, lost = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), dangling).first()
        ranks = new.drop("old")
        if change is None or change < tol:
            break
    return ranks.select("node", "rank")


def components(edges: DataFrame, n: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Labels from 0, in the order of each component's first node. Edges count both ways.

    Nodes are 0..n-1, or those of the column ``node``, whose ids may be any numbers.
    """
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    e = e if n is None else e.filter((F.col("a") < n) & (F.col("b") < n))
    e = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    ids = nodes.select("node") if nodes is not None else edges.sparkSession.range(n).select(F.col("id").alias("node")) if n is not None else e.select(F.col("a").alias("node")).distinct()
    labels = ids.select("node", F.col("node").alias("label"))
    while True:
        near = e.join(labels, e["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("new"), "label")
        hop = new.select(F.col("node").alias("h"), F.col("new").alias("far"))
        new = written(new.join(hop, new["new"] == hop["h"], "left").select("node", F.least("new", "far").alias("new"), "label"), "labels")
        moved = new.filter("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            break
    from tessera.operators.aggregates import running_total

    roots = running_total(labels.filter("node = label").select(F.col("label").alias("root"), F.lit(1).alias("one")), "root", "one", "k").select("root", (F.col("k") - 1).alias("component"))
    return labels.join(roots, labels["label"] == roots["root"]).select("node", "component")


def shortest_paths(edges: DataFrame, source: int, n: int, directed: bool = True, weighted: bool = True) -> DataFrame:
    """Least distances from the source by relaxing frontiers (min-plus); nodes out of reach are left out.

    Negative weights are allowed; a cycle of negative weight raises ValueError.
    """
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    e = edges.filter((F.col("src") < n) & (F.col("dst") < n)).select("src", "dst", w.alias("w"))
    if not directed:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    e = written(e.groupBy("src", "dst").agg(F.min("w").alias("w")), "weights")
    spark = edges.sparkSession
    dist = spark.createDataFrame([(source, 0.0)], "node long, d double")
    front = dist
    for _ in range(n + 1):
        reached = front.join(e, front["node"] == e["src"]).groupBy("dst").agg(F.min(F.col("d") + F.col("w")).alias("nd"))
        new = dist.join(reached, dist["node"] == reached["dst"], "full").select(F.coalesce("node", "dst").alias("node"), F.least("d", "nd").alias("d"), (F.col("d").isNull() | (F.col("nd") < F.col("d"))).alias("better"))
        new = written(new, "distances")
        dist, front = new.select("node", "d"), new.filter("better").select("node", "d")
        if not front.limit(1).count():
            return dist
    raise ValueError("a cycle of negative weight can be reached")


def bfs(edges: DataFrame, source: int, n: int, directed: bool = False) -> DataFrame:
    return shortest_paths(edges, source, n, directed, weighted=False).select("node", F.col("d").cast("long").alias("hops"))
