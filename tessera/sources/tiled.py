"""Parquet tables in the order of a column, with a table of their tiles' statistics beside them.

A tile is a range of the ordering column that holds about ``rows`` rows. The statistics tell which tiles a range of any
column can be in; the tile number is a partition column, so the others are not opened. Writing ends with the statistics:
a table without them is one whose writing was broken off, and reading it is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import tiles


def write(df: DataFrame, path: str, order: str, rows: int = 65_536) -> None:
    """Rows are ranged by quantiles of the ordering column; equal values stay together."""
    n = df.count()
    count = max(1, -(-n // rows))
    edges = df.stat.approxQuantile(order, [k / count for k in range(1, count)], 0.1 / count) if count > 1 else []
    tile = F.lit(0)
    for e in sorted(set(edges)):
        tile = tile + F.when(F.col(order) >= e, 1).otherwise(0)
    tiled = df.withColumn("_tile", tile).repartition("_tile").sortWithinPartitions("_tile", order)
    writer = tiled.write.mode("overwrite")
    (writer.partitionBy("_tile") if n else writer).parquet(f"{path}/rows")  # an empty table keeps its columns in a file
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    tiles.tile_stats(stored, F.col("_tile"), numeric).write.mode("overwrite").parquet(f"{path}/stats")


def stats(spark: SparkSession, path: str) -> DataFrame:
    """tile, column, n, nulls, min, max, sum and sum_sq; an error where the table's writing was broken off."""
    return spark.read.parquet(f"{path}/stats")


def metadata(spark: SparkSession, path: str) -> dict:
    """Rows, tiles and columns, without reading the rows."""
    s = stats(spark, path)
    n, t = s.groupBy("tile").agg(F.max(F.col("n") + F.col("nulls")).alias("n")).agg(F.sum("n"), F.count("*")).first()
    return {"rows": n, "tiles": t, "columns": sorted(r[0] for r in s.select("column").distinct().collect())}


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: tuple[str, float, float] | None = None) -> DataFrame:
    """The rows, or those with a column in a range, from the tiles that can hold them."""
    known = stats(spark, path)
    out = spark.read.parquet(f"{path}/rows")
    if where is not None:
        column, low, high = where
        met = [r[0] for r in known.filter((F.col("column") == column) & (F.col("max") >= low) & (F.col("min") <= high)).select("tile").collect()]
        out = out.filter(F.col("_tile").isin(met) & F.col(column).between(low, high))
    return out.select(*columns) if columns else out.drop("_tile")
