"""Tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir; local masters may name none."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """Deletes the tables when the driver ends, as results may read them until then."""
    for spark, path in _LEFT:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame, written once and read again; a lost executor loses none of it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
