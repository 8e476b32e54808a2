"""Tables with tile statistics, and formulas of known values."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.activations import ACTIVATIONS, FORMULAS
from tessera.sources import tiled


def test_tiled_tables(spark, tmp_path):
    df = spark.range(10_000).select("id", (F.col("id") * 7 % 1000).cast("double").alias("x"), F.lit("s").alias("name"))
    path = f"file://{tmp_path}/t"
    tiled.write(df, path, "id", 1000)
    m = tiled.metadata(spark, path)
    assert m["rows"] == 10_000 and 8 <= m["tiles"] <= 12 and m["columns"] == ["id", "x"]
    s = {r.tile: r for r in tiled.stats(spark, path).filter("column = 'id'").collect()}
    assert sum(r.n for r in s.values()) == 10_000 and all(s[k].max < s[k + 1].min for k in range(len(s) - 1))
    part = tiled.read(spark, path, ["id"], ("id", 2500, 2600))
    assert sorted(r.id for r in part.collect()) == list(range(2500, 2601))
    assert 1 <= len({r[0] for r in part.select(F.input_file_name()).collect()}) <= 2
    assert tiled.read(spark, path).count() == 10_000
    tiled.write(df.limit(0), f"{path}0", "id")
    assert tiled.metadata(spark, f"{path}0")["columns"] == []


def test_broken_off_tables_are_errors(spark, tmp_path):
    spark.range(5).write.parquet(f"file://{tmp_path}/b/rows")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tiled.read(spark, f"file://{tmp_path}/b")


def test_formulas_and_activations(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(FORMULAS["escape_velocity"](F.lit(5.972e24), F.lit(6.371e6))) == pytest.approx(11186, rel=1e-3)
    assert value(FORMULAS["orbital_period"](F.lit(1.989e30), F.lit(1.496e11))) / 86400 == pytest.approx(365.2, rel=2e-3)
    assert value(FORMULAS["schwarzschild_radius"](F.lit(1.989e30))) == pytest.approx(2954, rel=1e-3)
    assert value(FORMULAS["snell"](F.lit(1.0), F.lit(1.5), F.lit(math.pi / 6))) == pytest.approx(math.asin(1 / 3))
    assert value(ACTIVATIONS["softplus"](F.lit(800.0))) == 800 and value(ACTIVATIONS["softplus"](F.lit(-800.0))) == 0
    assert all(value(f(*[F.lit(2.0)] * f.__code__.co_argcount)) is not None for f in FORMULAS.values())
