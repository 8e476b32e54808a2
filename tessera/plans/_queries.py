"""How query modules register: a decorator that takes the SQL, and rounding on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded; a NaN becomes NULL, and -0 becomes 0."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.round(F.when(~F.isnan(c), c), places) + F.lit(0.0)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a positive price and a unit size."""
    return t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.abs("value") + 1).alias("price"), F.lit(1.0).alias("size"))


#: The same in SQL.
PRICES = "(SELECT event_id, ts, user_id, event_type, value, abs(value) + 1 AS price, 1.0::DOUBLE AS size FROM events)"
W = "(PARTITION BY user_id ORDER BY ts, event_id)"
ORDER = ["ts", "event_id"]
