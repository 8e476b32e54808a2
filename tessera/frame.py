"""Frame: a thin typed surface over a Spark DataFrame. Every method only adds to the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.exprs import Expr, where

__all__ = ["Expr", "Frame", "GroupBy", "where"]


class Frame:
    """order: the column that gives rows their order (used by head, sort's ties and joins' first match)."""

    def __init__(self, df: DataFrame, order: str | None = None):
        self.df, self.order = df, order

    @classmethod
    def from_dict(cls, spark: SparkSession, data: dict, order: str | None = None) -> Frame:
        lengths = {len(v) for v in data.values()}
        if len(lengths) > 1:
            raise ValueError(f"columns of unequal lengths {sorted(lengths)}")
        return cls.from_arrow(spark, __import__("pyarrow").table({k: list(v) for k, v in data.items()}), order)

    @classmethod
    def from_pandas(cls, spark: SparkSession, pdf, order: str | None = None) -> Frame:
        return cls(spark.createDataFrame(pdf), order)

    @classmethod
    def from_arrow(cls, spark: SparkSession, table, order: str | None = None) -> Frame:
        return cls(spark.createDataFrame(table), order)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, columns: list[str] | None = None, order: str | None = None) -> Frame:
        df = spark.read.parquet(path)
        return cls(df.select(columns) if columns else df, order)

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()

    def to_parquet(self, path: str, mode: str = "error") -> None:
        self.df.write.mode(mode).parquet(path)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def __getitem__(self, name: str) -> Expr:
        if name not in self.df.columns:
            raise KeyError(name)
        return Expr(name)

    def with_column(self, name: str, value: Expr | Column) -> Frame:
        return Frame(self.df.withColumn(name, value.column if isinstance(value, Expr) else value), self.order)

    def select(self, *names: str) -> Frame:
        for n in names:
            if n not in self.df.columns:
                raise KeyError(n)
        return Frame(self.df.select(*names), self.order if self.order in names else None)

    def filter(self, mask: Expr | Column) -> Frame:
        """Rows where an expression is above 0 (NaN is not), or where a boolean column holds."""
        if isinstance(mask, Expr):
            mask = (mask.column > 0) & ~F.isnan(mask.column)
        return Frame(self.df.filter(mask), self.order)

    def head(self, n: int = 5) -> Frame:
        return Frame((self.df.orderBy(self.order) if self.order else self.df).limit(n), self.order)

    def sort(self, by: str, ascending: bool = True) -> Frame:
        keys = [by, *([self.order] if self.order else [])]
        return Frame(self.df.orderBy(*[F.col(k).asc() if ascending else F.col(k).desc() for k in keys]), self.order)

    def concat(self, other: Frame) -> Frame:
        if set(self.columns) != set(other.columns):
            raise ValueError("frames of different columns")
        return Frame(self.df.unionByName(other.df), self.order)

    def describe(self) -> Frame:
        """count, mean, std (of the population), min and max of each numeric column, in one pass."""
        names = [n for n, t in self.df.dtypes if t in ("double", "float", "bigint", "int", "smallint", "tinyint") or t.startswith("decimal")]
        stats = [F.struct(F.lit(n).alias("column"), F.count(n).alias("count"), F.avg(F.col(n).cast("double")).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).cast("double").alias("min"), F.max(n).cast("double").alias("max")) for n in names]
        return Frame(self.df.agg(F.array(*stats).alias("r")).select(F.explode("r").alias("r")).select("r.*"))

    def join(self, other: Frame, on: str, how: str = "inner") -> Frame:
        """Inner equi-join with at most one right row a key (its first by order); right columns win name clashes."""
        if how != "inner":
            raise NotImplementedError(f"join how={how!r}")
        right = other.df
        if other.order:
            w = Window.partitionBy(on).orderBy(other.order)
            right = right.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        else:
            right = right.dropDuplicates([on])
        mine = [c for c in self.columns if c == on or c not in right.columns]
        return Frame(self.df.select(*mine).join(right, on).select(*[c for c in self.columns], *[c for c in right.columns if c not in self.columns]), self.order)

    def groupby(self, key: str) -> GroupBy:
        return GroupBy(self.df, key)

    def evaluate(self, expr: Expr, name: str = "value") -> Frame:
        return Frame(self.df.select(expr.column.alias(name)))

    def fused_sum(self, expr: Expr, name: str = "sum") -> Frame:
        return Frame(self.df.agg(F.sum(expr.column).alias(name)))

    def stat(self, name: str, column: str) -> Column:
        """sum, mean, min, max or std (of the population) of a column, for agg."""
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop}[name](F.col(column).cast("double"))


class GroupBy:
    """Aggregates by one key; results come in no order, as consumers sort when they need one."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def _agg(self, *aggs: Column) -> Frame:
        return Frame(self.df.groupBy(self.key).agg(*aggs), self.key)

    def sum(self, column: str) -> Frame:
        return self._agg(F.sum(F.col(column).cast("double")).alias(column))

    def mean(self, column: str) -> Frame:
        return self._agg(F.avg(F.col(column).cast("double")).alias(column))

    def count(self) -> Frame:
        return self._agg(F.count("*").alias("count"))

    def agg(self, column: str, funcs: tuple[str, ...] = ("sum", "mean", "count")) -> Frame:
        c = F.col(column).cast("double")
        known = {"sum": F.sum(c).alias(f"{column}_sum"), "mean": F.avg(c).alias(f"{column}_mean"), "count": F.count("*").alias("count")}
        return self._agg(*[known[f] for f in funcs if f in known])

    def sum_expr(self, expr: Expr, name: str = "sum") -> Frame:
        return self._agg(F.sum(expr.column).alias(name))
