"""Latest rows, top rows, runs and as-of values by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def latest_per_key(df: DataFrame, keys: list[str], time: str, ties: list[str]) -> DataFrame:
    """One whole row for each key by a partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in (*keys, time, *ties)]
    row = F.struct(time, *ties, *rest)
    return df.groupBy(*keys).agg(F.max(row).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def runs(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, first, last, n) of each maximal run of consecutive integers."""
    own = df.select(*keys, index).distinct()
    island = F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    return own.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("__island")


def preceding(df: DataFrame, keys: list[str], time: str, wanted: Column, value: str) -> Column:
    """The latest ``value`` of a row that is not ``wanted`` and strictly before this one in time."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(~wanted, F.col(value)), ignorenulls=True).over(w)
