"""Latency and throughput statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bounds of the cumulative histogram, in milliseconds.
BOUNDS = (1, 2, 5, 10, 20, 50, 100)


def nth_values(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Exact order statistics: for each name the value at a 0-based place in ascending order, the place being an expression
    over ``n``. Equal values are counted first and only the running counts are ordered, so a group costs its distinct
    values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("n", F.sum("__c").over(w)).withColumn("__to", F.sum("__c").over(w.orderBy(value)))
    picks = [F.min(F.when(F.col("__to") > place, F.col(value))).alias(name) for name, place in places.items()]
    return ranked.groupBy(*by).agg(*picks)


def floor_place(p: float) -> Column:
    return F.floor(F.lit(p) / 100 * (F.col("n") - 1))


def latency_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, avg, min, max, p50, p95, p99; a percentile is the value at floor(p / 100 * (n - 1))."""
    basic = rows.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    return basic.join(nth_values(rows, by, value, {f"p{p}": floor_place(p) for p in (50, 95, 99)}), by)


def histogram(rows: DataFrame, value: str, bounds: tuple = BOUNDS) -> DataFrame:
    """(le, n): how many values are at most each bound."""
    counts = rows.agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{b}") for b in bounds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in bounds])).alias("x")).select("x.*")
