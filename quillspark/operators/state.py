"""Keyed state: folds over change feeds, overlays, differences, scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(changes: DataFrame, keys: list[str], order: list[str], value: str = "value", op: str = "op", as_of: Column | None = None) -> DataFrame:
    """Last write wins: the newest change of each key in ``order``, unless it is a delete. Partial maxima are combined
    before the shuffle, so a key with very many changes is no hot spot."""
    rows = changes.where(as_of) if as_of is not None else changes
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.col(op).alias("__op"), F.col(value).alias("__value"))).alias("c"))
    return newest.where(F.col("c.__op") == "set").select(*keys, F.col("c.__value").alias(value), F.col(f"c.{order[0]}").alias("last_seq"))


def overlay(top: DataFrame, base: DataFrame, keys: list[str], deleted: str = "deleted") -> DataFrame:
    """Rows of ``top`` over those of ``base``; rows of ``top`` marked deleted hide what is below."""
    under = base.join(top.select(*keys), keys, "left_anti")
    return top.where(~F.col(deleted)).drop(deleted).unionByName(under)


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Changes that lead from ``before`` to ``after``: (keys, op set or delete, value)."""
    a = before.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__was"))
    b = after.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__is"))
    both = a.join(b, keys, "full")
    changed = F.col("__is").isNull() | F.col("__was").isNull() | ~F.col("__old").eqNullSafe(F.col("__new"))
    return both.where(changed).select(*keys, F.when(F.col("__is").isNull(), "delete").otherwise("set").alias("op"), F.col("__new").alias(value))


def fold_twice(changes: DataFrame, keys: list[str], order: list[str], early: Column, value: str = "value", op: str = "op") -> DataFrame:
    """(keys, old, new): the newest change of each key among those for which ``early`` holds and among all, as structs of
    value and last_seq, null where the key does not exist then. One shuffle gives both states."""
    change = F.struct(*order, F.col(op).alias("__op"), F.col(value).alias("__value"))
    newest = changes.groupBy(*keys).agg(F.max(F.when(early, change)).alias("o"), F.max(change).alias("n"))

    def alive(c: str) -> Column:
        return F.when(F.col(f"{c}.__op") == "set", F.struct(F.col(f"{c}.__value").alias(value), F.col(f"{c}.{order[0]}").alias("last_seq")))

    return newest.select(*keys, alive("o").alias("old"), alive("n").alias("new"))


def version_of(versions: DataFrame, keys: list[str], which: str) -> DataFrame:
    """The state "old" or "new" of ``fold_twice``."""
    return versions.where(F.col(which).isNotNull()).select(*keys, f"{which}.*")


def changed(versions: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``diff`` of the two states of ``fold_twice``, without a join."""
    differ = (F.col("old").isNull() != F.col("new").isNull()) | ~F.col(f"old.{value}").eqNullSafe(F.col(f"new.{value}"))
    rows = versions.where((F.col("old").isNotNull() | F.col("new").isNotNull()) & differ)
    return rows.select(*keys, F.when(F.col("new").isNull(), "delete").otherwise("set").alias("op"), F.col(f"new.{value}").alias(value))


def apply_diff(base: DataFrame, changes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    top = changes.select(*keys, value, (F.col("op") == "delete").alias("deleted"))
    return overlay(top, base.select(*keys, value), keys)


def lookup(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its state, null where there is none."""
    return rows.join(state, keys, "left")


def existing(rows: DataFrame, state: DataFrame, keys: list[str], exists: bool = True) -> DataFrame:
    return rows.join(state.select(*keys), keys, "left_semi" if exists else "left_anti")


def range_scan(rows: DataFrame, key: str, gt=None, gte=None, lt=None, lte=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows with keys inside the bounds, in key order; with a limit, the first so many."""
    bounds = [F.col(key) > gt if gt is not None else None, F.col(key) >= gte if gte is not None else None, F.col(key) < lt if lt is not None else None, F.col(key) <= lte if lte is not None else None]
    rows = reduce(lambda d, b: d.where(b), [b for b in bounds if b is not None], rows)
    rows = rows.orderBy(F.desc(key) if reverse else F.asc(key))
    return rows.limit(limit) if limit is not None else rows


def as_of(rows: DataFrame, versions: DataFrame, at: str, version: str, by: list[str] | None = None, width: int = 1 << 20) -> DataFrame:
    """Each row with the greatest version not above it (null if none), within ``by``. Versions and positions are whole
    numbers, dealt into ranges of ``width``: a range carries in the greatest version of all ranges before it, and only rows and
    versions of one range are sorted together."""
    by = by or []
    span = F.floor(F.col("__at") / width)
    marks = versions.select(*by, F.col(version).alias("__at")).distinct().withColumn("__span", span)
    both = rows.withColumns({"__at": F.col(at), "__mark": F.lit(None).cast(dict(versions.dtypes)[version])}).withColumn("__span", span)
    both = both.unionByName(marks.withColumn("__mark", F.col("__at")), allowMissingColumns=True)
    order = Window.partitionBy(*by, "__span").orderBy("__at", F.col("__mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__last", F.last("__mark", ignorenulls=True).over(order)).where(F.col("__mark").isNull())
    # one row a range
    spans = both.groupBy(*by, "__span").agg(F.max("__mark").alias("__most"))
    before = F.max("__most").over(Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(*by, "__span", before.alias("__carried"))
    keys = [*by, "__span"]
    found = inside.join(carried.toDF(*[f"__r{i}" for i in range(len(keys))], "__carried"), [inside[k].eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)], "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__last", "__carried").alias(version))
