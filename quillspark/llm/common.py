"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_holder: list[tuple[str, Callable[[], None]]] = []


def sole_cache(name: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker by an operator that keeps something between tasks: what another operator kept there goes,
    and its memory goes back to the machine where the C library can do that."""
    if _holder and _holder[0][0] == name:
        return
    for _, other in _holder:
        other()
        gc.collect()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _holder[:] = [(name, clear)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the cluster's checkpoint folder.

    The folder is the one in ``spark.checkpoint.dir``. Inside a ``scope`` the table goes at its end.
    """
    return _checkpointed(df, _scopes[-1] if _scopes else None)


def _checkpointed(df: DataFrame, owner: 'Scope | None') -> DataFrame:
    scratch_folder(df.sparkSession)
    out = df.checkpoint()
    place = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if owner and place.isDefined():
        owner.folders.append(place.get())
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are stored: it does so when the driver's JVM collects the
    plans that name them, which may otherwise be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_folder(spark: SparkSession) -> str:
    """The folder that executors and driver share for tables between jobs: ``spark.checkpoint.dir``. A machine-local one
    would not do, so there is none to fall back on but in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def rows_a_batch(spark: SparkSession, n: int) -> AbstractContextManager[None]:
    """Jobs that run inside hand at most ``n`` rows at a time to Python: for rows that hold long binaries."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def a_file_a_task(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs that run inside read each file in a task of its own: for small files whose rows take long."""
    return _setting(spark, "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))


class Scope:
    """Tables of one operator in the shared folder, deleted when it has its result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.outer = spark, [], _scopes[-1] if _scopes else None
        self.stored: list[tuple[DataFrame, str]] = []

    def folder(self) -> str:
        """A new folder's name, for a table that is written in parts."""
        self.folders.append(f"{scratch_folder(self.spark)}/{uuid.uuid4().hex}")
        return self.folders[-1]

    def store(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again: for tables of which later steps read some columns."""
        folder = self.folder()
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.stored.append((out, folder))
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of ``store`` that no later step reads."""
        for out, folder in self.stored:
            if out is df:
                delete_folder(self.spark, folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` computed and stored beyond this scope, for the operator that called this one."""
        return _checkpointed(df, self.outer)


_scopes: list[Scope] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """What ``checkpointed`` and ``Scope.store`` write inside goes at the end; ``Scope.keep`` saves a result."""
    own = Scope(spark)
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        for folder in own.folders:
            delete_folder(spark, folder)
        release(spark)


def delete_folder(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def having(rows: DataFrame, keys: DataFrame, on: list[str], most: int = 1 << 18, how: str = "left_semi") -> DataFrame:
    """The rows whose ``on`` columns are among ``keys``, or with ``how`` "left_anti" are not. Up to ``most`` distinct keys, counted first, are broadcast so that
    the rows need no shuffle; more are joined by shuffle."""
    keys = checkpointed(keys.select(*on).distinct())
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def join_heavy(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, heavy: int = 1000, most: int = 1 << 18) -> DataFrame:
    """``rows`` joined with ``table``, which has each value of ``on`` once and in ``count`` the number of rows that have it.
    Values in at least ``heavy`` rows are broadcast, so that no task gets all rows of one; up to ``most`` of them, counted
    first. The others, and beyond that all, are joined by shuffle."""
    often = table.where(F.col(count) >= heavy).drop(count)
    if often.count() > most:
        return rows.join(table.drop(count), on)
    return rows.join(F.broadcast(often), on).unionByName(rows.join(table.where(F.col(count) < heavy).drop(count), on))


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph given by rows (a, b): returns (node, component), component being the
    smallest node reachable. Nodes without edges are not returned; self-loops and nulls are ignored.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is a grouped minimum, which Spark
    combines before the shuffle, and an equi-join, which adaptive execution splits when one node has most of the edges.
    Nothing is gathered per node and nothing but a number per round reaches the driver.
    """
    links = checkpointed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )  # every row points from the larger to the smaller node

    def settled(df: DataFrame) -> bool:
        """Whether every node either points to one other or is pointed to."""
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(df.select("v", F.lit(0), F.lit(1)))
        left = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.max("in").alias("ins")).where("outs > 1 or (outs > 0 and ins > 0)")
        return left.agg(F.count(F.lit(1))).first()[0] == 0

    for _ in range(rounds):
        if settled(links):
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: the larger neighbours of u point to the least of u's neighbourhood
        large = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        large = large.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
