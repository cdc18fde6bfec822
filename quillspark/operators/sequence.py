"""Ordered logs: dense sequence numbers, nonces, admission, gaps, conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def numbered(rows: DataFrame, coarse: Column, order: list, name: str = "seq") -> DataFrame:
    """Dense numbers from 1 in (coarse, order). ``coarse`` parts the order into many runs (a day, a prefix); rows are counted
    per run, runs get their starts from sums over the small table of runs, and only rows of one run are sorted together.
    So no task sees all rows."""
    rows = rows.withColumn("__run", coarse)
    runs = rows.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    runs = runs.select(F.col("__run"), (F.sum("__n").over(Window.orderBy("__run")) - F.col("__n")).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__run").orderBy(*order))
    return rows.withColumn("__nth", nth).join(runs, rows["__run"].eqNullSafe(runs["__run"])).withColumn(name, (F.col("__start") + F.col("__nth")).cast("long")).drop("__run", "__nth", "__start")


def accepted_nonces(tx: DataFrame, sender: str, order: list[str], nonce: str, initial: int = 0) -> DataFrame:
    """Marks each transaction of a sender: ok if its nonce follows the last accepted one, else nonce_low or nonce_gap. A
    rejected one does not advance the count. Rows are dealt by sender, sorted, and streamed; what is kept between them is
    the sender and one number, so a sender may have any number of rows. A null nonce is a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, current = object(), initial
        for batch in batches:
            verdicts = []
            for who, claimed in zip(batch.column(sender).to_pylist(), batch.column(nonce).to_pylist(), strict=True):
                if who != last:
                    last, current = who, initial
                if claimed == current + 1:
                    current = claimed
                    verdicts.append("ok")
                else:
                    verdicts.append("nonce_low" if claimed is not None and claimed <= current else "nonce_gap")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.string())], [*batch.schema.names, "verdict"])

    schema = StructType([*tx.schema.fields, StructField("verdict", StringType())])
    return tx.repartition(sender).sortWithinPartitions(sender, *order).mapInArrow(run, schema)


def gaps(log: DataFrame, seq: str = "seq", width: int = 1 << 16) -> DataFrame:
    """Ranges of missing numbers: (after, before) for each break, and one from 0 if the log does not begin at 1. A number is
    a break if its neighbour is absent, found by an equi-join. The i-th number after a break belongs to the i-th before
    one; both are numbered within ranges of ``width``, so nothing is sorted as a whole."""
    present = log.select(F.col(seq).cast("long").alias("x")).where("x > 0").distinct()
    zero = present.sparkSession.range(1).select(F.col("id").alias("x"))
    heads = present.join(present.select((F.col("x") + 1).alias("x")).union(zero.select(F.col("x") + 1)), "x", "left_anti")
    tails = present.union(zero).join(present.select((F.col("x") - 1).alias("x")), "x", "left_anti")
    greatest = present.agg(F.max("x").alias("x"))
    tails = tails.join(greatest, "x", "left_anti")

    def places(rows: DataFrame, name: str) -> DataFrame:
        return numbered(rows.select(F.col("x").alias(name)), F.floor(F.col(name) / width), [name], "__i")

    return places(tails, "after").join(places(heads, "before"), "__i").select("after", "before")


def raw_conflicts(accesses: DataFrame) -> DataFrame:
    """Transactions that read a key which an earlier one writes; rows (tx, rw R or W, key). Only the first writer of a key
    matters, so this is a grouped minimum and an equi-join, with no pairs of readers and writers."""
    first = accesses.where("rw = 'W'").groupBy("key").agg(F.min("tx").alias("first_writer"))
    return accesses.where("rw = 'R'").join(first, "key").where("first_writer < tx").select("tx").distinct()


def optimistic_prefix(accesses: DataFrame) -> DataFrame:
    """(tx, committed): those before the first conflict commit in parallel, the rest run again in order."""
    first = raw_conflicts(accesses).agg(F.min("tx").alias("first_conflict"))
    return accesses.select("tx").distinct().crossJoin(F.broadcast(first)).select("tx", F.coalesce(F.col("tx") < F.col("first_conflict"), F.lit(True)).alias("committed"))


def round_stats(accesses: DataFrame) -> DataFrame:
    """One row: transactions, conflicts, committed in the first round, rounds."""
    n = accesses.agg(F.countDistinct("tx").alias("transactions"))
    c = raw_conflicts(accesses).agg(F.count(F.lit(1)).alias("conflicts"))
    p = optimistic_prefix(accesses).agg(F.sum(F.col("committed").cast("long")).alias("first_round"))
    return n.crossJoin(c).crossJoin(p).withColumn("rounds", F.when(F.col("conflicts") > 0, 2).otherwise(1))
