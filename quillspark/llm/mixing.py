"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, read

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to rows (sk, source_size): ``share`` of all words by weight, at most ``most`` times the source.

    Sharing an excess again by weight until no source is above its limit ends at min(limit, level * weight) for one
    level. With the sources in order of limit / weight, the level is fixed by the first that stays below its limit. The
    table has one row a source.
    """
    ordered = Window.orderBy("sk")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "sk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("full", F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0))).withColumn("done", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("full")) / (F.sum("weight").over(everything) - F.col("done"))
    rows = rows.withColumn("own", level)
    # the level belongs to the first source, in that order, that it leaves below its limit
    first = F.min(F.when(F.col("own") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "sk", "own"))).over(everything)
    return rows.select("sk", "source_size", F.least("limit", F.coalesce(first["own"] * F.col("weight"), F.col("limit"))).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", digits: int = 3,
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Sources, by code point with null last, have ``weights`` in turn. Returns (id, source, key, size, source_size, target,
    taken). Documents of a source are put in the order of a hash-random key; the mix reads that order around and around
    and stops at the exact word at which the source's budget (its target, rounded) is met, so ``taken`` is a whole number
    of copies for all documents but the one in which the budget ends.

    The order is ranged by the first ``digits`` hex digits of the key. Words are summed per (source, range) first; sums
    over the at most 16**digits ranges of a source give each range's start; within a range a running sum does the rest.
    So no task ever holds a whole source, whatever part of the rows it has.

    Null text and text without words have size 0 and take 0. A null source is a source of its own. Repeated rows each
    count. An empty table gives an empty result. Other columns are ignored.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")).alias("sk"),
        )
    ).withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("sk", "range").agg(F.sum("size").alias("words"))
    ranges = checkpointed(ranges.withColumn("start", F.sum("words").over(Window.partitionBy("sk").orderBy("range")) - F.col("words")))
    targets = source_targets(ranges.groupBy("sk").agg(F.sum("words").alias("source_size")), weights, share, most)
    starts = ranges.join(targets, "sk").select("sk", "range", "start", "source_size", "target")
    running = F.sum("size").over(Window.partitionBy("sk", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (
        rows.withColumn("upto", running)
        .join(starts, ["sk", "range"])
        .withColumn("before", F.col("start") + F.col("upto") - F.col("size"))
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "key", "size", "source_size", "target", (F.col("size") * F.col("epochs") + part).cast("long").alias("taken"))
    )


def repeated(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", most: int = 1 << 18) -> DataFrame:
    """The documents of the mix: each as many times as ``plan`` takes it, counting a begun copy as a whole one.

    ``plan`` has a row for each document, and a document without words is not taken. Of rows that repeat an id, each comes
    as often as the one that is taken most. A plan of up to ``most`` rows, counted first, is broadcast.
    """
    counts = plan.where("taken > 0").groupBy(F.col(id_col).alias("__id")).agg(F.max(F.expr("cast(ceil(taken / size) as int)")).alias("__copies"))
    counts = checkpointed(counts)
    counts = F.broadcast(counts) if counts.count() <= most else counts
    joined = docs.join(counts, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP2_SQL = r"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || cast(doc_id as varchar)) as key, coalesce('s' || source, 't') as sk
  from documents),
sources as (select sk, sum(size)::bigint as source_size from rows group by sk),
weighed as (select *, source_size * 2.0::double as lim, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by sk) - 1) % 3 + 1)::int] as weight from sources),
levels as (
  select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(lim) over w, 0)) / ((sum(weight) over ()) - coalesce(sum(weight) over w, 0)) as own
  from weighed window w as (order by lim / weight, sk rows between unbounded preceding and 1 preceding)),
level as (select own as lev from levels where own * weight <= lim order by lim / weight, sk limit 1),
targets as (select sk, source_size, least(lim, coalesce((select lev from level) * weight, lim)) as target from levels),
placed as (
  select r.*, t.source_size, t.target, round(t.target)::bigint as budget,
         (sum(size) over (partition by r.sk order by key, doc_id, size rows between unbounded preceding and current row))::bigint - size as before
  from rows r join targets t using (sk)),
cut as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from placed)
select doc_id, size, source_size, target,
       (size * epochs + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken, source
from cut
"""
