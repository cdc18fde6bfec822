"""Votes, quorums and finality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def quorum(votes: DataFrame, validators: DataFrame) -> DataFrame:
    """(block, power, needed, reached): voting power of each block against total * 2 div 3 + 1; votes count once."""
    total = validators.agg(F.sum("power").alias("total")).select(F.expr("total * 2 div 3 + 1").alias("needed"))
    power = votes.select("block", "validator").distinct().join(validators, votes["validator"] == validators["id"]).groupBy("block").agg(F.sum("power").alias("power"))
    return power.crossJoin(F.broadcast(total)).select("block", "power", "needed", (F.col("power") >= F.col("needed")).alias("reached"))


def three_chain(blocks: DataFrame, certified: DataFrame) -> DataFrame:
    """Blocks with a certified child and a certified grandchild at the next two heights, themselves certified."""
    own = blocks.join(certified, "block", "left_semi").select("block", "parent", "height")
    child = own.select(F.col("block").alias("c"), F.col("parent").alias("block"), F.col("height").alias("ch"))
    grand = own.select(F.col("parent").alias("c"), F.col("height").alias("gh"))
    return own.join(child, "block").join(grand, "c").where("ch = height + 1 and gh = height + 2").select("block", "height").distinct()


def finalized(blocks: DataFrame, committed: DataFrame, rounds: int = 64) -> DataFrame:
    """Committed blocks and all their ancestors, found by doubling: each round joins a block with the ancestor as far above
    it as all rounds before reached, so a chain of n blocks takes about log2(n) joins. Parents that go in a circle raise an error."""
    reach = stored(committed.select("block").distinct())
    jump = stored(blocks.select("block", F.col("parent").alias("up")).where("up is not null"))
    for _ in range(rounds):
        if jump.isEmpty():
            return reach
        reach = stored(reach.union(reach.join(jump, "block").select(F.col("up").alias("block"))).distinct())
        jump = stored(jump.join(jump.select(F.col("block").alias("up"), F.col("up").alias("up2")), "up").select("block", F.col("up2").alias("up")))
    raise RuntimeError("the parents of some blocks go in a circle")


def finality_status(blocks: DataFrame, certified: DataFrame, last_final: int) -> DataFrame:
    """The stage of each block: finalized (height up to ``last_final``), commit (certified grandchild), pre_commit (certified
    child), pending (parent known or certified), unknown."""
    sure = certified.select("block").distinct()
    kids = blocks.join(sure, "block", "left_semi").select(F.col("parent").alias("block"), F.col("block").alias("kid"))
    with_kid = kids.select("block").distinct().withColumn("has_kid", F.lit(True))
    grandkids = kids.join(kids.select(F.col("block").alias("kid")), "kid").select("block").distinct().withColumn("has_grandkid", F.lit(True))
    rows = blocks.join(with_kid, "block", "left").join(grandkids, "block", "left").join(sure.withColumn("sure", F.lit(True)), "block", "left")
    stage = F.when(F.col("height") <= last_final, "finalized").when(F.col("has_grandkid"), "commit").when(F.col("has_kid"), "pre_commit").when(F.col("parent").isNotNull() | F.col("sure"), "pending").otherwise("unknown")
    return rows.select("block", "height", stage.alias("status"))
