"""Groups of similar items from the buckets in which they may meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected, release


def _around(buckets: DataFrame, turn: int, close: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs of each node with its bucket's centre: the least node, or in later turns the least after an exclusive or with
    a number that the turn and the bucket give. With ``close``, those pairs only for which it holds of their ``sig``."""
    mask = F.lit(0).cast("long") if not turn else F.pmod(F.xxhash64(F.lit(turn), F.pmod("band", F.lit(8))), F.lit(1 << 62))
    masked = F.col("node").cast("long").bitwiseXOR(mask)
    if close:
        centres = buckets.groupBy("band").agg(F.min(F.struct(masked.alias("least"), F.col("sig").alias("centre_sig"))).alias("c")).select("band", "c.*")
    else:
        centres = buckets.groupBy("band").agg(F.min(masked).alias("least"))
    centre = F.col("least").bitwiseXOR(mask).cast(dict(buckets.dtypes)["node"])
    apart = F.col("node") != centre
    met = buckets.join(centres, "band").where(apart & close("sig", "centre_sig") if close else apart)
    return met.select(F.least("node", centre).alias("a"), F.greatest("node", centre).alias("b")).distinct()


def shared_bands(bands: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The rows of (band, node, ...) whose bucket has several nodes, with their number ``n``. Up to ``most`` such buckets,
    counted first, are broadcast, so that the rows need no shuffle."""
    sizes = checkpointed(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return bands.join(F.broadcast(sizes) if sizes.count() <= most else sizes, "band")


def linked(
    bands: DataFrame, verify: Callable[[DataFrame], DataFrame], in_blocks: Callable[[DataFrame], DataFrame] | None = None,
    close: Callable[[str, str], Column] | None = None, small: int = 16, spread: int = 50, rounds: int = 4,
) -> DataFrame:
    """Components (node, component) of the links among nodes that share a bucket; nodes without a link are left out.

    ``bands`` is a stored table with the rows of ``shared_bands``; ``verify`` takes distinct candidate rows (a, b), a < b, and returns
    those that are links.

    First all nodes of a bucket are compared with one of them only, its centre, so a large group costs as many pairs as
    it has members, and this joins most of it. Then only buckets that still hold different components matter, and no pair
    across components in them is left out:

    * with ``in_blocks``, pairs are listed in buckets of up to ``small`` nodes. Nodes of larger ones go to ``in_blocks``
      as rows (node, cluster), buckets that share a node being one cluster; it compares all nodes of a cluster without
      listing pairs and returns links (a, b) that join what belongs together;
    * without it, all pairs across components are listed; if there are more than ``spread`` a node on average, further
      rounds with other centres go first, ``rounds`` at most.

    With ``close``, ``bands`` has a column ``sig`` too, and only pairs for which ``close`` of the two columns named holds
    are listed.
    """
    multi = bands
    links = checkpointed(verify(_around(multi, 0, close)))
    n_nodes = multi.select("node").distinct().count()
    release(bands.sparkSession)
    for turn in range(1, rounds + 1):
        components = connected(links)
        own = ["band", "node", "n", *(["sig"] if close else [])]
        # the two nodes of a bucket of two have met already
        labelled = multi.where("n > 2").join(components, "node", "left").select(*own, F.coalesce("component", "node").alias("label"))
        mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
        open_ = checkpointed(labelled.join(mixed, "band", "left_semi"))
        listed, apart, more = open_, F.col("label") != F.col("label_b"), None
        if in_blocks:
            large = open_.where(F.col("n") > small).select("band", "node")
            clusters = checkpointed(connected(_around(large, 0)).select("node", F.col("component").alias("cluster")))
            listed = open_.where(F.col("n") <= small).join(clusters, "node", "left")
            if not clusters.isEmpty():
                more = checkpointed(in_blocks(clusters))
                apart = apart & ~F.coalesce(F.col("cluster") == F.col("cluster_b"), F.lit(False))  # those have met
        by_label = listed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
        total = by_label.groupBy("band").agg((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))).alias("twice")).agg(F.sum("twice")).first()[0] or 0
        last = in_blocks is not None or turn == rounds or total <= 2 * spread * n_nodes
        found = None
        if total and last:
            other = listed.select("band", F.col("node").alias("b"), F.col("label").alias("label_b"), *([F.col("cluster").alias("cluster_b")] if in_blocks else []), *([F.col("sig").alias("sig_b")] if close else []))
            apart = apart & close("sig", "sig_b") if close else apart
            found = checkpointed(verify(listed.withColumnRenamed("node", "a").join(other, "band").where((F.col("a") < F.col("b")) & apart).select("a", "b").distinct()))
        elif total:
            found = checkpointed(verify(_around(open_, turn, close)))
        if more is not None:
            found = found.union(more) if found is not None else more
        release(bands.sparkSession)
        if found is None or (last and found.isEmpty()):
            return components
        links = links.union(found)
        if last:
            break
    return connected(links)
