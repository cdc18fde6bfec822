"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_heavy, read, scope
from .hnsw import _unit, usable

#: Neighbours kept, members compared in one local join, and new neighbours that a local join offers a member.
NEAR, MEET, OFFER = 24, 64, 8
#: Members of the random blocks that the first neighbours come from, and how many such dealings.
BLOCK, DEALS = 512, 2
#: Rounds of NN-descent at most, and the share of list entries that changed in a round below which it ends.
ROUNDS, SETTLED = 8, 0.02
#: Two single-precision cosines that are further apart than this are in the right order.
SLACK = 1e-5


def _best(ids: np.ndarray, sims: np.ndarray, most: int, but: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` highest by cosine, each id once and not ``but``; ties to the smaller id."""
    ids, first = np.unique(ids, return_index=True)
    sims = sims[first]
    if (at := np.searchsorted(ids, but)) < len(ids) and ids[at] == but:
        ids, sims = np.delete(ids, at), np.delete(sims, at)
    order = np.argsort(-sims, kind="stable")[:most]
    return ids[order], sims[order]


def _meet(ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, offer: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Local join: for each member the ``offer`` nearest other members that are not farther than its floor."""
    sims = vectors @ vectors.T
    sims[ids[:, None] == ids[None, :]] = -2
    sims[sims < floor[:, None]] = -2
    k = min(offer, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, top, 1)
    for i in np.flatnonzero((value > -2).any(axis=1)):
        fine = value[i] > -2
        yield ids[i], ids[top[i][fine]], value[i][fine]


def _grouped(batches: Iterator[pd.DataFrame], key: str, most: int | None = None) -> Iterator[pd.DataFrame]:
    """Runs of rows with one key, from batches in order of it; with ``most``, long runs come in parts of that size."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else batch.reset_index(drop=True)
        values = whole[key].to_numpy()
        cut = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a, b, most or b - a):
                yield whole.iloc[i : min(b, i + (most or b - a))]
        held = [whole.iloc[edges[-1] :]]
        while most and len(held[0]) >= most:
            yield held[0].iloc[:most]
            held = [held[0].iloc[most:]]
    if held and len(held[0]):
        yield held[0]


def _offers(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    rows = [(u, ids.astype(np.int64).tobytes(), sims.astype(np.float32).tobytes()) for u, ids, sims in found]
    return pd.DataFrame(rows, columns=["id", "ids", "sims"])


def neighbour_graph(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, unit, ids, sims) for rows (id, unit), unit being the unit vector in single precision: the NEAR nearest neighbours
    found of each. Starts from the best within random blocks. In each round every vector goes to its neighbours, those
    that meet at one are compared and offered to each other, and each keeps its best: joins of neighbours of neighbours.
    A vector that very many have as neighbour compares them MEET at a time, others together in each round. Ends when few
    lists change."""
    kind = dict(vectors.dtypes)["id"]
    graph_schema, offer_schema = f"id {kind}, unit binary, ids binary, sims binary, changed int", f"id {kind}, ids binary, sims binary"

    def units(group: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(group["unit"]), np.float32).reshape(len(group), -1)

    def at_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, "block", 2 * BLOCK):
            if len(group) > 1:
                yield _offers(_meet(group["id"].to_numpy(), units(group), np.full(len(group), -2, np.float32), NEAR))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch["ids"]]
            many = [len(x) for x in ids]
            floor = np.array([np.frombuffer(x, np.float32)[-1] if n == NEAR else -2 for x, n in zip(batch["sims"], many, strict=True)], np.float32)
            row = np.repeat(np.arange(len(batch)), many)
            yield pd.DataFrame({"at": np.concatenate(ids) if ids else [], "id": batch["id"].to_numpy()[row], "unit": batch["unit"].to_numpy()[row], "floor": floor[row]})

    def at_node(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        for group in _grouped(batches, "at", MEET):
            if len(group) > 1:
                out += _meet(group["id"].to_numpy(), units(group), group["floor"].to_numpy(), OFFER)
            if len(out) > 5000:
                yield _offers(iter(out))
                out = []
        yield _offers(iter(out))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in _grouped(batches, "id"):
            own = group["unit"].dropna()
            ids, sims = np.frombuffer(b"".join(group["ids"].dropna()), np.int64), np.frombuffer(b"".join(group["sims"].dropna()), np.float32)
            ids, sims = _best(ids, sims, NEAR, group["id"].iloc[0])
            before = np.frombuffer(group["ids"][group["unit"].notna()].iloc[0] or b"", np.int64)
            out.append((group["id"].iloc[0], own.iloc[0], ids.tobytes(), sims.tobytes(), int((~np.isin(ids, before)).sum())))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    def kept(graph: DataFrame, offers: DataFrame) -> DataFrame:
        rows = graph.select("id", "unit", "ids", "sims").union(offers.select("id", F.lit(None).cast("binary").alias("unit"), "ids", "sims"))
        return checkpointed(rows.repartition("id").sortWithinPartitions("id").mapInPandas(keep, graph_schema))

    columns = ["id", "unit", "ids", "sims", "changed"]
    n = vectors.count()
    empty = F.lit(None).cast("binary")
    graph = vectors.select("id", "unit", empty.alias("ids"), empty.alias("sims"))
    offers = None
    for deal in range(DEALS):
        block = F.pmod(F.xxhash64(F.lit(deal), "id"), F.lit(max(1, n // BLOCK)))
        more = vectors.withColumn("block", block).repartition("block").sortWithinPartitions("block").mapInPandas(at_block, offer_schema)
        offers = more if offers is None else offers.union(more)
    graph = kept(graph, offers)
    for turn in range(rounds):
        sent = graph.mapInPandas(send, f"at {kind}, id {kind}, unit binary, floor float")
        met = sent.repartition("at").sortWithinPartitions("at", F.xxhash64(F.lit(turn), "id")).mapInPandas(at_node, offer_schema)
        graph = kept(graph, met)
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * n * NEAR:
            break
    return graph


def graph_search(graph: DataFrame, queries: DataFrame, rounds: int = 3, expand: int = 96, pool: int = 256) -> DataFrame:
    """(query, ids, sims): the ``pool`` best candidates found for each row (id) of ``queries``, itself a node of the graph.

    Best first from the query's own neighbours: in each round up to ``expand`` of its best candidates that were not
    expanded yet are joined with the nodes that have them as a neighbour, whose cosines come back to the query.
    """
    kind = dict(graph.dtypes)["id"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch["ids"]]
            row = np.repeat(np.arange(len(batch)), [len(x) for x in ids])
            yield pd.DataFrame({"at": np.concatenate(ids) if ids else [], "id": batch["id"].to_numpy()[row], "unit": batch["unit"].to_numpy()[row]})

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in _grouped(batches, "at", MEET):
            out.append((group["at"].iloc[0], group["id"].to_numpy(np.int64).tobytes(), b"".join(group["unit"])))
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=["at", "near", "units"])
                out = []
        yield pd.DataFrame(out, columns=["at", "near", "units"])

    def frontier(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, unit, ids, sims, done in zip(batch["query"], batch["unit"], batch["ids"], batch["sims"], batch["done"], strict=True):
                ids, sims, done = np.frombuffer(ids, np.int64), np.frombuffer(sims, np.float32), np.frombuffer(done, np.uint8)
                floor = sims[pool - 1] if len(sims) >= pool else -2.0
                out += [(i, q, unit, floor) for i in ids[done == 0][:expand]]
            yield pd.DataFrame(out, columns=["at", "query", "unit", "floor"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, unit, floor, near, units_ in zip(batch["query"], batch["unit"], batch["floor"], batch["near"], batch["units"], strict=True):
                ids = np.frombuffer(near, np.int64)
                sims = np.frombuffer(units_, np.float32).reshape(len(ids), -1) @ np.frombuffer(unit, np.float32)
                fine = sims > floor
                out.append((q, ids[fine].tobytes(), sims[fine].tobytes()))
            yield pd.DataFrame(out, columns=["query", "ids", "sims"])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in _grouped(batches, "query"):
            q, own = group["query"].iloc[0], group[group["unit"].notna()].iloc[0]
            before, done = np.frombuffer(own["ids"], np.int64), np.frombuffer(own["done"], np.uint8)
            old = before[(done == 1) | (np.cumsum(done == 0) <= expand)] if len(group) > 1 else before[done == 1]
            ids, sims = _best(np.frombuffer(b"".join(group["ids"]), np.int64), np.frombuffer(b"".join(group["sims"]), np.float32), pool, q)
            out.append((q, own["unit"], ids.tobytes(), sims.tobytes(), np.isin(ids, old).astype(np.uint8).tobytes()))
        yield pd.DataFrame(out, columns=["query", "unit", "ids", "sims", "done"])

    lists = checkpointed(graph.mapInPandas(pack, f"at {kind}, id {kind}, unit binary").repartition("at").sortWithinPartitions("at").mapInPandas(bundle, f"at {kind}, near binary, units binary"))
    state = graph.join(queries, "id", "left_semi").select(F.col("id").alias("query"), "unit", "ids", "sims", F.expr("cast(repeat(char(0), cast(length(ids) / 8 as int)) as binary)").alias("done"))
    state = checkpointed(state)
    schema = f"query {kind}, unit binary, ids binary, sims binary, done binary"
    for _ in range(rounds):
        asked = state.mapInPandas(frontier, f"at {kind}, query {kind}, unit binary, floor float")
        answers = asked.join(lists, "at").select("query", "unit", "floor", "near", "units").mapInPandas(compare, f"query {kind}, ids binary, sims binary")
        nothing = F.lit(None).cast("binary")
        rows = state.union(answers.select("query", nothing.alias("unit"), "ids", "sims", nothing.alias("done")))
        state = checkpointed(rows.repartition("query").sortWithinPartitions("query").mapInPandas(settle, schema))
    return state.select("query", "ids", "sims")


def nearest(rows: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, rounds: int = 3, expand: int = 96, pool: int = 256) -> DataFrame:
    """The ``k`` nearest rows found, by cosine, of each row for which ``asked`` holds: (query_id, rank, id, score).

    Candidates are all rows but the query's own id. Scores are cosines of the original vectors in double precision; rank
    counts from 1, ties to the smaller id. Vectors that are null, empty, zero or hold a null or non-finite component take
    no part, nor do null ids. All vectors are taken to have one length; ids are integers and meant to be unique (of rows
    that repeat an id, one is kept). A query without candidates, and an empty table, give no rows. Other columns are
    ignored.

    Equal vectors are one node of the graph, named by their least id; of each node found, the k + 1 least ids are ranked,
    so copies, however many, neither fill the graph nor hide each other.
    """
    good = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    good = good.where(usable("vector")).dropDuplicates(["id"]).withColumns({"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit(2), "vector")})
    kind = dict(good.dtypes)["id"]

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.stack(batch["vector"].to_numpy())
                yield pd.DataFrame({"id": batch["node"], "unit": [x.tobytes() for x in _unit(raw).astype(np.float32)]})

    def scaled(column: pd.Series) -> np.ndarray:
        """The vectors, each times a power of two that keeps its squares finite; cosines stay exactly what they are."""
        raw = np.stack(column.to_numpy())
        return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = scaled(batch["va"]), scaled(batch["vb"])
                score = np.einsum("nd,nd->n", a, b) / (np.sqrt(np.einsum("nd,nd->n", a, a)) * np.sqrt(np.einsum("nd,nd->n", b, b)))
                yield pd.DataFrame({"from": batch["from"], "node": batch["node"], "score": score})

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nodes that may be among the k nearest, and the query's own for its copies."""
        for batch in batches:
            out = []
            for q, ids, sims in zip(batch["query"], batch["ids"], batch["sims"], strict=True):
                ids, sims = np.frombuffer(ids, np.int64), np.frombuffer(sims, np.float32)
                floor = sims[k - 1] - SLACK if len(sims) >= k else -2
                out += [(q, i) for i in ids[sims >= floor]] + [(q, q)]
            yield pd.DataFrame(out, columns=["from", "node"])

    with scope(rows.sparkSession) as tables:
        nodes = checkpointed(good.groupBy("v1", "v2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
        vectors = good.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").select(F.col("id").alias("node"), "vector")
        members = checkpointed(join_heavy(good.select("id", "asked", "v1", "v2"), nodes, ["v1", "v2"], "n").select("node", "id", "asked"))
        graph = neighbour_graph(checkpointed(vectors.mapInPandas(unit, f"id {kind}, unit binary")))
        state = graph_search(graph, members.where("asked").select(F.col("node").alias("id")).distinct(), rounds, expand, pool)
        pairs = state.mapInPandas(some, f"from {kind}, node {kind}")
        both = pairs.join(vectors.withColumnRenamed("vector", "vb"), "node").join(vectors.select(F.col("node").alias("from"), F.col("vector").alias("va")), "from")
        scored = both.mapInPandas(exact, f"from {kind}, node {kind}, score double")
        least = members.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("nth") <= k + 1).select("node", "id")
        answers = scored.join(least, "node").join(members.where("asked").select(F.col("node").alias("from"), F.col("id").alias("query_id")), "from").where("id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return tables.keep(answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score"))


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
