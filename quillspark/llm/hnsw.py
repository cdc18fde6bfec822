"""Embedding near-duplicates with a hierarchical navigable small-world graph for each shard."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected, read

#: Neighbours a node keeps in an upper layer; twice as many in the lowest. A layer has 1/DEGREE of the nodes of the one below.
DEGREE = 16
#: Search: first width of the beam, how much wider the next is, nodes expanded at a time, queries searched together.
BEAM, WIDEN, EXPAND, TOGETHER = 48, 4, 4, 512
#: Every AUDIT-th query of a search is compared with a full scan; the least part of its links that must be found.
AUDIT, RECALL = 16, 0.999


def usable(vector: str) -> Column:
    """Whether an array column holds a vector with a direction: not null or empty, all finite, not all zero."""
    return F.expr(f"coalesce(size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0), false)")


def _diverse(near: np.ndarray, own: np.ndarray, vectors: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates, nearest first (-1 where there are none), ``degree`` to link with: half of them the nearest, half spread out,
    being nearer to the row than to one taken before."""
    cross = np.einsum("qad,qbd->qab", vectors[near], vectors[near])
    valid = near >= 0
    taken = np.zeros(near.shape, bool)
    for k in range(near.shape[1]):
        spread = ~(taken & (cross[:, k, :] >= own[:, k, None])).any(axis=1)
        taken[:, k] = valid[:, k] & ((k < degree // 2) | (spread & (taken.sum(axis=1) < degree)))
    rank = np.argsort(2 * ~valid + ~taken, axis=1, kind="stable")[:, :degree]  # those taken, then the nearest of the rest
    return np.take_along_axis(near, rank, 1), np.take_along_axis(own, rank, 1)


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, at: np.ndarray, best: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer from the node ``at`` of each query, with cosine ``best``: the ``beam`` nearest found."""
    rows = np.arange(len(queries))[:, None]
    seen = np.zeros((len(queries), len(links)), bool)
    seen[rows[:, 0], at] = True
    ids, sims = np.full((len(queries), beam), -1), np.full((len(queries), beam), -2, np.float32)
    ids[:, 0], sims[:, 0] = at, best
    done = np.zeros((len(queries), beam), bool)
    while True:
        open_ = np.where(done | (ids < 0), -2, sims)
        pick = np.argsort(-open_, axis=1, kind="stable")[:, :EXPAND]
        live = np.take_along_axis(open_, pick, 1) > -2
        busy = np.flatnonzero(live.any(axis=1))
        if not len(busy):
            return ids, sims
        pick, live = pick[busy], live[busy]
        done[busy[:, None], pick] |= live
        around = np.where(live[:, :, None], links[ids[busy[:, None], pick]], -1).reshape(len(busy), -1)
        around = np.sort(around, axis=1)
        fresh = (around >= 0) & ~seen[busy[:, None], around]
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        value = np.where(fresh, np.einsum("qd,qkd->qk", queries[busy], vectors[around]), -2)
        q, k = np.nonzero(fresh)
        seen[busy[q], around[q, k]] = True
        all_ids = np.concatenate((ids[busy], np.where(fresh, around, -1)), axis=1)
        all_sims = np.concatenate((sims[busy], value), axis=1)
        all_done = np.concatenate((done[busy], np.zeros_like(fresh)), axis=1)
        keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[busy], sims[busy], done[busy] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_done))


class Graph:
    """Layers of one shard's vectors (unit length, float32), from the highest; the last has all of them.

    A layer is built by inserting its nodes, some at a time: each searches what the layer holds so far, entering from the
    layer above, and links with a spread-out choice of what it finds and of those inserted with it; links are made
    mutual, and a full node keeps the nearer ones.
    """

    def __init__(self, vectors: np.ndarray, keys: np.ndarray):
        self.vectors = vectors
        chance = (pd.util.hash_array(keys) >> np.uint64(11)) / float(1 << 53)
        height = np.floor(-np.log(np.maximum(chance, 1e-300)) / math.log(DEGREE)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(int(height.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(height >= level)
            if level and len(nodes) < 2:
                continue
            # nodes of the layer above come first: they are where searches enter
            nodes = nodes[np.argsort(-height[nodes], kind="stable")]
            links = self._insert(nodes)
            whole = np.full((len(vectors), links.shape[1]), -1, np.int32)
            whole[nodes] = np.where(links >= 0, nodes[links], -1)
            self.layers.append((nodes, whole))

    def _insert(self, nodes: np.ndarray) -> np.ndarray:
        """Links between positions in ``nodes``: own choices, then those of others."""
        part, n = self.vectors[nodes], len(nodes)
        links, sims_to = np.full((n, 2 * DEGREE), -1, np.int32), np.full((n, 2 * DEGREE), -2, np.float32)
        place = np.full(len(self.vectors), -1)
        place[nodes] = np.arange(n)
        inside = 0
        while inside < n:
            new = np.arange(inside, min(n, inside + min(max(inside, 2 * DEGREE), TOGETHER)))
            own = part[new] @ part[new].T
            own[np.arange(len(new)), np.arange(len(new))] = -2
            ids, sims = np.broadcast_to(new, own.shape), own
            if inside:
                at, best = self._enter(part[new], place, inside) if self.layers else (np.zeros(len(new), int), part[new] @ part[0])
                found, near = _beam(part, links[:inside], part[new], at, best, BEAM)
                ids, sims = np.concatenate((ids, found), axis=1), np.concatenate((sims, near), axis=1)
            many = min(3 * DEGREE, ids.shape[1])
            top = np.argsort(-sims, axis=1, kind="stable")[:, :many]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            ids = np.where(sims > -2, ids, -1)
            chosen, value = _diverse(ids, sims, part, DEGREE)
            width = chosen.shape[1]
            links[new, :width], sims_to[new, :width] = chosen, np.where(chosen >= 0, value, -2)
            for source, targets, values in zip(new, chosen, value, strict=True):
                for target, sim in zip(targets, values, strict=True):
                    if target >= 0:
                        slot = DEGREE + int(sims_to[target, DEGREE:].argmin())
                        if sims_to[target, slot] < sim:
                            links[target, slot], sims_to[target, slot] = source, sim
            inside = int(new[-1]) + 1
        return links

    def _enter(self, queries: np.ndarray, place: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the place of the node at which a greedy walk through the layers built so far ends."""
        at, best = self._descend(queries, self.layers)
        spot = place[at]
        late = spot >= inside  # not inserted yet
        first = queries @ self.vectors[np.flatnonzero(place == 0)[0]]
        return np.where(late, 0, spot), np.where(late, first, best)

    def _descend(self, queries: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy walk through ``layers``: the node reached and its cosine."""
        vectors = self.vectors
        top = (layers or self.layers)[0][0][: 4 * DEGREE]
        at = top[(queries @ vectors[top].T).argmax(axis=1)]
        best = np.einsum("qd,qd->q", queries, vectors[at])
        for _, links in layers:
            moving = np.arange(len(queries))
            while len(moving):
                around = links[at[moving]]
                sims = np.where(around >= 0, np.einsum("qd,qkd->qk", queries[moving], vectors[around]), -2)
                k = sims.argmax(axis=1)
                value = sims[np.arange(len(moving)), k]
                better = value > best[moving]
                at[moving[better]], best[moving[better]] = around[better, k[better]], value[better]
                moving = moving[better]
        return at, best

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and cosines of the ``beam`` nearest found for each query; -1 and -2 fill up."""
        at, best = self._descend(queries, self.layers[:-1])
        return _beam(self.vectors, self.layers[-1][1], queries, at, best, beam)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of rows of unit vectors in double precision."""
    return np.clip(np.einsum("...d,...d->...", a, b), -1.0, 1.0)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt(np.einsum("nd,nd->n", raw, raw))[:, None]


def links_of(graph: Graph, members: np.ndarray, queries: np.ndarray, query_keys: np.ndarray, threshold: float):
    """Yields (query numbers, node numbers) of the pairs with cosine >= threshold that the graph finds, confirmed in double
    precision, until the recall audit passes: the audited queries' links are counted by a full scan, and if too few were
    found, the beam becomes WIDEN times as wide. A query whose beam holds nothing but links gets a wider one in any case;
    once a wider beam would hold a 16th of the shard, which costs more than reading it all, the query reads it all."""
    slack, n = threshold - 1e-4, len(members)
    audit = np.flatnonzero(pd.util.hash_array(query_keys) % AUDIT == 0)
    true = np.concatenate([(queries[audit[i : i + TOGETHER]] @ members.T >= threshold).sum(axis=1) for i in range(0, len(audit), TOGETHER)] or [np.zeros(0, int)])
    beam, left = BEAM, np.arange(len(queries))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while len(left) and (16 * beam < n or (beam == BEAM and n > BEAM)):
        full, audited = [], 0
        for i in range(0, len(left), TOGETHER):
            part = left[i : i + TOGETHER]
            ids, sims = graph.search(queries[part].astype(np.float32), beam)
            full.append(part[sims[:, -1] >= slack])
            q, k = np.nonzero(sims >= slack)
            node = ids[q, k]
            yes = _exact(queries[part[q]], members[node]) >= threshold
            found[int(part[0])] = (part[q[yes]], node[yes])
            audited += int(np.isin(part[q[yes]], audit).sum())
        wide = np.concatenate(full)
        asked = np.isin(audit, left) & ~np.isin(audit, wide)
        missed = int(true[asked].sum()) - sum(int((np.isin(q, audit) & ~np.isin(q, wide)).sum()) for q, _ in found.values())
        again = left if missed > (1 - RECALL) * max(1, int(true[asked].sum())) else wide
        for q, node in found.values():
            keep = ~np.isin(q, again)
            yield q[keep], node[keep]
        found.clear()
        left, beam = again, beam * WIDEN
    for i in range(0, len(left), TOGETHER):
        part = left[i : i + TOGETHER]
        q, node = np.nonzero(queries[part] @ members.T >= threshold)
        yield part[q], node


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"key": group["key"].iloc[:1].array, "shard": group["shard"].iloc[:1].array, "ids": [group["id"].to_numpy(np.int64).tobytes()], "raw": [np.stack(group["vector"].to_numpy()).astype("<f8").tobytes()]})


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, shard_rows: int = 16384) -> DataFrame:
    """Links vectors of one label whose cosine, in double precision, is at least ``threshold``.

    Returns (id, n_links, component_id, kept), one row for each row. Null labels, and vectors that are null, empty, zero or
    hold a null or non-finite component, link with nothing. Vectors of different lengths are kept apart. Ids are integers
    and meant to be unique. An empty table gives an empty result. Other columns are ignored.

    Each label is dealt by hashed id into shards of about ``shard_rows``, so a shard fits a task however large the label.
    Each shard's graph is searched with its own vectors and with those of every later shard of the label; see
    ``links_of`` for how beams widen. A task returns for each of its vectors the number of links and one link to its
    group, so a large group costs a row a vector; ``connected`` joins the groups of all tasks.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    good = rows.where(usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("key", F.concat_ws(":", F.size("vector"), F.col("label").cast("string")))
    counts = good.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = good.join(counts, "key").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    packed = checkpointed(dealt.select("key", "shard", "id", "vector").groupBy("key", "shard").applyInPandas(_packed, "key string, shard int, ids binary, raw binary"))
    kind = dict(rows.dtypes)["id"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        ids, other = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ids2"], np.int64)
        members = _unit(np.frombuffer(r["raw"], "<f8").reshape(len(ids), -1))
        same = r["shard"] == r["shard2"]
        queries = members if same else _unit(np.frombuffer(r["raw2"], "<f8").reshape(len(other), -1))
        graph = Graph(members.astype(np.float32), ids)
        every = ids if same else np.concatenate((ids, other))
        count, group_of = np.zeros(len(every), np.int64), np.arange(len(every))
        shift = 0 if same else len(ids)

        def root(i: int) -> int:
            while group_of[i] != i:
                group_of[i] = group_of[group_of[i]]
                i = group_of[i]
            return i

        for q, node in links_of(graph, members, queries, other, threshold):
            apart = other[q] != ids[node]
            q, node = q[apart], node[apart]
            np.add.at(count, q + shift, 1)
            if not same:
                np.add.at(count, node, 1)
            pairs = np.unique(np.stack((q + shift, node), axis=1), axis=0)
            pairs = pairs[group_of[pairs[:, 0]] != group_of[pairs[:, 1]]]
            for a, b in pairs:
                a, b = root(a), root(b)
                if a != b:
                    group_of[max(a, b)] = min(a, b)
        hit = np.flatnonzero(count)
        return pd.DataFrame({"id": every[hit], "n": count[hit], "to": every[[root(i) for i in hit]]})

    right = packed.select("key", F.col("shard").alias("shard2"), F.col("ids").alias("ids2"), F.col("raw").alias("raw2"))
    meet = packed.join(right, "key").where("shard <= shard2")
    found = checkpointed(meet.groupBy("key", "shard", "shard2").applyInPandas(compare, f"id {kind}, n bigint, to {kind}"))
    components = connected(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    n_links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    out = rows.select("id").join(n_links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))
