"""Commitments over ordered leaves: hash chains, binary Merkle trees, hex tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import chain
from ..sources.scratch import stored


def chain_heads(log: DataFrame, by: list[str], order: str, entry: Column) -> DataFrame:
    """Head of the hash chain of each group, in order. A chain is sequential, so it is kept per shard or block, and a group
    is one block's entries."""
    lists = log.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), entry.alias("h")))).alias("e"), F.count(F.lit(1)).alias("n"))
    return lists.select(*by, "n", chain(F.transform("e", lambda x: x["h"])).alias("head"))


#: Levels of a tree that are built inside a row, over at most 2^LEVELS of its nodes.
LEVELS = 8


def _bundles(level: DataFrame, by: list[str]) -> DataFrame:
    """(by, bundle, n, hashes): the nodes (by, i, h, n), n being those of the tree, 2^LEVELS neighbours a row, in order."""
    rows = level.groupBy(*by, F.shiftright("i", LEVELS).alias("bundle"), "n").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("e"))
    return rows.select(*by, "bundle", "n", F.transform("e", lambda x: x["h"]).alias("hashes"))


def _with_levels(bundles: DataFrame, empty: str) -> DataFrame:
    """Adds ``levels``: the bundle's nodes and those above them, H(01 || left || right) with ``empty`` for a missing right, as
    many levels as the tree has, LEVELS more than the first at most."""
    # level k has one above it if the tree has more than 2^k nodes
    more = f"filter(sequence(0, {LEVELS - 1}), k -> shiftleft(1L, k) < n)"
    one, none = "unhex('01')", f"unhex('{empty}')"
    parents = f"transform(sequence(0, cast((size(element_at(acc, -1)) - 1) div 2 as int)), p -> unhex(sha2(concat({one}, get(element_at(acc, -1), 2 * p), coalesce(get(element_at(acc, -1), 2 * p + 1), {none})), 256)))"
    return bundles.withColumn("levels", F.expr(f"aggregate({more}, array(hashes), (acc, k) -> array_append(acc, {parents}))"))


def _trees(leaves: DataFrame, by: list[str], order: list[str], leaf: str, empty: str) -> list[DataFrame]:
    """Stored bundles from those of the leaves up to those that hold a root; one table does for trees of up to 2^LEVELS leaves,
    each further one has the first nodes of the bundles below. So leaves are shuffled once, as bytes."""
    tree = Window.partitionBy(*by)
    level = leaves.select(*by, *order, F.unhex(leaf).alias("h")).withColumn("i", F.row_number().over(tree.orderBy(*order)).cast("long") - 1)
    out = [stored(_bundles(level.withColumn("n", F.count(F.lit(1)).over(tree)), by))]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while most > 1 << LEVELS:
        below = _with_levels(out[-1].where(F.col("n") > 1 << LEVELS), empty)
        above = below.select(*by, F.col("bundle").alias("i"), F.expr("element_at(levels, -1)[0]").alias("h"), F.expr(f"shiftright(n + {(1 << LEVELS) - 1}, {LEVELS})").alias("n"))
        out.append(stored(_bundles(above, by)))
        most = (most + (1 << LEVELS) - 1) >> LEVELS
    return out


def merkle_roots(leaves: DataFrame, by: list[str], order: list[str], leaf: str, empty: str) -> DataFrame:
    tops = [_with_levels(t.where(F.col("n") <= 1 << LEVELS), empty).select(*by, F.lower(F.hex(F.expr("element_at(levels, -1)[0]"))).alias("root")) for t in _trees(leaves, by, order, leaf, empty)]
    return reduce(DataFrame.unionByName, tops)


def merkle_proofs(leaves: DataFrame, by: list[str], order: list[str], leaf: str, empty: str) -> DataFrame:
    """(by, i, h, siblings array<struct<level, side, hash>>, root) for each leaf: the siblings from the leaf to the root, and
    the root."""
    above = None
    trees = _trees(leaves, by, order, leaf, empty)
    for k in reversed(range(len(trees))):
        other = f"coalesce(get(levels[l], cast(shiftright(p, l) ^ 1 as int)), unhex('{empty}'))"
        siblings = f"transform(slice(sequence(0, {LEVELS}), 1, size(levels) - 1), l -> struct(l + {k * LEVELS} as level, if(shiftright(p, l) % 2 = 0, 'right', 'left') as side, lower(hex({other})) as hash))"
        proofs = f"transform(hashes, (h, p) -> struct(bundle * {1 << LEVELS} + p as i, lower(hex(h)) as h, {siblings} as siblings, lower(hex(element_at(levels, -1)[0])) as root))"
        rows = _with_levels(trees[k], empty).select(*by, "n", F.explode(F.expr(proofs)).alias("x")).select(*by, "n", "x.*")
        if above is not None:
            whole, parts = rows.where(F.col("n") <= 1 << LEVELS), rows.where(F.col("n") > 1 << LEVELS).withColumn("__up", F.shiftright("i", LEVELS))
            parts = parts.join(above, [*by, "__up"])
            rows = whole.unionByName(parts.select(*by, "n", "i", "h", F.concat("siblings", "__siblings").alias("siblings"), F.col("__root").alias("root")))
        above = rows.select(*by, F.col("i").alias("__up"), F.col("siblings").alias("__siblings"), F.col("root").alias("__root"))
    return rows.drop("n")


def verified_root(leaf: Column, siblings: Column) -> Column:
    """The root that a proof leads to."""

    def up(h: Column, s: Column) -> Column:
        one, x, y = F.unhex(F.lit("01")), F.unhex(h), F.unhex(s["hash"])
        return F.sha2(F.when(s["side"] == "right", F.concat(one, x, y)).otherwise(F.concat(one, y, x)), 256)

    return F.aggregate(siblings, leaf, up)


def _h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


class _Node:
    """A trie node before it is hashed: the nibbles it may still hand up, and what stands below."""

    __slots__ = ("path", "value", "children")

    def __init__(self, path: bytes, value: bytes | None = None, children: list[bytes] | None = None):
        self.path, self.value, self.children = path, value, children

    def digest(self, zero: bytes) -> bytes:
        if self.children is None:
            return _h(b"\x00", self.path, self.value)
        branch = _h(b"\x01", *[c or zero for c in self.children])
        return _h(b"\x01", self.path, branch) if self.path else branch


def _trie(items: list[tuple[bytes, bytes]], depth: int, zero: bytes) -> _Node:
    """Node of distinct keys (as nibbles, in order) that agree on the first ``depth`` nibbles."""
    if len(items) == 1:
        return _Node(items[0][0][depth:], items[0][1])
    first, last, at = items[0][0], items[-1][0], depth
    while first[at] == last[at]:
        at += 1
    children: list[bytes] = [b""] * 16
    begin = 0
    while begin < len(items):
        end = begin
        while end < len(items) and items[end][0][at] == items[begin][0][at]:
            end += 1
        children[items[begin][0][at]] = _trie(items[begin:end], at + 1, zero).digest(zero)
        begin = end
    return _Node(first[depth:at], None, children)


def trie_root(state: DataFrame, key_hash: str, value_hash: str, empty: str, keys_a_group: int = 50_000) -> DataFrame:
    """One row (root): the commitment of a 16-ary path-compressed trie over 32-byte hex keys and hex value hashes. A leaf is
    H(00 || rest of the path || value hash), an extension H(01 || path || child), a branch H(01 || 16 children), nibbles
    one byte each, absent children 32 zero bytes. It depends on the final set of keys alone.

    Keys are grouped by as many first nibbles as bring a group to about ``keys_a_group``. Each group returns its node
    unhashed, as compression may cross the groups' border, and 16 nodes at a time are joined to the one above, a nibble
    a round.
    """
    zero = bytes(32)
    schema = "prefix string, path binary, value binary, children binary"

    def nib(text: str) -> bytes:
        return bytes(int(c, 16) for c in text)

    def row(prefix: str, node: _Node) -> pd.DataFrame:
        return pd.DataFrame({"prefix": [prefix], "path": [node.path], "value": [node.value], "children": [b"".join(c or zero for c in node.children) if node.children else None]})

    def group_node(group: pd.DataFrame) -> pd.DataFrame:
        items = sorted((nib(k), bytes.fromhex(v)) for k, v in zip(group["k"], group["v"], strict=True))
        prefix = group["prefix"].iloc[0]
        return row(prefix, _trie(items, len(prefix), zero))

    def joined(nodes: pd.DataFrame) -> _Node:
        below = [(int(p[-1], 16), _Node(path, value, None if c is None else [c[i : i + 32] for i in range(0, 512, 32)])) for p, path, value, c in zip(nodes["prefix"], nodes["path"], nodes["value"], nodes["children"], strict=True)]
        if len(below) == 1:
            n, node = below[0]
            return _Node(bytes([n]) + node.path, node.value, node.children)
        children: list[bytes] = [b""] * 16
        for n, node in below:
            children[n] = node.digest(zero)
        return _Node(b"", None, children)

    def up(nodes: pd.DataFrame) -> pd.DataFrame:
        return row(nodes["prefix"].iloc[0][:-1], joined(nodes))

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = [b for b in batches if len(b)]  # 16 rows at most
        if nodes:
            yield pd.DataFrame({"root": [joined(pd.concat(nodes)).digest(zero).hex()]})

    rows = stored(state.select(F.col(key_hash).alias("k"), F.col(value_hash).alias("v")))
    n, nibbles = rows.count(), 1
    if not n:
        return state.sparkSession.createDataFrame([(empty,)], "root string")
    while n > keys_a_group * 16**nibbles:
        nibbles += 1
    nodes = rows.withColumn("prefix", F.substring("k", 1, nibbles)).groupBy("prefix").applyInPandas(group_node, schema)
    for depth in range(nibbles - 1, 0, -1):
        nodes = nodes.groupBy(F.substring("prefix", 1, depth)).applyInPandas(up, schema)
    return nodes.coalesce(1).mapInPandas(top, "root string")
