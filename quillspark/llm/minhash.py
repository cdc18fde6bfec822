"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, having, read, release, rows_a_batch, scope, sole_cache
from .grouping import linked, shared_bands

#: Signature: BANDS bands of ROWS values. A pair with similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the probability with which a pair at the threshold may be pruned.
BATCH, MISS = 16, 1e-6
_GROUP = 1 << 16


class _Words(dict):
    """64-bit hash of each word; emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 80_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_words = _Words()
_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the text with A-Z lower-cased; words are what white space
    in ASCII parts. Fewer words than n are one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([_words[x] for x in words], dtype=np.uint64)
    k = min(n, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        total += w[i : len(w) - k + 1 + i] * _PLACES[i]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES minima for each (non-empty) set; sets go through in groups that fit the cache."""
    out = np.empty((len(sets), HASHES), np.uint32)
    a, b = _hashes()
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= _GROUP):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[begin:end])
        starts = np.cumsum([0] + [len(s) for s in sets[begin : end - 1]])
        for i in range(HASHES):
            y = x * a[i]
            y += b[i]
            out[begin:end, i] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        begin = end
    return out


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, set_key, sig) of each row of (id, text); set_key is equal just for equal sets, null for none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("minhash", _words.clear)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                sets = [shingle_set(t, n) for t in part["text"]]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full))
                yield pd.DataFrame({
                    "id": part["id"].array, "n_shingles": [len(s) for s in sets],
                    "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sig": [next(sig).tobytes() if len(s) else None for s in sets],
                })

    return docs.mapInPandas(run, f"id {dict(docs.dtypes)['id']}, n_shingles bigint, set_key binary, sig binary")


@lru_cache(8)
def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For 0 to HASHES values compared, the fewest matches with which the posterior probability (uniform prior) of a
    similarity of ``threshold`` or more is at least ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            like = np.exp(log - log.max())
            if like[grid >= threshold].sum() / like.sum() >= miss:
                out[n] = m
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Which rows of signatures may be as similar as ``threshold``: batches are compared in turn and a pair is dropped as
    soon as its posterior falls below ``miss``."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    least = least_matches(threshold, miss)
    for i in range(0, HASHES, BATCH):
        matches[alive] += (a[alive, i : i + BATCH] == b[alive, i : i + BATCH]).sum(axis=1)
        alive = alive[matches[alive] >= least[i + BATCH]]
    return alive


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets: 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` that are links: pruned on signatures, then tested on the full sets."""

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sig = [np.frombuffer(b"".join(batch[c]), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
                yield batch.iloc[plausible(*sig, percent / 100)][["a", "b"]]

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yes = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch[["a", "b"]][np.array(yes, dtype=bool)]

    ab = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in ("a", "b"))
    left = pairs.join(signs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    survivors = checkpointed(left.join(signs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").mapInPandas(prune, ab))
    return (
        survivors.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        .select("a", "b", "set_a", "set_b")
        .mapInPandas(test, ab)
    )


def links_within(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all linked sets of a block: exact intersections by products of 0/1 matrices over the shingles that
    two sets or more have, some thousand columns at a time; of the links, a spanning forest."""
    sizes = np.array([len(s) for s in sets])
    shingles, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = many > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for begin in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (begin, begin + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], column[lo:hi] - begin] = 1
        both += part @ part.T
    linked_ = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    left, out = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                x = todo.pop()
                for y in np.flatnonzero(linked_[x] & left):
                    left[y] = False
                    todo.append(y)
                    out.append((nodes[x], nodes[y]))
    return out


def block_links(clusters: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) that join what belongs together in each cluster of rows (node, cluster). A cluster is dealt into blocks
    of about ``block`` nodes and each two blocks meet in one group, so a group is bounded and no pair becomes a row."""
    kind = dict(clusters.dtypes)["node"]
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = clusters.join(sizes, "cluster").join(sets, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = links_within(group["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in group["shingles"]], percent)
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("cluster", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * |shared shingles| >= percent * |all shingles| of the two.

    Returns (id, n_shingles, component_id, kept): component_id is the smallest id reachable over links, kept whether it is
    the id itself. Ids are integers and meant to be unique; rows that repeat an id are judged by their own text. Null and
    wordless texts have no shingles and stand alone. An empty table gives an empty result. Other columns are ignored.

    Each text gets its shingle set's key and MinHash signature. Equal sets are one class; its least id represents it, so
    copies, however many, take no further part. Classes that share a band meet as ``linked`` says. Candidate pairs go
    through sequential Bayesian pruning on signatures and an exact test on the full sets; large buckets of classes that
    are similar but not all linked are tested exactly in blocks.
    """
    with rows_a_batch(docs.sparkSession, 512), scope(docs.sparkSession) as tables:
        return tables.keep(_near_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col, n, percent))


def _near_duplicates(docs: DataFrame, id_col: str, n: int, percent: int) -> DataFrame:
    kind = dict(docs.dtypes)["id"]
    rows = checkpointed(sketches(docs, n))
    classes = rows.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("node"), F.first("sig").alias("sig"))
    classes = checkpointed(classes)
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * ROWS * 4 + 1, ROWS * 4)) for i in range(BANDS)])
    bands = checkpointed(shared_bands(classes.select("node", F.explode(keys).alias("band"))))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t, n).tobytes() for t in batch["text"]]})

    meeting = checkpointed(bands.select("node").distinct())
    sets = checkpointed(having(docs.select(F.col("id").alias("node"), "text"), meeting, ["node"]).mapInPandas(sets_of, f"node {kind}, shingles binary"))
    release(docs.sparkSession)
    signs = classes.select("node", "sig").join(meeting, "node", "left_semi")
    components = linked(bands, lambda pairs: verified(pairs, signs, sets, percent), lambda clusters: block_links(clusters, sets, percent))
    class_component = classes.select("set_key", "node").join(components, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("id", "n_shingles", "set_key").join(class_component, "set_key", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), n=4)
