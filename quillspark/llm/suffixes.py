"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, delete_folder, having, read, release, rows_a_batch, scratch_folder

#: Bytes of a removed string, and of the head by which suffixes are ordered and compared.
WINDOW, HEAD = 200, 40
#: Windows tested together before they are tested one by one.
STEP = 8
#: Runs in so many places are joined by broadcast, up to so many runs.
OFTEN, MOST_OFTEN = 1000, 1 << 18
_SPAN = WINDOW - HEAD + 1
_SEGMENT = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(23)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 61)) * 8 + 5
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = tuple(out)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of all substrings of a byte string, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray, tag: np.ndarray | int = 0) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + np.asarray(tag).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of the texts that lie in ``data`` up to the given ends.

    A window's anchor is the place in it whose HEAD bytes hash lowest (the first of equals), so equal windows have their
    anchors at the same place. Returns, for each run of windows with one anchor: text number, first and last window,
    anchor, head hash, and hash of all bytes of the run.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < WINDOW:
        return none
    hashes = Hashes(data)
    places = np.arange(n - HEAD + 1)
    heads = hashes.of(places, places + HEAD)
    least = (heads & ~_LOW) | places.astype(np.uint64)
    width = 1
    while width * 2 <= _SPAN:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[_SPAN - width : _SPAN - width + n - WINDOW + 1])
    anchor = (least & _LOW).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n - WINDOW + 1), side="right")
    windows = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= ends[np.minimum(text, len(ends) - 1)])
    if not len(windows):
        return none
    own = anchor[windows]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1) | (text[windows[1:]] != text[windows[:-1]])) + 1
    first, last = windows[np.concatenate(([0], cut))], windows[np.concatenate((cut - 1, [len(windows) - 1]))]
    at = anchor[first]
    return text[first], first, last, at, heads[at], hashes.of(first, last + WINDOW, (at - first) * 1024 + last - first)


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to about _SEGMENT bytes, a longer one in overlapping parts: bytes, ends, text numbers, begins in the text."""
    held, size = [], 0

    def joined():
        parts = [texts[i] for i in held]
        lengths = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths), np.array(held), np.zeros(len(held), np.int64)

    for i, data in enumerate(texts):
        if len(data) > _SEGMENT:
            for begin in range(0, len(data) - WINDOW + 1, _SEGMENT - WINDOW + 1):
                part = np.frombuffer(data, np.uint8)[begin : begin + _SEGMENT]
                yield part, np.array([len(part)]), np.array([i]), np.array([begin])
        elif len(data) >= WINDOW:
            held.append(i)
            size += len(data)
            if size >= _SEGMENT:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sparse_suffixes(texts: DataFrame) -> DataFrame:
    """(head, t1, t2, place, run) of each anchor of each row of (t1, t2, text). place packs the anchor's offset, how far
    before it its first window begins, and how far apart its first and last windows are (9 bits each)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                t1, t2 = part["t1"].to_numpy(), part["t2"].to_numpy()
                for data, ends, numbers, begins in _segments([t.encode("utf-8", "surrogatepass") for t in part["text"]]):
                    text, first, last, at, heads, runs = _anchors(data, ends)
                    shift = begins[text] - np.concatenate(([0], ends[:-1]))[text]
                    place = (at + shift) << 18 | (at - first) << 9 | (last - first)
                    yield pd.DataFrame({"head": _signed(heads), "t1": t1[numbers[text]], "t2": t2[numbers[text]], "place": place, "run": _signed(runs)})

    return texts.mapInPandas(run, "head long, t1 long, t2 long, place long, run long")


class LevelledIndex:
    """Suffix arrays of batches, in levels whose sizes double.

    A level is a table of heads in order, each with the least and greatest occurrence (x) it stands for, in buckets by
    head, so that tables meet without a shuffle. A new batch is sorted and merge-scanned against every level for heads
    that both have, and becomes a level of rank 0; before the next one comes, levels of one rank merge into one of the
    next. So a batch meets at most log2(batches) + 1 levels, and each suffix is rewritten at most log2(batches) times.
    """

    def __init__(self, spark):
        self.spark, self.name = spark, f"level_{uuid.uuid4().hex}"
        self.folder = f"{scratch_folder(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []
        self.repeated: list[DataFrame] = []
        self.made = 0

    def _write(self, heads: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        heads.write.bucketBy(self.buckets, "head").sortBy("head").option("path", f"{self.folder}/{table}").saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        delete_folder(self.spark, f"{self.folder}/{table}")

    def _settle(self) -> None:
        """Merges the last two levels while they have one rank."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            other = self.spark.table(b).select("head", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            both = self.spark.table(a).join(other, "head", "full").select("head", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))
            self.levels.append((rank + 1, self._write(both)))
            self._drop(a)
            self._drop(b)

    def add(self, suffixes: DataFrame) -> None:
        """Adds rows (head, x) and keeps the heads that occur at two places in the batch, or in it and a level."""
        self._settle()
        table = self._write(suffixes.groupBy("head").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
        batch = self.spark.table(table)
        found = batch.where("lo <> hi").select("head")
        for _, level in self.levels:
            other = self.spark.table(level).select("head", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            found = found.union(batch.join(other, "head").where("lo <> lo2 or hi <> hi2 or lo <> hi").select("head"))
        self.repeated.append(checkpointed(found.distinct()))
        self.levels.append((0, table))

    def close(self) -> DataFrame:
        """The heads found at two places or more; the levels are deleted."""
        out = self.repeated[0]
        for more in self.repeated[1:]:
            out = out.union(more)
        for _, table in self.levels:
            self._drop(table)
        delete_folder(self.spark, self.folder)
        return out.distinct()


def _two_places(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that occur at two places (x) or more."""
    return rows.groupBy(key).agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least <> most").select(key)


def _hashes_of(text: str) -> Hashes:
    return Hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))


def _step_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each listed anchor of a text, its windows in groups of STEP by distance from the anchor: hash of the bytes all
    windows of a group have (core) and of all their bytes (hull). A listed number is a place and a bit: whether the
    verdict is needed. spot packs the first own window, one less than their number (3 bits), whether they are the whole
    group, and the bit."""
    for batch in batches:
        out = []
        for t1, t2, text, listed in zip(batch["t1"], batch["t2"], batch["text"], batch["listed"], strict=True):
            hashes, listed = _hashes_of(text), np.asarray(listed, np.int64)
            needed, at = listed & 1, listed >> 19
            first = at - (listed >> 10 & 511)
            last = first + (listed >> 1 & 511)
            near, far = (at - last) // STEP, (at - first) // STEP
            many = far - near + 1
            which = np.repeat(np.arange(len(listed)), many)
            group = near[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            end = at[which] - group * STEP
            begin = end - STEP + 1
            lo, hi = np.maximum(begin, first[which]), np.minimum(end, last[which])
            whole = (lo == begin) & (hi == end)
            spot = lo << 5 | (hi - lo) << 2 | whole << 1 | needed[which]
            out.append((np.full(len(lo), t1), np.full(len(lo), t2), _signed(hashes.of(end, begin + WINDOW, group)), _signed(hashes.of(lo, hi + WINDOW, group + 4096)), spot))
        if out:
            yield pd.DataFrame(dict(zip(("t1", "t2", "core", "hull", "spot"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of the listed spots: its hash, and its offset with the bit."""
    for batch in batches:
        out = []
        for t1, t2, text, listed in zip(batch["t1"], batch["t2"], batch["text"], batch["listed"], strict=True):
            hashes, listed = _hashes_of(text), np.asarray(listed, np.int64)
            many = (listed >> 2 & 7) + 1
            at = np.repeat(listed >> 5, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append((np.full(len(at), t1), np.full(len(at), t2), _signed(hashes.of(at, at + WINDOW)), at << 1 | np.repeat(listed & 1, many)))
        if out:
            yield pd.DataFrame(dict(zip(("t1", "t2", "window", "spot"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text without its listed spans: a span packs its first window and how far off its last one is (9 bits)."""
    for batch in batches:
        rows = []
        for t1, t2, text, listed in zip(batch["t1"], batch["t2"], batch["text"], batch["listed"], strict=True):
            data, listed = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), np.asarray(listed, np.int64)
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, listed >> 9, 1)
            np.add.at(change, (listed >> 9) + (listed & 511) + WINDOW, -1)
            gone = np.cumsum(change)[:-1] > 0
            n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            rows.append((t1, t2, int(gone.sum()), n_spans, data[~gone].tobytes()))
        yield pd.DataFrame(rows, columns=["t1", "t2", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, batches: int = 4, keep_bytes: bool = True) -> tuple[DataFrame, DataFrame]:
    """From rows (id, text): the distinct texts (t1, t2, n_copies, rep), and (t1, t2, n_removed, n_spans, kept_sha256[,
    kept]) of those that lose bytes to strings which stand elsewhere in the distinct texts. Two 64-bit hashes name a text.
    Tables between the steps are Parquet in the shared folder, deleted when no step needs them any more."""
    spark = docs.sparkSession
    named = docs.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("rep"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).where("text is not null")
    names = checkpointed(named.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_copies"), F.min("rep").alias("rep")))
    folder = f"{scratch_folder(spark)}/suffixes-{uuid.uuid4().hex}"
    sparse_suffixes(named.select("t1", "t2", "text")).withColumn("batch", F.pmod("t2", F.lit(batches))).write.partitionBy("batch").parquet(f"{folder}/all")
    everything = spark.read.schema("head long, t1 long, t2 long, place long, run long, batch long").parquet(f"{folder}/all")

    def table(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        release(spark)
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    index = LevelledIndex(spark)
    for batch in range(batches):
        index.add(everything.where(F.col("batch") == batch).select("head", F.xxhash64("t1", "t2", "place").alias("x")))
        release(spark)
    suffixes = table(having(everything.drop("batch"), index.close(), ["head"], most=1 << 21), "repeated")
    delete_folder(spark, f"{folder}/all")
    suffixes = suffixes.withColumn("x", F.xxhash64("t1", "t2", "place"))

    def with_list(rows: DataFrame, listed: Column) -> DataFrame:
        """(t1, t2, text, listed): a text and the numbers its rows give, once each."""
        lists = checkpointed(rows.groupBy("t1", "t2").agg(F.collect_set(listed).alias("listed")).join(names, ["t1", "t2"]).select("t1", "t2", "rep", "listed"))
        texts = having(named, lists, ["t1", "t2", "rep"])
        return texts.join(lists, ["t1", "t2", "rep"]).select("t1", "t2", "text", "listed")

    # runs of windows whose bytes stand elsewhere as a whole are settled; one of each kind stays as a witness for others
    kinds = suffixes.groupBy("run").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("n"))
    kinds = checkpointed(kinds.where("n > 1"))
    often = kinds.where(F.col("n") >= OFTEN)
    if often.count() <= MOST_OFTEN:  # no task gets all places of a very common run
        often, rest = F.broadcast(often), kinds.where(F.col("n") < OFTEN)
        kept = suffixes.join(often, "run").unionByName(suffixes.join(often, "run", "left_anti").join(rest, "run", "left"), allowMissingColumns=True)
    else:
        kept = suffixes.join(kinds, "run", "left")
    settled, witness = F.coalesce(F.col("least") != F.col("most"), F.lit(False)), F.coalesce(F.col("x") == F.col("least"), F.lit(True))
    suffixes = table(kept.select("head", "t1", "t2", "place", settled.alias("settled"), witness.alias("witness")), "runs")
    delete_folder(spark, f"{folder}/repeated")
    todo = having(suffixes.where("not settled or witness"), suffixes.where("not settled"), ["head"], most=1 << 21)
    spans = suffixes.where("settled").select("t1", "t2", F.expr("((place >> 18) - (place >> 9 & 511)) << 9 | place & 511").alias("span"))

    steps = with_list(todo, F.expr("place << 1 | if(settled, 0L, 1L)")).mapInPandas(_step_rows, "t1 long, t2 long, core long, hull long, spot long")
    steps = table(steps, "steps").withColumn("x", F.xxhash64("t1", "t2", "core", F.expr("spot >> 5")))
    steps = steps.join(_two_places(steps, "core"), "core", "left_semi")
    hulls = steps.where("spot & 2 = 2").groupBy("hull").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    steps = steps.join(hulls, "hull", "left").withColumn("settled", F.expr("coalesce(spot & 2 = 2 and least <> most, false)"))
    steps = table(steps.select("core", "t1", "t2", "spot", "settled", F.expr("coalesce(x = least, false)").alias("witness")), "settled")
    delete_folder(spark, f"{folder}/steps")
    spans = spans.union(steps.where("settled and spot & 1 = 1").select("t1", "t2", F.expr("(spot >> 5) << 9 | spot >> 2 & 7")))
    todo = having(steps.where("not settled or witness"), steps.where("not settled and spot & 1 = 1"), ["core"], most=1 << 21)
    windows = with_list(todo, F.expr("if(settled, spot >> 1 << 1, spot)")).mapInPandas(_window_rows, "t1 long, t2 long, window long, spot long")
    windows = table(windows, "windows").withColumn("x", F.xxhash64("t1", "t2", F.expr("spot >> 1")))
    single = windows.where("spot & 1 = 1").join(_two_places(windows, "window"), "window", "left_semi")
    spans = spans.union(single.select("t1", "t2", F.expr("(spot >> 1) << 9")))
    cut = with_list(spans, F.col("span")).mapInPandas(_cut_rows, "t1 long, t2 long, n_removed long, n_spans long, kept binary")
    cut = checkpointed(cut.select("t1", "t2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *["kept"] * keep_bytes))
    delete_folder(spark, folder)
    return names, cut.dropDuplicates(["t1", "t2"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, keep_bytes: bool = True) -> DataFrame:
    """Takes out every byte covered by a string of WINDOW bytes (UTF-8) that also starts anywhere else in the table.

    Returns (id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]), one row for each row of ``docs``. Strings are
    judged on the input; matches do not cross documents and may overlap. Null text counts as empty, and repeated rows are
    documents of their own, so they take each other out if long enough. An empty table gives an empty result. Other
    columns are ignored.

    1. Suffixes are indexed at anchors only: the place with the lowest hash of HEAD bytes in each window. Batches of
       texts go through ``LevelledIndex``, which finds the heads that repeat.
    2. At repeated heads, runs of windows, then groups of STEP, then single windows are compared by hashes of all their
       bytes; each step keeps what is still open, and one witness of what is settled. All of it is grouped counts with
       partial sums and equi-joins, so a string in a third of all documents makes no large task.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with rows_a_batch(docs.sparkSession, 1024):
        names, cut = repeated_spans(docs, batches, keep_bytes)
    rows = docs.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__own"), *([F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("__bytes")] * keep_bytes))
    rows = rows.join(names.where("n_copies > 1").select("t1", "t2", F.lit(True).alias("__copied")), ["t1", "t2"], "left").join(cut, ["t1", "t2"], "left")
    whole = F.coalesce(F.col("__copied"), F.lit(False)) & (F.col("n_bytes") >= WINDOW)
    out = [
        F.col("id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "__own")).alias("kept_sha256"),
    ]
    if keep_bytes:
        out.append(F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "__bytes")).alias("kept"))
    return rows.select(*out)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), keep_bytes=False)
