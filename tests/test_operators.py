"""Small cases: access traces, fixed vectors, order independence, streams, sources."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing as H
from quillspark.functions import values as V
from quillspark.operators import merkle, sequence, state, stats


@pytest.mark.parametrize(
    "trace, want",
    [
        ([(0, "A", "B"), (1, "C", "D")], []),
        ([(0, "", "A"), (1, "A", "B")], [1]),
        ([(0, "A", "B"), (1, "", "A")], []),
        ([(0, "", "A"), (1, "", "A")], []),
        ([(0, "", "A"), (1, "B", "C"), (2, "A", "D")], [2]),
        ([(0, "", "A"), (1, "A", ""), (2, "A", "")], [1, 2]),
        ([(1, "A", ""), (0, "", "A")], [1]),
    ],
)
def test_conflicts(spark, trace, want):
    rows = [(t, rw, k) for t, r, w in trace for rw, keys in (("R", r), ("W", w)) for k in keys]
    got = sequence.raw_conflicts(spark.createDataFrame(rows, "tx long, rw string, key string")).collect()
    assert sorted(r.tx for r in got) == want


def test_chain(spark):
    entries = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3)]
    head = spark.createDataFrame([(entries,)], "e array<string>").select(H.chain(F.col("e"))).first()[0]
    assert head == "6aec805e8653a6839375608419efd881cc429805a8a7a0212efc90137548296d"


def test_domain(spark):
    got = spark.range(1).select(H.sha256_domain(b"\x00", F.unhex(F.lit("aa")))).first()[0]
    assert got == "d2c79d9973bfdaa70e406338d4f4b77e4941dbf90fa84bbbe6769808587528ad"


def plain_merkle(leaves, empty):
    """Levels of one tree, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1] + [empty] * (len(levels[-1]) % 2)
        levels.append([hashlib.sha256(b"\x01" + bytes.fromhex(x[i] + x[i + 1])).hexdigest() for i in range(0, len(x), 2)])
    return levels


def test_merkle_of_small_and_large_groups(spark):
    sizes, empty = {"a": 1, "b": 2, "c": 3, "d": 11, "e": 256, "f": 257, "g": 700}, "00" * 32
    hashes = {g: [hashlib.sha256(f"{g}{i}".encode()).hexdigest() for i in range(n)] for g, n in sizes.items()}
    rows = spark.createDataFrame([(g, 10 * i, h) for g, x in hashes.items() for i, h in enumerate(x)], "g string, seq long, leaf string")
    want = {g: plain_merkle(x, empty) for g, x in hashes.items()}
    assert {r.g: r.root for r in merkle.merkle_roots(rows, ["g"], ["seq"], "leaf", empty).collect()} == {g: x[-1][0] for g, x in want.items()}
    proofs = merkle.merkle_proofs(rows, ["g"], ["seq"], "leaf", empty)
    got = proofs.withColumn("led", merkle.verified_root(F.col("h"), F.col("siblings"))).collect()
    assert len(got) == sum(sizes.values())
    for r in got:
        levels = want[r.g]
        path = [(k, "left" if (r.i >> k) % 2 else "right", (levels[k] + [empty])[(r.i >> k) ^ 1]) for k in range(len(levels) - 1)]
        assert r.h == levels[0][r.i] and [tuple(s) for s in r.siblings] == path and r.root == r.led == levels[-1][0]


def test_merkle_shuffles_leaves_once(spark):
    """Trees of few leaves are built inside rows: a proof's plan has neither shuffles nor joins beyond the stored leaves."""
    rows = spark.range(1000).selectExpr("id div 10 g", "id seq", "sha2(cast(id as string), 256) leaf")
    plan = merkle.merkle_proofs(rows, ["g"], ["seq"], "leaf", "00" * 32)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def plain_trie(items, depth=0):
    """A trie by insertion of one key after another would have this root: defined on the sorted set."""
    h = lambda *x: hashlib.sha256(b"".join(x)).digest()
    if len(items) == 1:
        return h(b"\x00", items[0][0][depth:], items[0][1])
    at = depth
    while len({k[at] for k, _ in items}) == 1:
        at += 1
    groups = {n: list(g) for n, g in itertools.groupby(items, key=lambda x: x[0][at])}
    branch = h(b"\x01", *[plain_trie(groups[n], at + 1) if n in groups else bytes(32) for n in range(16)])
    return h(b"\x01", items[0][0][depth:at], branch) if at > depth else branch


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 400])
def test_trie_root(spark, n):
    pairs = [(hashlib.sha256(f"key-{i}".encode()).hexdigest(), hashlib.sha256(f"value-{i}".encode()).hexdigest()) for i in range(n)]
    items = sorted((bytes(int(c, 16) for c in k), bytes.fromhex(v)) for k, v in pairs)
    want = plain_trie(items).hex() if items else "00"
    for order in (pairs, pairs[::-1]):
        got = merkle.trie_root(spark.createDataFrame(order, "k string, v string"), "k", "v", "00").collect()
        assert [r.root for r in got] == [want]


def test_trie_shared_prefix(spark):
    keys = ["ab" + "0" * 62, "ab" + "0" * 61 + "1", "ab1" + "0" * 61]
    pairs = [(k, hashlib.sha256(k.encode()).hexdigest()) for k in keys]
    want = plain_trie(sorted((bytes(int(c, 16) for c in k), bytes.fromhex(v)) for k, v in pairs)).hex()
    rows = spark.createDataFrame(pairs, "k string, v string")
    assert merkle.trie_root(rows, "k", "v", "00").first().root == want
    assert merkle.trie_root(rows, "k", "v", "00", keys_a_group=1).first().root == want
    assert merkle.trie_root(rows, "k", "v", "00", keys_a_group=0.02).first().root == want  # several nibbles deep


def test_nonces_after_reject(spark):
    rows = [("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("a", 4, 3), ("a", 5, 3), ("b", 1, 2)]
    got = sequence.accepted_nonces(spark.createDataFrame(rows, "s string, at long, nonce long"), "s", ["at"], "nonce").collect()
    assert {(r.s, r["at"]): r.verdict for r in got} == {("a", 1): "ok", ("a", 2): "nonce_gap", ("a", 3): "ok", ("a", 4): "ok", ("a", 5): "nonce_low", ("b", 1): "nonce_gap"}


def test_range_scan(spark):
    kv = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value int")
    keys = lambda **k: [r.key for r in state.range_scan(kv, "key", **k).collect()]
    assert keys() == ["a", "b", "c"] and keys(limit=2) == ["a", "b"] and keys(reverse=True) == ["c", "b", "a"] and keys(gt="a", lte="c") == ["b", "c"]


def test_values(spark):
    row = spark.range(1).select(
        V.int_div(F.lit(-7), F.lit(2)).alias("q"), V.fixed_parse(F.lit("1.999"), 10, 2).alias("p"), V.fixed_mul(F.lit("-1.55").cast("decimal(10,2)"), F.lit("1.11").cast("decimal(10,2)"), 10, 2).alias("m"),
        V.truthy(F.lit(None).cast("int"), "int").alias("t"), V.equal(F.lit(None), F.lit(None), "int", "int").alias("e"), V.equal(F.lit(1), F.lit("1"), "int", "string").alias("x"),
    ).first()
    assert (int(row.q), str(row.p), str(row.m), row.t, row.e, row.x) == (-3, "1.99", "-1.72", False, True, False)


def test_percentiles(spark):
    d = spark.createDataFrame([("x", float(i)) for i in range(1, 101)], "g string, v double")
    r = stats.latency_stats(d, ["g"], "v").first()
    assert (r["count"], r.p50, r.p95, r.p99, r.min, r.max) == (100, 50.0, 95.0, 99.0, 1.0, 100.0)


def test_numbers_are_dense(spark):
    d = spark.range(1000).withColumn("day", F.col("id") % 7)
    got = sequence.numbered(d, F.col("day"), ["id"]).orderBy("day", "id").collect()
    assert [r.seq for r in got] == list(range(1, 1001))


def test_stream_equals_batch(spark, tmp_path):
    from quillspark.streaming.ingest import admit_stream

    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [("h1", "a", 1), ("h2", "a", 3), ("h3", "a", 2), ("h1", "a", 1), ("h4", "b", 1)]
    spark.createDataFrame([(h, s, n, i) for i, (h, s, n) in enumerate(rows)], "hash string, sender string, nonce long, at long").coalesce(1).write.json(source)
    admit_stream(spark, source, sink, check).awaitTermination(120)
    got = {(r.sender, r.nonce): r.verdict for r in spark.read.parquet(sink).collect()}
    assert got == {("a", 1): "ok", ("a", 3): "nonce_gap", ("a", 2): "ok", ("b", 1): "ok"}


def test_sources(spark, tmp_path):
    from quillspark.sources import files

    kv = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    files.save_snapshot(kv, str(tmp_path / "s"), 5)
    files.save_snapshot(kv.limit(1), str(tmp_path / "s"), 9)
    assert files.snapshot_heights(spark, str(tmp_path / "s")) == [5, 9]
    assert files.load_snapshot(spark, str(tmp_path / "s"), 7).count() == 2
    log = tmp_path / "audit.jsonl"
    log.write_text("\n".join([json.dumps({"type": "header", "version": 1}), json.dumps({"sequence": 1, "timestamp": 5, "transactions": [], "stateRoot": "r", "operatorSig": "s"}), json.dumps({"sequence": 3, "timestamp": 6, "transactions": [], "stateRoot": "q", "operatorSignature": "t"})]))
    bundle = files.audit_bundle(spark, str(log))
    assert [(r.sequence, r.signature) for r in bundle.orderBy("sequence").collect()] == [(1, "s"), (3, "t")]
    assert [tuple(r) for r in sequence.gaps(bundle.select(F.col("sequence").alias("seq"))).collect()] == [(1, 3)]
    wal = tmp_path / "log.wal"
    wal.write_bytes(b"".join(files.wal_record(*r) for r in [("P", b"k1", b"v1"), ("D", b"k1", b""), ("P", b"k2", b"v2")]) + b"\x01\x02torn")
    assert [(r.kind, bytes(r.key)) for r in files.read_wal(spark, str(wal)).orderBy("at").collect()] == [("P", b"k1"), ("D", b"k1"), ("P", b"k2")]


def test_rules(spark):
    from quillspark.plans.rules import Rule, apply_rules

    state_ = spark.createDataFrame([("x", 10), ("y", 1)], "key string, value long")
    calls = spark.createDataFrame([(1, "x", 3), (2, "y", 3), (3, "z", 3)], "seq long, key string, amount long")
    rule = Rule(let={"have": F.coalesce(F.col("state.value"), F.lit(0)), "left": F.col("have") - F.col("amount")}, require=[(F.col("have") > 0, "no account"), (F.col("left") >= 0, "too little")], set_value=F.col("left"), emit=F.struct("key", "left"))
    changes, events, rejects = apply_rules(calls, state_, rule, ["key"])
    assert [tuple(r) for r in changes.select("key", "value").collect()] == [("x", 7)]
    assert {(r.seq, r.reason) for r in rejects.collect()} == {(2, "too little"), (3, "no account")}
    assert events.count() == 1
