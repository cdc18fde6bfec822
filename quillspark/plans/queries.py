"""One query for each ledger operator, on the relations, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import values as V
from ..operators import consensus, merkle, sequence, state, stats
from ..sources.scratch import stored
from . import relations as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; the SQL may use the relations by name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = f"with recursive {R.CTE.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return f

    return add


def _state(s, d, as_of=None):
    return state.fold(R.changes(s, d), ["entity", "key"], R.ORDER, as_of=as_of)


def _early(s, d):
    """State at an earlier point in time."""
    return _state(s, d, F.col("ts") < F.lit(R.EARLY).cast("timestamp_ntz"))


def _versions(s, d):
    """Both states of each key, from one fold."""
    return state.fold_twice(R.changes(s, d), ["entity", "key"], R.ORDER, F.col("ts") < F.lit(R.EARLY).cast("timestamp_ntz"))


# ---- state and scans


@query("select * from state")
def state_fold_lww(s, d):
    return _state(s, d)


@query("select entity, key, value, seq as last_seq from (select *, row_number() over (partition by key, entity order by seq desc, line desc, supp desc, price desc) as rn from changes where seq <= 500) where rn = 1 and op = 'set'")
def state_as_of_version(s, d):
    return _state(s, d, F.col("seq") <= 500)


@query("select * from state where key = 42")
def state_point_lookup(s, d):
    return _state(s, d).where("key = 42")


@query("select * from state where key > 10 and key <= 60 order by key")
def state_range_scan(s, d):
    return state.range_scan(_state(s, d), "key", gt=10, lte=60)


@query("select * from state where key < 90 order by key desc limit 20")
def state_range_scan_reverse_limit(s, d):
    return state.range_scan(_state(s, d), "key", lt=90, reverse=True, limit=20)


@query("select p_brand as namespace, count(*) as n from state join part on key = p_partkey group by 1")
def state_size_by_entity(s, d):
    return _state(s, d).join(R.table(s, d, "part"), F.col("key") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


@query("select key, value from state join part on key = p_partkey where p_brand = (select min(p_brand) from part)")
def namespace_scan(s, d):
    p = R.table(s, d, "part")
    first = p.agg(F.min("p_brand").alias("p_brand"))
    return _state(s, d).join(p.join(F.broadcast(first), "p_brand"), F.col("key") == F.col("p_partkey")).select("key", "value")


OVER = "+ over as (select key, value + 1 as value, key % 5 = 0 as deleted from state_early where key % 3 = 0)"


@query(OVER + " select key, value from over where not deleted union all select key, value from state where key not in (select key from over)")
def overlay_merge_scan(s, d):
    top = _early(s, d).where("key % 3 = 0").select("key", (F.col("value") + 1).alias("value"), (F.col("key") % 5 == 0).alias("deleted"))
    return state.overlay(top, _state(s, d).select("key", "value"), ["key"])


DIFF = "+ diff as (select coalesce(a.key, b.key) as key, case when b.key is null then 'delete' else 'set' end as op, b.value as value from state_early a full join state b on a.key = b.key where a.key is null or b.key is null or a.value is distinct from b.value)"


@query(DIFF + " select * from diff")
def state_diff(s, d):
    return state.changed(_versions(s, d), ["key"])


@query("select key, value from state")
def apply_diff(s, d):
    both = stored(_versions(s, d))  # read twice
    return state.apply_diff(state.version_of(both, ["key"], "old"), state.changed(both, ["key"]), ["key"])


@query("select key from state_early except select key from state")
def deleted_keys_except(s, d):
    return _early(s, d).select("key").subtract(_state(s, d).select("key"))


@query(DIFF + " select key, value from diff where op = 'set'")
def upserted_keys(s, d):
    return state.changed(_versions(s, d), ["key"]).where("op = 'set'").select("key", "value")


@query("select l_orderkey as o, l_linenumber as n, l_suppkey as supp, l_extendedprice as price, value from lineitem left join state on l_partkey = key")
def state_get_left_join(s, d):
    l = R.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("key"))
    return state.lookup(l, _state(s, d).select("key", "value"), ["key"]).drop("key")


@query("select p_partkey as key from part where p_partkey in (select key from state)")
def state_exists_semi(s, d):
    return state.existing(R.table(s, d, "part").select(F.col("p_partkey").alias("key")), _state(s, d), ["key"])


@query("select p_partkey as key from part where p_partkey not in (select key from state)")
def state_not_exists_anti(s, d):
    return state.existing(R.table(s, d, "part").select(F.col("p_partkey").alias("key")), _state(s, d), ["key"], False)


@query("select key, max(last_seq) as last_seq from (select key, last_seq from state_early union all select key, last_seq from state) group by key having count(*) = 1")
def orphan_prune_anti(s, d):
    a, b = _early(s, d).select("key", "last_seq"), _state(s, d).select("key", "last_seq")
    return a.join(b, "key", "left_anti").union(b.join(a, "key", "left_anti"))


# ---- commits and snapshots


@query("select height, root, n from commits where height between 10 and 30")
def commit_range(s, d):
    return R.commits(s, d).where("height between 10 and 30").select("height", "root", "n")


@query("select height, root from commits order by height desc limit 1")
def commit_latest(s, d):
    return R.commits(s, d).agg(F.max(F.struct("height", "root")).alias("c")).select("c.*")


@query("select height, prev_root from (select *, coalesce(lag(root) over (order by height), repeat('0', 64)) as want from commits) where prev_root <> want")
def commit_chain_verify(s, d):
    c = R.commits(s, d)
    above = c.select((F.col("height") + 1).alias("height"), F.col("root").alias("want"))
    return c.join(above, "height", "left").where(F.col("prev_root") != F.coalesce("want", F.lit(H.ZERO32))).select("height", "prev_root")


@query("select c.height, max(s.height) as snapshot from commits c left join (select height from commits where height % 25 = 5) s on s.height <= c.height group by c.height")
def snapshot_as_of(s, d):
    c = R.commits(s, d).select("height")
    return state.as_of(c, c.where("height % 25 = 5").withColumnRenamed("height", "snapshot"), "height", "snapshot", width=100)


@query("select height from (select height, row_number() over (order by height desc) as rn from commits where height % 25 = 5) where rn > 3")
def snapshot_prune(s, d):
    snaps = R.commits(s, d).select("height").where("height % 25 = 5")
    keep = snaps.orderBy(F.desc("height")).limit(3)
    return snaps.join(F.broadcast(keep), "height", "left_anti")


# ---- expressions


@query("select o_orderkey as k, cents + 7 as plus, cents - 1000000 as minus, cents * 3 as times, -cents as neg from tx")
def expr_arithmetic(s, d):
    c = F.col("cents")
    return R.tx(s, d).select(F.col("o_orderkey").alias("k"), (c + 7).alias("plus"), (c - 1000000).alias("minus"), (c * 3).alias("times"), (-c).alias("neg"))


@query("select o_orderkey as k, (cents - 15000000) // 7 as q, (cents - 15000000) % 7 as r from tx")
def expr_div_mod(s, d):
    return R.tx(s, d).select(F.col("o_orderkey").alias("k"), F.expr("(cents - 15000000) div 7").alias("q"), F.expr("(cents - 15000000) % 7").alias("r"))


@query("select coalesce(a.key, b.key) as key, a.value is not distinct from b.value as same from state_early a full join state b on a.key = b.key")
def expr_null_safe_eq(s, d):
    a, b = _early(s, d).select("key", F.col("value").alias("x")), _state(s, d).select("key", F.col("value").alias("y"))
    return a.join(b, "key", "full").select("key", V.equal(F.col("x"), F.col("y"), "int", "int").alias("same"))


@query("select seq, cents from tx where cents >= 20000000 and cents < 30000000 and seq <> 7")
def filter_comparison(s, d):
    return R.tx(s, d).where((F.col("cents") >= 20000000) & (F.col("cents") < 30000000) & (F.col("seq") != 7)).select("seq", "cents")


@query("select event_id from emitted where (coalesce(value <> 0, false) and not coalesce(length(name) > 5, false)) or coalesce(user_id % 2 <> 0, false)")
def filter_boolean_logic(s, d):
    e = R.emitted(s, d)
    long_name = F.when(F.length("name") > 5, F.col("name")).otherwise("")
    return e.where((V.truthy(F.col("value"), "int") & ~V.truthy(long_name, "string")) | V.truthy(F.col("user_id") % 2, "int")).select("event_id")


@query("select seq, case when cents > 30000000 then 'large' when cents > 10000000 then 'medium' else 'small' end as size from tx")
def expr_case_when(s, d):
    c = F.col("cents")
    return R.tx(s, d).select("seq", F.when(c > 30000000, "large").when(c > 10000000, "medium").otherwise("small").alias("size"))


@query("select l_orderkey as o, cast(sum(cast(round(l_quantity) as bigint) * 2 + 1) as bigint) as folded, count(*) as n from lineitem group by 1")
def list_for_each_fold(s, d):
    lists = R.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list(F.round("l_quantity").cast("long")).alias("xs"))
    return lists.select("o", F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x * 2 + 1).alias("folded"), F.size("xs").cast("long").alias("n"))


@query("+ r(k, x, i) as (select o_orderkey, o_orderkey, 0 from orders union all select k, case when x % 2 = 0 then x // 2 else 3 * x + 1 end, i + 1 from r where x > 1 and i < 40) select k, max(i) as steps from r group by k")
def while_bounded(s, d):
    start = F.struct(F.col("o_orderkey").alias("x"), F.lit(0).alias("i"))
    step = lambda a: F.struct(F.when(a["x"] % 2 == 0, F.floor(a["x"] / 2)).otherwise(a["x"] * 3 + 1).cast("long").alias("x"), (a["i"] + 1).alias("i"))
    rows = R.table(s, d, "orders")
    return rows.select(F.col("o_orderkey").alias("k"), V.bounded_while(start, step, lambda a: a["x"] > 1, 40)["i"].alias("steps"))


@query("select seq, sender, cents + 1 as amount, nonce from tx")
def struct_project_update(s, d):
    account = F.struct("sender", F.col("cents").alias("amount"), "nonce")
    return R.tx(s, d).select("seq", account.alias("a")).withColumn("a", F.col("a").withField("amount", F.col("a.amount") + 1)).select("seq", "a.*")


REASON = "case when cents < 1000000 then 'too_small' when st = 'P' then 'pending' when priority like '5%' then 'low_priority' end"


def _reasons(s, d):
    reason = F.when(F.col("cents") < 1000000, "too_small").when(F.col("st") == "P", "pending").when(F.col("priority").startswith("5"), "low_priority")
    return R.tx(s, d).withColumn("reason", reason)


@query(f"select seq, tx_id from tx where ({REASON}) is null")
def require_accept(s, d):
    return _reasons(s, d).where("reason is null").select("seq", "tx_id")


@query(f"select seq, {REASON} as reason from tx where ({REASON}) is not null")
def require_reject_reasons(s, d):
    return _reasons(s, d).where("reason is not null").select("seq", "reason")


@query(f"select coalesce({REASON}, 'ok') as reason, count(*) as n from tx group by 1")
def reject_reason_counts(s, d):
    return _reasons(s, d).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("select sender, cast(sum(cents) as bigint) as total from tx group by sender having sum(cents) >= 100000000")
def ensure_postcondition(s, d):
    return R.tx(s, d).groupBy("sender").agg(F.sum("cents").alias("total")).where("total >= 100000000")


@query("select event_id, value from emitted where name = 'purchase'")
def events_by_name(s, d):
    return R.emitted(s, d).where("name = 'purchase'").select("event_id", "value")


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as ordinal from emitted")
def event_ordinal(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return R.emitted(s, d).select("event_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


# ---- log, receipts, nonces


@query("select seq, tx_id, sender, nonce from tx")
def sequence_assign(s, d):
    return R.tx(s, d).select("seq", "tx_id", "sender", "nonce")


@query("select t.tx_id, t.seq, r.status from tx t join receipts r using (seq)")
def receipt_by_txid(s, d):
    return R.tx(s, d).join(R.receipts(s, d), "seq").select("tx_id", "seq", "status")


@query("select t.seq, t.payload, r.status from tx t join receipts r using (seq) where t.seq % 11 <> 0")
def replay_log_receipts(s, d):
    return R.tx(s, d).join(R.receipts(s, d).where("seq % 11 <> 0"), "seq").select("seq", "payload", "status")


@query("select seq from tx where seq % 11 = 0")
def replay_missing_receipts(s, d):
    return R.tx(s, d).select("seq").join(R.receipts(s, d).where("seq % 11 <> 0"), "seq", "left_anti")


@query("select key, value, seq as last_seq from (select c.*, row_number() over (partition by key order by seq desc, line desc, supp desc, price desc) as rn from changes c join receipts using (seq) where status = 0) where rn = 1 and op = 'set'")
def replay_state_ok_only(s, d):
    ok = R.changes(s, d).join(R.receipts(s, d).where("status = 0"), "seq")
    return state.fold(ok, ["key"], R.ORDER)


@query("select seq, tx_id from tx where seq between 100 and 200")
def log_seq_range(s, d):
    return R.tx(s, d).where("seq between 100 and 200").select("seq", "tx_id")


@query("select min(seq) as seq from tx where st = 'P'")
def next_pending(s, d):
    return R.tx(s, d).where("st = 'P'").agg(F.min("seq").alias("seq"))


@query("select (seq - 1) // 1000 as batch, count(*) as n, min(seq) as first, max(seq) as last from tx group by 1")
def sequencer_batches(s, d):
    return R.tx(s, d).groupBy(F.expr("(seq - 1) div 1000").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("select prev as after, seq as before from (select lag(seq) over (order by seq) as prev, seq from (select seq from tx where seq % 13 > 1 union all select 0)) where seq - prev > 1")
def sequence_gaps(s, d):
    return sequence.gaps(R.tx(s, d).where("seq % 13 > 1").select("seq"))


@query("select seq, (select max(seq) from tx) - seq >= 6 as confirmed from tx")
def confirmation_depth(s, d):
    t = R.tx(s, d).select("seq")
    return t.crossJoin(F.broadcast(t.agg(F.max("seq").alias("top")))).select("seq", (F.col("top") - F.col("seq") >= 6).alias("confirmed"))


@query("select count(*) filter (where st = 'F') as finalized, count(*) filter (where st = 'O') as sequenced, count(*) filter (where st = 'P') as pending from tx")
def finality_counts(s, d):
    return R.tx(s, d).agg(*[F.count(F.when(F.col("st") == c, 1)).alias(n) for c, n in (("F", "finalized"), ("O", "sequenced"), ("P", "pending"))])


#: Nonces as they arrive: some are repeated, some skip.
OFFERED = "+ offered as (select o_orderkey, sender, seq, nonce, case when o_orderkey % 17 = 0 then nonce - 1 when o_orderkey % 19 = 0 then nonce + 5 else nonce end as claimed from tx), ordered as (select *, row_number() over (partition by sender order by seq) as i from offered), fold(sender, i, o_orderkey, current, verdict) as (select sender, i, o_orderkey, case when claimed = 1 then 1 else 0 end::bigint, case when claimed = 1 then 'ok' when claimed <= 0 then 'nonce_low' else 'nonce_gap' end from ordered where i = 1 union all select o.sender, o.i, o.o_orderkey, case when o.claimed = f.current + 1 then o.claimed else f.current end, case when o.claimed = f.current + 1 then 'ok' when o.claimed <= f.current then 'nonce_low' else 'nonce_gap' end from fold f join ordered o on o.sender = f.sender and o.i = f.i + 1)"


def _offered(s, d):
    k = F.col("o_orderkey")
    claimed = F.when(k % 17 == 0, F.col("nonce") - 1).when(k % 19 == 0, F.col("nonce") + 5).otherwise(F.col("nonce"))
    rows = R.tx(s, d).select("o_orderkey", "sender", "seq", claimed.alias("claimed"))
    return sequence.accepted_nonces(rows, "sender", ["seq"], "claimed")


@query(OFFERED + " select o_orderkey, sender from fold where verdict = 'ok'")
def nonce_accept(s, d):
    return _offered(s, d).where("verdict = 'ok'").select("o_orderkey", "sender")


@query(OFFERED + " select o_orderkey, verdict from fold where verdict <> 'ok'")
def nonce_reject_reasons(s, d):
    return _offered(s, d).where("verdict <> 'ok'").select("o_orderkey", "verdict")


ADMIT = "case when length(payload) > 9 then 'size' when o_orderkey % 29 = 0 then 'hash' when o_orderkey % 31 = 0 then 'chain' when o_orderkey % 37 = 0 then 'signature' end"


@query(OFFERED + f" select f.o_orderkey, coalesce({ADMIT}, case when verdict = 'ok' then 'accepted' else verdict end) as result from fold f join tx using (o_orderkey)")
def admission_reasons(s, d):
    """Checks in order of precedence; the first that fails names the reason."""
    k = F.col("o_orderkey")
    static = F.when(F.length("payload") > 9, "size").when(k % 29 == 0, "hash").when(k % 31 == 0, "chain").when(k % 37 == 0, "signature")
    verdict = F.when(F.col("verdict") == "ok", "accepted").otherwise(F.col("verdict"))
    return _offered(s, d).join(R.tx(s, d).select("o_orderkey", "payload"), "o_orderkey").select("o_orderkey", F.coalesce(static, verdict).alias("result"))


@query("select h, first_seq from (select sha256(o_orderpriority || cast(o_orderdate as date)) as h, min(seq) as first_seq from orders join tx using (o_orderkey) group by 1)")
def dedup_by_hash(s, d):
    t = R.tx(s, d).select("seq", H.sha256(H.as_bytes(F.concat(F.col("priority"), F.to_date("ts").cast("string")))).alias("h"))
    return t.groupBy("h").agg(F.min("seq").alias("first_seq"))


# ---- conflicts


@query("select tx from conflicts")
def raw_conflicts(s, d):
    return sequence.raw_conflicts(R.accesses(s, d))


@query("select distinct tx, coalesce(tx < (select min(tx) from conflicts), true) as committed from accesses")
def optimistic_prefix(s, d):
    return sequence.optimistic_prefix(R.accesses(s, d))


@query("select (select count(distinct tx) from accesses) as transactions, (select count(*) from conflicts) as conflicts, (select count(distinct tx) from accesses where coalesce(tx < (select min(tx) from conflicts), true)) as first_round, case when (select count(*) from conflicts) > 0 then 2 else 1 end as rounds")
def parallel_round_stats(s, d):
    return sequence.round_stats(R.accesses(s, d))


@query("select tx, count(*) filter (where rw = 'R') as reads, count(*) filter (where rw = 'W') as writes from accesses group by tx")
def access_sets(s, d):
    return R.accesses(s, d).groupBy("tx").agg(F.count(F.when(F.col("rw") == "R", 1)).alias("reads"), F.count(F.when(F.col("rw") == "W", 1)).alias("writes"))


# ---- gas

#: The cost of each operation.
GAS = {
    "PUSH": 1, "POP": 1, "DUP": 1, "SWAP": 1, "LOAD": 2, "STORE": 2, "ADD": 3, "SUB": 3, "MUL": 5, "DIV": 5, "MOD": 5, "NEG": 2,
    "EQ": 2, "NEQ": 2, "LT": 2, "LTE": 2, "GT": 2, "GTE": 2, "AND": 2, "OR": 2, "NOT": 2, "JMP": 5, "JMP_IF": 5, "JMP_IF_NOT": 5, "CALL": 50, "RET": 5,
    "STATE_GET": 100, "STATE_SET": 500, "STATE_DEL": 200, "STATE_EXISTS": 50, "CTX_CALLER": 5, "CTX_BLOCK": 5, "CTX_THIS": 5,
    "LIST_NEW": 10, "LIST_GET": 5, "LIST_SET": 10, "LIST_LEN": 2, "LIST_PUSH": 10, "MAP_NEW": 10, "MAP_GET": 10, "MAP_SET": 20, "MAP_DEL": 10, "MAP_HAS": 5,
    "MEMBER_GET": 5, "MEMBER_SET": 10, "REQUIRE": 10, "ENSURE": 10, "EMIT": 50, "HASH": 20, "STRUCT_NEW": 30, "NOP": 0, "HALT": 0,
}
OPS = "+ ops as (select user_id, ts, event_id, case name when 'click' then 'ADD' when 'view' then 'STATE_GET' when 'purchase' then 'STATE_SET' when 'signup' then 'EMIT' else 'OTHER' end as opcode from emitted), costs as (select *, case opcode when 'ADD' then 3 when 'STATE_GET' then 100 when 'STATE_SET' then 500 when 'EMIT' then 50 else 1 end as cost from ops)"


def _costs(s, d):
    names = F.create_map(*[F.lit(x) for p in {"click": "ADD", "view": "STATE_GET", "purchase": "STATE_SET", "signup": "EMIT"}.items() for x in p])
    costs = F.create_map(*[F.lit(x) for p in GAS.items() for x in p])
    e = R.emitted(s, d).select("user_id", "ts", "event_id", F.coalesce(names[F.col("name")], F.lit("OTHER")).alias("opcode"))
    return e.withColumn("cost", F.coalesce(costs[F.col("opcode")], F.lit(1)))


@query(OPS + " select user_id, cast(sum(cost) as bigint) as gas from costs group by user_id")
def gas_total(s, d):
    return _costs(s, d).groupBy("user_id").agg(F.sum("cost").alias("gas"))


@query(OPS + " select user_id, event_id, cast(used as bigint) as used from (select *, sum(cost) over (partition by user_id order by ts, event_id) as used from costs) where used <= 2000")
def gas_cutoff(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _costs(s, d).withColumn("used", F.sum("cost").over(w)).where("used <= 2000").select("user_id", "event_id", "used")


# ---- consensus


@query("+ total as (select sum(power) * 2 // 3 + 1 as needed from validators) select block, cast(sum(power) as bigint) as power, cast(any_value(needed) as bigint) as needed, sum(power) >= any_value(needed) as reached from votes join validators on validator = id cross join total group by block")
def quorum_power(s, d):
    return consensus.quorum(R.votes(s, d), R.validators(s, d))


@query("select a.block, a.height from blocks a join blocks b on b.parent = a.block join blocks c on c.parent = b.block where a.certified and b.certified and c.certified and b.height = a.height + 1 and c.height = a.height + 2")
def three_chain_commit(s, d):
    b = R.blocks(s, d)
    return consensus.three_chain(b, b.where("certified"))


@query("+ up(block) as (select 140 union select parent from blocks b join up using (block) where parent is not null) select cast(block as bigint) as block from up")
def finalize_ancestors(s, d):
    b = R.blocks(s, d)
    return consensus.finalized(b.select("block", "parent"), b.where("block = 140"))


@query("+ kid as (select parent as block, block as k from blocks where certified) select b.block, b.height, case when height <= 400 then 'finalized' when block in (select x.block from kid x join kid y on y.block = x.k) then 'commit' when block in (select block from kid) then 'pre_commit' when parent is not null or certified then 'pending' else 'unknown' end as status from blocks b")
def finality_status(s, d):
    b = R.blocks(s, d)
    return consensus.finality_status(b.select("block", "parent", "height"), b.where("certified"), 400)


@query("+ v as (select id, row_number() over (order by id) - 1 as place, count(*) over () as n from validators) select r.range as round, id as leader from range(200) r join v on r.range % n = place")
def leader_rotation(s, d):
    v = R.validators(s, d)
    ranked = v.select("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("place"))  # the validator set is small
    rounds = s.range(200).withColumnRenamed("id", "round").crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("n"))))
    return rounds.select("round", (F.col("round") % F.col("n")).alias("place")).join(F.broadcast(ranked), "place").select("round", F.col("id").alias("leader"))


# ---- statistics


@query("+ s as (select name, value, row_number() over (partition by name order by value) as rn, count(*) over (partition by name) as n from emitted) select name, count(*) as count, avg(value) as avg, min(value) as min, max(value) as max, max(value) filter (where rn = floor(50 / 100.0 * (n - 1)) + 1) as p50, max(value) filter (where rn = floor(95 / 100.0 * (n - 1)) + 1) as p95, max(value) filter (where rn = floor(99 / 100.0 * (n - 1)) + 1) as p99 from s group by name")
def latency_stats(s, d):
    return stats.latency_stats(R.emitted(s, d), ["name"], "value")


@query("+ s as (select name, value, row_number() over (partition by name order by value) as rn, count(*) over (partition by name) as n from emitted) select name, max(value) filter (where rn = floor(n * 0.5) + 1) as p50, max(value) filter (where rn = floor(n * 0.99) + 1) as p99, max(value) filter (where rn = floor(n * 0.999) + 1) as p999 from s group by name")
def latency_percentiles_n(s, d):
    """The other rule: the value at floor(n * p)."""
    return stats.nth_values(R.emitted(s, d), ["name"], "value", {k: F.floor(F.col("n") * F.lit(p)) for k, p in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))})


@query("select b.le, count(*) as n from (select unnest([1, 2, 5, 10, 20, 50, 100]) as le) b join emitted on value <= le group by b.le")
def latency_histogram(s, d):
    return stats.histogram(R.emitted(s, d), "value")


@query("select count(*) as spikes from emitted where value > 100")
def spike_count(s, d):
    return R.emitted(s, d).agg(F.count(F.when(F.col("value") > 100, 1)).alias("spikes"))


@query("+ t as (select cast(ts as date) as day, count(*) as n from tx group by 1) select avg(n) as mean, stddev_pop(n) as stddev, min(n) as low, max(n) as high from t")
def tps_mean_stddev(s, d):
    t = R.tx(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("stddev"), F.min("n").alias("low"), F.max("n").alias("high"))


@query("+ h as (select name, date_trunc('hour', ts) as h, count(*) as n from emitted group by 1, 2) select name, cast(sum(n) as bigint) as total, sum(n) / 720.0 as per_hour, max(n) as peak from h group by name")
def throughput_summary(s, d):
    h = R.emitted(s, d).groupBy("name", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("name").agg(F.sum("n").alias("total"), (F.sum("n") / F.lit(720.0)).alias("per_hour"), F.max("n").alias("peak"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as n from emitted")
def throughput_trailing_window(s, d):
    """Events of the user in the last hour, the bound itself left out."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3599999999, 0)
    return R.emitted(s, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("select name, (arg_max(value, ts) - arg_min(value, ts)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0) as slope from emitted where ts >= timestamp '2024-01-02' group by name")
def memory_slope(s, d):
    """Last less first, by minutes, after warm-up."""
    e = R.emitted(s, d).where("ts >= timestamp_ntz '2024-01-02 00:00:00'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    minutes = (F.max("us") - F.min("us")) / F.lit(60000000.0)
    return e.groupBy("name").agg(((F.max_by("value", "us") - F.min_by("value", "us")) / minutes).alias("slope"))


# ---- pool


@query("select tx_id, ts from tx where st = 'O' order by ts, tx_id limit 25")
def mempool_topk(s, d):
    return R.tx(s, d).where("st = 'O'").orderBy("ts", "tx_id").limit(25).select("tx_id", "ts")


@query("select event_id from emitted where epoch_us(timestamp '2024-01-15 12:00:00') - epoch_us(ts) > 3600000000 and ts <= timestamp '2024-01-15 12:00:00'")
def mempool_evict_expired(s, d):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return R.emitted(s, d).where((us(now) - us(F.col("ts")) > 3600000000) & (F.col("ts") <= now)).select("event_id")


@query("select event_id from (select event_id, row_number() over (order by ts desc, event_id desc) as rn from emitted) where rn <= 1000")
def mempool_capacity(s, d):
    return R.emitted(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


@query("select cast(cast(ts as date) as varchar) as day, count(*) as depth, count(*) > 0.8 * 350 as pressure, count(*) >= 350 as rejecting from emitted group by 1")
def backpressure_flags(s, d):
    g = R.emitted(s, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("depth"))
    return g.select("day", "depth", (F.col("depth") > 0.8 * 350).alias("pressure"), (F.col("depth") >= 350).alias("rejecting"))


@query("select l_orderkey as h, count(distinct l_suppkey % 14) as chunks, count(distinct l_suppkey % 14) >= 4 as complete from lineitem group by 1")
def chunk_completeness(s, d):
    """A message is whole when enough different chunks of it are there."""
    g = R.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("h")).agg(F.countDistinct(F.col("l_suppkey") % 14).alias("chunks"))
    return g.withColumn("complete", F.col("chunks") >= 4)


# ---- hashes and values


@query("select doc_id, sha256(text) as h from documents")
def sha256_text(s, d):
    return R.table(s, d, "documents").select("doc_id", H.sha256(H.as_bytes(F.col("text"))).alias("h"))


@query("select doc_id, sha256('STATE:' || text) as h from documents")
def sha256_domain(s, d):
    return R.table(s, d, "documents").select("doc_id", H.sha256_domain("STATE:", H.as_bytes(F.col("text"))).alias("h"))


@query("select doc_id, sha256(unhex(sha256(text))) as h from documents")
def double_sha256(s, d):
    return R.table(s, d, "documents").select("doc_id", H.double_sha256(H.as_bytes(F.col("text"))).alias("h"))


@query("select c_custkey as k, lower(hex(encode(c_name))) as h, c_name as back from customer")
def hex_roundtrip(s, d):
    h = H.to_hex(H.as_bytes(F.col("c_name")))
    return R.table(s, d, "customer").select(F.col("c_custkey").alias("k"), h.alias("h"), F.decode(F.unhex(h), "UTF-8").alias("back"))


@query("select c_custkey as k, lower(lpad(to_hex(octet_length(encode(c_mktsegment))), 8, '0') || hex(encode(c_mktsegment)) || sha256(c_name)) as h from customer")
def state_key_encode(s, d):
    key = H.state_key(F.col("c_mktsegment"), F.unhex(H.sha256(H.as_bytes(F.col("c_name")))))
    return R.table(s, d, "customer").select(F.col("c_custkey").alias("k"), H.to_hex(key).alias("h"))


@query("select c_custkey as k, case when c_custkey % 2 = 0 then sha256(c_name) else sha256(c_name || '!') end as h from customer")
def derive_state_id(s, d):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0x"), H.sha256(H.as_bytes(F.col("c_name"))))).otherwise(F.concat("c_name", F.lit("!")))
    return R.table(s, d, "customer").select(F.col("c_custkey").alias("k"), H.derive_id(text).alias("h"))


@query("select o_orderkey as k, lower(lpad(to_hex(o_orderkey), 16, '0')) as h, cast(o_orderkey as bigint) as back from orders")
def uint64_roundtrip(s, d):
    b = H.uint64_bytes(F.col("o_orderkey"))
    return R.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), H.to_hex(b).alias("h"), H.bytes_uint64(b).cast("long").alias("back"))


@query("select o_orderkey as k, cast(trunc(cents / 10) as bigint) as tenths from tx")
def fixed_parse_truncate(s, d):
    fixed = V.fixed_parse(F.col("payload"), 18, 1)
    return R.tx(s, d).select(F.col("o_orderkey").alias("k"), (fixed * 10).cast("long").alias("tenths"))


@query("select p_partkey as k, (cast(round(p_retailprice * 100) as bigint) * (p_size * 3 + 7)) // 100 as cents from part")
def fixed_mul_truncate(s, d):
    a = F.round("p_retailprice", 2).cast("decimal(15,2)")
    b = ((F.col("p_size") * 3 + 7) / F.lit(100)).cast("decimal(15,2)")
    return R.table(s, d, "part").select(F.col("p_partkey").alias("k"), (V.fixed_mul(a, b, 18, 2) * 100).cast("long").alias("cents"))


@query("select c_custkey as k, len(l) as n, l[1] as first, list_contains(l, c_nationkey) as has, l[2] * 10 as changed from (select c_custkey, c_nationkey, [c_nationkey, c_nationkey + 1, 7] as l from customer)")
def list_ops(s, d):
    c = F.col("c_nationkey")
    xs = F.array_append(F.array(c, c + 1), F.lit(7))
    changed = F.transform(xs, lambda x, i: F.when(i == 1, x * 10).otherwise(x))
    return R.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.size(xs).cast("long").alias("n"), F.get(xs, F.lit(0)).alias("first"), F.array_contains(xs, c).alias("has"), F.get(changed, F.lit(1)).alias("changed"))


@query("select event_id, cast(props->>'k' as bigint) as k, cast(props->>'k' as bigint) + 1 as changed, false as missing, 1 as size from emitted")
def map_ops(s, d):
    m = F.from_json("props", "map<string,bigint>")
    set_ = F.map_concat(F.map_filter(m, lambda k, v: k != "k"), F.create_map(F.lit("k"), m["k"] + 1))
    return R.emitted(s, d).select("event_id", m["k"].alias("k"), set_["k"].alias("changed"), F.map_contains_key(m, "zz").alias("missing"), F.size(set_).alias("size"))


@query("select 'i:' || c_custkey as a, 's:' || c_name as b from customer")
def typed_keys(s, d):
    return R.table(s, d, "customer").select(V.typed_key(F.col("c_custkey"), "int").alias("a"), V.typed_key(F.col("c_name"), "string").alias("b"))


# ---- commitments

EMPTY = "00" * 32
CHAIN = "+ entries as (select (seq - 1) // 100 as shard, seq, sha256(seq || tx_id || sender || nonce || payload) as h from tx), heads as (select shard, count(*) as n, list_reduce(list_prepend(repeat('0', 64), list(h order by seq)), lambda a, x: sha256(unhex(a) || unhex(x))) as head from entries group by shard)"


def _heads(s, d, rows=None):
    t = R.tx(s, d) if rows is None else rows
    entry = H.sha256(H.as_bytes(F.concat(F.col("seq").cast("string"), "tx_id", F.col("sender").cast("string"), F.col("nonce").cast("string"), "payload")))
    return merkle.chain_heads(t.withColumn("shard", F.expr("(seq - 1) div 100")), ["shard"], "seq", entry)


@query(CHAIN + " select * from heads")
def hash_chain_head(s, d):
    return _heads(s, d)


@query("select (seq - 1) // 100 as shard, count(*) filter (where seq % 777 = 0) = 0 as valid from tx group by 1")
def hash_chain_verify(s, d):
    """Heads of a copy with some payloads changed, against the stored heads."""
    t = R.tx(s, d)
    changed = t.withColumn("payload", F.when(F.col("seq") % 777 == 0, F.concat("payload", F.lit("0"))).otherwise(F.col("payload")))
    stored = _heads(s, d, t).select("shard", "head")
    return _heads(s, d, changed).select("shard", F.col("head").alias("again")).join(stored, "shard").select("shard", F.expr("again = head").alias("valid"))


#: Four levels over the leaves of one block of ten orders.
NODE = "sha256(unhex('01') || unhex(l) || unhex(coalesce(r, repeat('00', 32))))"
LEAVES = "+ leaves as (select (seq - 1) // 10 as block, seq, sha256(unhex('00') || unhex(tx_id)) as h from tx), l0 as (select block, row_number() over (partition by block order by seq) - 1 as i, h, count(*) over (partition by block) as n from leaves), " + ", ".join(f"l{k + 1} as (select block, i // 2 as i, case when any_value(n) = 1 then min(h) else {NODE.replace('(l)', '(max(h) filter (where i % 2 = 0))').replace('coalesce(r,', 'coalesce(max(h) filter (where i % 2 = 1),')} end as h, any_value((n + 1) // 2) as n from l{k} group by block, i // 2)" for k in range(4))


def _leaves(s, d):
    return R.tx(s, d).select(F.expr("(seq - 1) div 10").alias("block"), "seq", H.sha256_domain(b"\x00", F.unhex("tx_id")).alias("leaf"))


@query(LEAVES + " select block, h as root from l4")
def merkle_root(s, d):
    return merkle.merkle_roots(_leaves(s, d), ["block"], ["seq"], "leaf", EMPTY)


PROOFS = " union all ".join(
    f"select a.block, a.i, {k} as level, coalesce(b.h, repeat('00', 32)) as sibling, case when (a.i // {2**k}) % 2 = 0 then 'right' else 'left' end as side"
    f" from l0 a join l{k} c on a.block = c.block and c.i = a.i // {2**k} and c.n > 1 left join l{k} b on a.block = b.block and b.i = xor(a.i // {2**k}, 1)"
    for k in range(4)
)


@query(LEAVES + " " + PROOFS)
def merkle_proof(s, d):
    """The whole inclusion proof of each leaf, a row for each level; a block of one leaf has none."""
    p = merkle.merkle_proofs(_leaves(s, d), ["block"], ["seq"], "leaf", EMPTY)
    return p.select("block", "i", F.explode("siblings").alias("x")).select("block", "i", "x.level", F.col("x.hash").alias("sibling"), "x.side")


@query("select (seq - 1) // 10 as block, (seq - 1) % 10 as i, seq % 333 <> 0 as valid from tx")
def merkle_verify(s, d):
    proofs = merkle.merkle_proofs(_leaves(s, d), ["block"], ["seq"], "leaf", EMPTY)
    seq = F.col("block") * 10 + F.col("i") + 1
    leaf = F.when(seq % 333 == 0, F.lit("ab" * 32)).otherwise(F.col("h"))
    return proofs.select("block", "i", (merkle.verified_root(leaf, F.col("siblings")) == F.col("root")).alias("valid"))


@query()
def trie_root(s, d):
    st = _state(s, d).select(H.sha256(H.as_bytes(F.concat(F.lit("part:"), F.col("key").cast("string")))).alias("k"), H.sha256(H.as_bytes(F.col("value").cast("string"))).alias("v"))
    return merkle.trie_root(st, "k", "v", EMPTY)


@query("select key // 100 as shard, count(*) as n, sha256(string_agg(key || '=' || value, ';' order by key)) as digest, true as same from state group by 1")
def replay_root_match(s, d):
    """Digests of the state replayed from the earlier one and the difference, by range of a hundred keys, and whether the
    full fold has the same."""

    def digests(rows):
        entry = F.struct("key", F.concat(F.col("key").cast("string"), F.lit("="), F.col("value").cast("string")).alias("e"))
        entries = rows.groupBy(F.expr("key div 100").alias("shard")).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.count(F.lit(1)).alias("n"))
        return entries.select("shard", "n", H.sha256(H.as_bytes(F.array_join(F.transform("e", lambda x: x["e"]), ";"))).alias("digest"))

    both = stored(_versions(s, d))  # read three times
    replayed = digests(state.apply_diff(state.version_of(both, ["key"], "old"), state.changed(both, ["key"]), ["key"]))
    full = digests(state.version_of(both, ["key"], "new")).select("shard", F.col("digest").alias("want"))
    return replayed.join(full, "shard", "left").select("shard", "n", "digest", F.col("digest").eqNullSafe(F.col("want")).alias("same"))


@query("select doc_id, sha256(text) as proof, octet_length(encode(text)) as size from documents")
def notarize_documents(s, d):
    t = H.as_bytes(F.col("text"))
    return R.table(s, d, "documents").select("doc_id", H.sha256(t).alias("proof"), F.octet_length(t).cast("long").alias("size"))


@query("select doc_id, doc_id % 41 <> 0 as intact from documents")
def notarize_tamper_check(s, d):
    docs = R.table(s, d, "documents")
    proofs = docs.select("doc_id", H.sha256(H.as_bytes(F.col("text"))).alias("proof"))
    now = docs.select("doc_id", F.when(F.col("doc_id") % 41 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return now.join(proofs, "doc_id").select("doc_id", (H.sha256(H.as_bytes(F.col("text"))) == F.col("proof")).alias("intact"))
