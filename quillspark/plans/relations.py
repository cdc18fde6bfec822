"""Ledger relations derived from the star-schema tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import as_bytes, sha256_domain
from ..operators.sequence import numbered

TX = "TX:"
#: The earlier of the two points in time whose states are compared: changes before it.
EARLY = "1999-09-01"
#: Lines of which a task tells the accesses apart, about.
LINES_A_TASK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: orders by date and key, numbered from 1; nonces number each sender's own."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    rows = o.select(
        "o_orderkey", F.col("o_custkey").alias("sender"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("payload"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("nonce"),
    )
    tx_id = sha256_domain(TX, as_bytes(F.col("o_orderkey").cast("string")))  # after the shuffles of numbering
    return numbered(rows, F.to_date("ts"), ["ts", "o_orderkey"]).withColumn("tx_id", tx_id).select(*rows.columns[:-1], "tx_id", "nonce", "seq")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).select("seq", F.when(F.col("st") == "F", 1).otherwise(0).alias("status"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed: lines of the log's orders, totally ordered by (seq, line, supp, price)."""
    l = table(spark, sf_dir, "lineitem")
    t = tx(spark, sf_dir).select("seq", "o_orderkey", "ts")
    return l.join(t, l["l_orderkey"] == t["o_orderkey"]).select(
        "seq", "ts", F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
        F.lit("part").alias("entity"), F.col("l_partkey").alias("key"), F.when(F.col("l_returnflag") == "R", "delete").otherwise("set").alias("op"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("value"),
    )


ORDER = ["seq", "line", "supp", "price"]


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the parts, writes of the suppliers and, for open lines, of the parts; blocks of 50 orders are one batch.

    Lines are dealt by transaction before anything is told apart: hardly any access repeats, so a table of those met would grow with
    what a task reads and save nothing. The number of parts follows the lines, so that a task's tables do not grow with the input."""
    l = table(spark, sf_dir, "lineitem")
    part, supp = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    parts = max(spark.sparkContext.defaultParallelism, l.count() // LINES_A_TASK)
    l = l.select(F.col("l_orderkey").alias("tx"), "l_partkey", "l_suppkey", (F.col("l_linestatus") == "O").alias("open")).repartition(parts, "tx")
    read = F.struct(F.lit("R").alias("rw"), part.alias("key"))
    write = F.struct(F.lit("W").alias("rw"), F.when(F.col("open"), part).otherwise(supp).alias("key"))
    return l.select("tx", F.explode(F.array(read, write)).alias("x")).select("tx", "x.rw", "x.key").distinct()


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 + 1).alias("power"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("block"), F.col("l_suppkey").alias("validator")).distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit a day: height, root over the day's ids, the root before it; every 37th has a wrong one."""
    from pyspark.sql import Window

    days = tx(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_list("tx_id")), "").alias("ids"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day")  # one row a day
    rows = days.select("day", "n", F.sha2("ids", 256).alias("root"), (F.row_number().over(w) - 1).cast("long").alias("height"))
    before = F.coalesce(F.lag("root").over(w), F.lit("0" * 64))
    return rows.select("height", "day", "n", "root", F.when((F.col("height") > 0) & (F.col("height") % 37 == 0), F.reverse(before)).otherwise(before).alias("prev_root"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of blocks: the customers, block k on k - 1, but every 50th on k - 2."""
    c = table(spark, sf_dir, "customer")
    parent = F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey") - 2).otherwise(F.col("c_custkey") - 1)
    return c.select(F.col("c_custkey").alias("block"), F.when(parent > 0, parent).alias("parent"), F.col("c_custkey").alias("height"), (F.col("c_acctbal") > 500).alias("certified"))


def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("name"), "value", "props")


#: The same relations for DuckDB.
CTE = f"""
tx as (select row_number() over (order by o_orderdate, o_orderkey) as seq, o_orderkey, o_custkey as sender, o_orderdate as ts, o_orderstatus as st, o_orderpriority as priority,
  cast(cast(o_totalprice as decimal(15,2)) as varchar) as payload, cast(round(o_totalprice * 100) as bigint) as cents, sha256('TX:' || o_orderkey) as tx_id,
  row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nonce from orders),
receipts as (select seq, case when st = 'F' then 1 else 0 end as status from tx),
changes as (select seq, ts, l_linenumber as line, l_suppkey as supp, l_extendedprice as price, 'part' as entity, l_partkey as key,
  case when l_returnflag = 'R' then 'delete' else 'set' end as op, cast(round(l_quantity * 100) as bigint) as value from lineitem join tx on l_orderkey = o_orderkey),
accesses as (select distinct * from (select l_orderkey as tx, 'R' as rw, 'p' || l_partkey as key from lineitem
  union all select l_orderkey, 'W', case when l_linestatus = 'O' then 'p' || l_partkey else 's' || l_suppkey end from lineitem)),
conflicts as (select distinct r.tx from accesses r join (select key, min(tx) as fw from accesses where rw = 'W' group by key) w using (key) where rw = 'R' and fw < r.tx),
validators as (select s_suppkey as id, s_suppkey % 10 + 1 as power from supplier),
votes as (select distinct l_orderkey % 97 as block, l_suppkey as validator from lineitem),
days as (select cast(ts as date) as day, string_agg(tx_id, '' order by tx_id) as ids, count(*) as n from tx group by 1),
roots as (select day, n, sha256(ids) as root, row_number() over (order by day) - 1 as height from days),
prevs as (select *, coalesce(lag(root) over (order by day), repeat('0', 64)) as before from roots),
commits as (select height, day, n, root, case when height > 0 and height % 37 = 0 then reverse(before) else before end as prev_root from prevs),
blocks as (select c_custkey as block, case when c_custkey <= 1 then null when c_custkey % 50 = 0 then c_custkey - 2 else c_custkey - 1 end as parent, c_custkey as height, c_acctbal > 500 as certified
  from customer),
emitted as (select event_id, ts, user_id, event_type as name, value, props from events),
state as (select entity, key, value, seq as last_seq from (select *, row_number() over (partition by entity, key order by seq desc, line desc, supp desc, price desc) as rn from changes) where rn = 1 and op = 'set'),
state_early as (select entity, key, value, seq as last_seq from (select *, row_number() over (partition by entity, key order by seq desc, line desc, supp desc, price desc) as rn from changes where ts < timestamp '{EARLY}') where rn = 1 and op = 'set')
"""
