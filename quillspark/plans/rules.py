"""Transactions as column expressions over calls and state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    """Body of a transaction: names bound in order, preconditions with the reason that a failure gives, the value written
    (null: nothing), whether the key is deleted, postconditions, and what is emitted."""

    let: dict[str, Column] = field(default_factory=dict)
    require: list[tuple[Column, str]] = field(default_factory=list)
    set_value: Column | None = None
    delete: Column | None = None
    ensure: list[tuple[Column, str]] = field(default_factory=list)
    emit: Column | None = None


def apply_rules(calls: DataFrame, state: DataFrame, rule: Rule, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, events, rejects) of calls (seq, keys, arguments) against state (keys, value), every call seeing the state as
    given. Expressions may use the arguments, ``state.value`` and the names bound."""
    packed = state.select(*keys, F.struct(*[c for c in state.columns if c not in keys]).alias("state"))
    rows = calls.join(packed, keys, "left")
    for name, value in rule.let.items():
        rows = rows.withColumn(name, value)
    checks = [F.when(~F.coalesce(test, F.lit(False)), reason) for test, reason in [*rule.require, *rule.ensure]]
    rows = rows.withColumn("reason", F.coalesce(*checks) if checks else F.lit(None).cast("string"))
    good = rows.where("reason is null")
    op = F.when(rule.delete, "delete").otherwise("set") if rule.delete is not None else F.lit("set")
    value = rule.set_value if rule.set_value is not None else F.lit(None)
    changes = good.select("seq", *keys, op.alias("op"), value.alias("value"))
    events = good.select("seq", (rule.emit if rule.emit is not None else F.lit(None)).alias("data")).where("data is not null")
    return changes, events, rows.where("reason is not null").select("seq", "reason")


def dry_run(calls: DataFrame, state: DataFrame, rule: Rule, keys: list[str]) -> DataFrame:
    """(seq, valid, error) without any effect."""
    _, _, rejects = apply_rules(calls, state, rule, keys)
    return calls.select("seq").join(rejects, "seq", "left").select("seq", F.col("reason").isNull().alias("valid"), F.col("reason").alias("error"))
