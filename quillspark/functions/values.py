"""Value semantics of the rule language: truth, equality, keys, integer division, fixed-point numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(value: Column, kind: str) -> Column:
    """Null, zero and empty values are false; addresses and structs are always true."""
    test = {
        "int": lambda: value != 0, "bool": lambda: value, "string": lambda: F.length(value) > 0, "bytes": lambda: F.octet_length(value) > 0,
        "list": lambda: F.size(value) > 0, "map": lambda: F.size(value) > 0, "address": lambda: value.isNotNull(), "struct": lambda: value.isNotNull(),
    }[kind]()
    return F.coalesce(test, F.lit(False))


def equal(a: Column, b: Column, kind_a: str, kind_b: str) -> Column:
    """Deep equality; null equals null; kinds that differ are never equal; maps without regard to order."""
    if kind_a != kind_b:
        return F.lit(False)
    if kind_a == "map":
        a, b = F.array_sort(F.map_entries(a)), F.array_sort(F.map_entries(b))
    return a.eqNullSafe(b)


def typed_key(value: Column, kind: str) -> Column:
    """One text key for values of all kinds."""
    prefix = {"int": "i:", "string": "s:", "bool": "b:", "bytes": "x:", "address": "a:"}[kind]
    return F.concat(F.lit(prefix), F.lower(F.hex(value)) if kind == "bytes" else value.cast("string"))


def int_div(a: Column, b: Column) -> Column:
    """Division of wide integers, truncated toward zero; zero divisors raise under ANSI mode."""
    quotient = a.cast("decimal(38,0)") / b.cast("decimal(38,0)")
    return F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient)).cast("decimal(38,0)")


def fixed_parse(text: Column, precision: int, scale: int) -> Column:
    """Decimal from text; digits beyond the scale are cut off, not rounded."""
    cut = F.regexp_extract(text, rf"^\s*([+-]?[0-9]+(?:\.[0-9]{{0,{scale}}})?)", 1)
    return F.when(cut != "", F.rtrim(F.regexp_replace(cut, r"\.$", "")).cast(f"decimal({precision},{scale})"))


def fixed_mul(a: Column, b: Column, precision: int, scale: int) -> Column:
    """Product of two decimals of one scale, cut off toward zero to that scale."""
    unit = 10**scale
    whole = (a * unit).cast("decimal(18,0)") * (b * unit).cast("decimal(18,0)")
    return (int_div(whole, F.lit(unit)) / F.lit(unit)).cast(f"decimal({precision},{scale})")


def bounded_while(start: Column, step, holds, limit: int = 1000) -> Column:
    """Repeats ``step`` while ``holds``, at most ``limit`` times, and then ends without an error."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, lambda acc, _: F.when(holds(acc), step(acc)).otherwise(acc))
