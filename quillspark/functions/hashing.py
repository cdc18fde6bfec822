"""Hash and byte-string expressions. Hashes are lower-case hex text; byte strings are BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO32 = "0" * 64


def as_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def sha256_domain(domain: str | bytes, data: Column) -> Column:
    """SHA-256 of a domain prefix followed by the bytes."""
    prefix = domain.encode() if isinstance(domain, str) else domain
    return F.sha2(F.concat(F.lit(bytearray(prefix)), data), 256)


def double_sha256(data: Column) -> Column:
    return F.sha2(F.unhex(F.sha2(data, 256)), 256)


def hash_concat(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def uint64_bytes(n: Column) -> Column:
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def bytes_uint64(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def uint256_bytes(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 64, "0"))


def nibbles(data: Column) -> Column:
    """The half-bytes of a byte string, in order, as integers."""
    text = F.hex(data)
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.conv(F.substring(text, i, F.lit(1)), 16, 10).cast("int"))


def state_key(namespace: Column, key_id: Column) -> Column:
    """Length of the namespace in UTF-8 as four bytes, the namespace, the id."""
    length = F.unhex(F.lpad(F.hex(F.octet_length(namespace).cast("long")), 8, "0"))
    return F.concat(length, as_bytes(namespace), key_id)


def derive_id(text: Column) -> Column:
    """The 32 bytes that 0x and 64 hex digits spell, else the SHA-256 of the text; as hex."""
    return F.when(text.rlike("^0x[0-9a-fA-F]{64}$"), F.lower(F.substring(text, 3, 64))).otherwise(sha256(as_bytes(text)))


def chain(entries: Column, start: str = ZERO32) -> Column:
    """Head of the chain H(head || entry) over an array of hex hashes."""
    return F.aggregate(entries, F.lit(start), lambda head, x: F.sha2(F.concat(F.unhex(head), F.unhex(x)), 256))
