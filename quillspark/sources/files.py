"""Sources and sinks: versioned snapshots, audit bundles, write-ahead logs."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = "type string, protocol string, version string, chainId string, sequence bigint, timestamp bigint, transactions array<struct<hash:string, nonce:string, sender:string, payload:string, function:string, args:string>>, stateRoot string, operatorSig string, operatorSignature string"


def save_snapshot(state: DataFrame, folder: str, height: int) -> None:
    state.write.mode("overwrite").parquet(f"{folder}/height={height}")


def snapshot_heights(spark: SparkSession, folder: str) -> list[int]:
    """Heights of the snapshots in a folder, lowest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [x.getPath().getName() for x in found]
    return sorted(int(n.removeprefix("height=")) for n in names if n.startswith("height="))


def load_snapshot(spark: SparkSession, folder: str, height: int) -> DataFrame:
    """The newest snapshot not above ``height``."""
    below = [h for h in snapshot_heights(spark, folder) if h <= height]
    if not below:
        raise ValueError(f"no snapshot at or below {height}")
    return spark.read.parquet(f"{folder}/height={below[-1]}")


def prune_snapshots(spark: SparkSession, folder: str, keep: int) -> list[int]:
    """Deletes all but the newest ``keep`` snapshots and returns their heights."""
    old = snapshot_heights(spark, folder)
    old = old[: len(old) - keep] if keep else old
    for h in old:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/height={h}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return old


def audit_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSONL audit bundles, without headers; either name of the signature field is read."""
    rows = spark.read.schema(BUNDLE).json(path)
    return rows.where("sequence is not null").select("sequence", "timestamp", "transactions", F.col("stateRoot").alias("state_root"), F.coalesce("operatorSig", "operatorSignature").alias("signature"))


def wal_record(kind: str, key: bytes, value: bytes) -> bytes:
    """One record: body length, body (kind, key length, key, value), first eight bytes of the body's SHA-256."""
    body = kind.encode() + struct.pack(">I", len(key)) + key + value
    return struct.pack(">I", len(body)) + body + hashlib.sha256(body).digest()[:8]


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            rows, at = [], 0
            while at + 4 <= len(data):
                (n,) = struct.unpack_from(">I", data, at)
                body, check = data[at + 4 : at + 4 + n], data[at + 4 + n : at + 12 + n]
                if n < 5 or len(check) < 8 or hashlib.sha256(body).digest()[:8] != check:
                    break
                (k,) = struct.unpack_from(">I", body, 1)
                rows.append((path, at, body[:1].decode(), body[5 : 5 + k], body[5 + k :]))
                at += 12 + n
            yield pd.DataFrame(rows, columns=["path", "at", "kind", "key", "value"])


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, kind, key, value) of the sound records of write-ahead log files; each file ends at its first bad record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_records, "path string, at bigint, kind string, key binary, value binary")
