"""Streaming admission: the same verdicts as the batch fold, one micro-batch after another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INPUT = "hash string, sender string, nonce long, at long"
OUTPUT = "hash string, sender string, nonce long, at long, verdict string"


def _admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches), ignore_index=True).sort_values("at").drop_duplicates("hash")
    verdicts = []
    for nonce in rows["nonce"]:
        verdicts.append("ok" if nonce == current + 1 else "nonce_low" if nonce <= current else "nonce_gap")
        current = nonce if nonce == current + 1 else current
    state.update((int(current),))
    yield rows.assign(verdict=verdicts)[["hash", "sender", "nonce", "at", "verdict"]]


def admitted(transactions: DataFrame) -> DataFrame:
    """Verdict of each transaction of a stream; state is one number a sender. Copies of a hash within a micro-batch are
    dropped; a later copy fails its nonce."""
    return transactions.groupBy("sender").applyInPandasWithState(_admit, OUTPUT, "current long", "append", GroupStateTimeout.NoTimeout)


def admit_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Admits what lies in a folder of JSON files, then stops; run again, it goes on from its checkpoint."""
    rows = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files).json(source)
    return admitted(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(transactions: DataFrame, time: str = "submitted_at", age: str = "1 hour") -> DataFrame:
    """Distinct hashes of a stream within a bounded time: state older than ``age`` behind the newest time is dropped."""
    return transactions.withWatermark(time, age).dropDuplicatesWithinWatermark(["hash"])
