"""Keyed stream state: the latest version of each document lives in the state store of a streaming aggregation.

A batch touches the keys that it brings, so its work doesn't grow with the batches before it, nothing needs compacting, and a restart goes on from the checkpoint. The state is read from the
checkpoint as a table. Versions that arrive twice or late change nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .ingest import KEY, RAW


def kept(changes: DataFrame) -> DataFrame:
    """KEY with the latest version and seen, the latest time that any of its versions was pulled: the aggregation that the stream runs, on any frame of changes (RAW and pulled_ts).

    Of versions of one time, the one pulled last counts, then the larger text. Rows of null keys are one document of that key."""
    version = F.struct("updated_ts", "pulled_ts", "raw_json")
    return changes.groupBy(*KEY).agg(F.max(version).alias("latest"), F.max("pulled_ts").alias("seen"))


def start(spark: SparkSession, landing: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Consumes what lies in the landing folder (JSON lines of RAW and pulled_ts) into the state under checkpoint, and stops. partitions: of the state, fixed when it is made; the session's by default.

    For states beyond an executor's memory set spark.sql.streaming.stateStore.providerClass to the RocksDB provider."""
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    changes = spark.readStream.schema(f"{RAW}, pulled_ts timestamp").json(landing)
    return kept(changes).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str, refreshed: datetime | None = None) -> DataFrame:
    """KEY, raw_json, updated_ts and seen of the state. refreshed: when a full refresh began; documents that it didn't bring are left out, as the source has them no more."""
    buffers = "struct<latest:struct<updated_ts:timestamp,pulled_ts:timestamp,raw_json:string>,seen:timestamp>"  # of kept()'s aggregates, which the state names alike
    state = spark.read.format("statestore").load(checkpoint).select("key", F.col("value").cast(buffers).alias("value"))
    rows = state.select(*[F.col(f"key.{k}").alias(k) for k in KEY], "value.latest.raw_json", "value.latest.updated_ts", "value.seen")
    return rows if refreshed is None else rows.where(F.col("seen") >= F.lit(refreshed))
