"""Incremental mirror: files of changed rows stream in, and the latest version of each document is kept.

A pull repeats the last minute before its watermark, so the same version may arrive twice; keeping the latest makes that harmless. The state is
a folder for each batch: a batch that runs again after a failure writes the same folder, and readers see whole folders only.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.verdicts import latest

RAW = "company_id string, entity string, source_id string, raw_json string, updated_ts timestamp"
KEY = ["company_id", "entity", "source_id"]
OVERLAP = timedelta(seconds=60)


def since(watermark: datetime | None) -> datetime | None:
    """From when the next pull asks for changes: a little before the last one; None asks for everything."""
    return watermark - OVERLAP if watermark else None


def start(spark: SparkSession, landing: str, state: str, checkpoint: str, schema: str = RAW) -> StreamingQuery:
    """Consumes what lies in the landing folder and stops; each batch leaves its latest rows in a folder of the state."""

    def keep(batch: DataFrame, number: int) -> None:
        latest(batch, KEY, "updated_ts").write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_each(spark: SparkSession, entities: list[str], landing: str, state: str, checkpoint: str) -> dict[str, StreamingQuery]:
    """A query of its own for each entity (landing, state and checkpoint folders by its name): they run at the same time, and one that fails stops no other."""
    return {e: start(spark, f"{landing}/{e}", f"{state}/{e}", f"{checkpoint}/{e}") for e in dict.fromkeys(entities)}


def outcomes(queries: dict[str, StreamingQuery], company: str, started: datetime) -> list[tuple]:
    """(company_id, entity, started, error) once all queries have ended: error is null where one succeeded. Rows are few: one an entity."""
    rows = []
    for entity, q in queries.items():
        try:
            q.awaitTermination()
            rows.append((company, entity, started, None))
        except StreamingQueryException as e:
            rows.append((company, entity, started, str(e).splitlines()[0]))
    return rows


def current(spark: SparkSession, state: str, snapshot: str | None = None) -> DataFrame:
    """The latest version of every document over all batches: those of a snapshot, and the batches behind it, whose folders alone are read."""
    rows = spark.read.schema(f"{RAW}, batch int").parquet(state)
    if snapshot:
        base = spark.read.schema(f"{RAW}, upto int").parquet(snapshot).withColumnRenamed("upto", "batch")
        upto = base.agg(F.max("batch")).first()[0]
        rows = base.unionByName(rows if upto is None else rows.where(F.col("batch") > upto))
    return latest(rows, KEY, "updated_ts", "batch").select(*KEY, "raw_json", "updated_ts")


def compacted(spark: SparkSession, state: str, into: str, snapshot: str | None = None) -> None:
    """Writes a snapshot of the current rows into a new folder, from the last snapshot and the batches behind it, so that the work follows what is new.

    It is laid out by entity, so that readers prune to what they need, and says up to which batch it goes."""
    upto = spark.read.schema(f"{RAW}, batch int").parquet(state).agg(F.max("batch")).first()[0]
    rows = current(spark, state, snapshot).withColumn("upto", F.lit(-1 if upto is None else upto))
    rows.repartition("entity", F.pmod(F.xxhash64("source_id"), F.lit(32))).write.partitionBy("upto", "entity").parquet(into)


def connection_health(runs: DataFrame) -> DataFrame:
    """(company_id, needs_reconnect) from entity runs: any authorisation error sets it, else any success clears it, else it is unknown."""
    auth, ok = F.bool_or(F.col("error") == "auth"), F.bool_or(F.col("error").isNull())
    return runs.groupBy("company_id").agg(F.when(F.coalesce(auth, F.lit(False)), True).when(ok, False).alias("needs_reconnect"))


def advanced(state: DataFrame, runs: DataFrame) -> DataFrame:
    """Watermarks after runs: they move only where a run succeeded. state: company_id, entity, watermark; runs: company_id, entity, started, error."""
    done = runs.where(F.col("error").isNull()).groupBy("company_id", "entity").agg(F.max("started").alias("started"))
    return state.join(done, ["company_id", "entity"], "full").select("company_id", "entity", F.greatest("watermark", "started").alias("watermark"))
