"""Continuous indexing with Structured Streaming: arriving chunks are embedded once and appended to the index table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import incremental
from tesserine.sources.files import CHUNKS
from tesserine.sources.snapshot import exists

BUCKETS = 64  # partitions of an index


def index_stream(spark: SparkSession, source: str, index: str, checkpoint: str, model: str, vectors: Callable[[DataFrame], DataFrame], schema: str = CHUNKS):
    """Starts a query that indexes chunk files as they arrive in `source` until all present ones are done.

    Every micro-batch is compared with the index by (chunk_id, embed_hash); what is new or changed gets a vector
    (`vectors` adds the column `vector`) and is appended with the batch's number, so a repeated batch after a failure adds
    nothing twice and the last row of a chunk counts (incremental.latest). The index is partitioned by a hash of the chunk;
    of the partitions that a batch has chunks in, ids and hashes are read, never vectors.
    """
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int")

    def upsert(batch: DataFrame, number: int) -> None:
        current = incremental.hashed(batch, model).withColumn("bucket", bucket)
        if exists(spark, index):
            touched = [r.bucket for r in current.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            known = spark.read.parquet(index).where(F.col("bucket").isin(touched)).groupBy("chunk_id").agg(F.max_by("embed_hash", "batch").alias("embed_hash"))
            current = incremental.changed(current, known)
        vectors(current).withColumn("batch", F.lit(number).cast("long")).write.mode("append").partitionBy("bucket").parquet(index)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, value) by event-time window of a stream or table of events; later rows than `late` are let go by streams."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
    )
