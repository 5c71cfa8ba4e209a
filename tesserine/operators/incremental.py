"""Incremental indexing: what changed, what is stale, and an index table that is only ever added to or rewritten whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tesserine.functions import text as T
from tesserine.operators.enrich import embedded_text
from tesserine.runtime import once, widened


def hashed(chunks: DataFrame, model: str) -> DataFrame:
    """(chunk_id, embed_text, embed_hash), one row a chunk."""
    text = embedded_text(F.col("text"), F.col("embed_text"))
    rows = once(chunks.select("chunk_id", F.coalesce(text, F.lit("")).alias("embed_text")), "chunk_id")
    return rows.withColumn("embed_hash", T.embed_hash(F.lit(model), F.col("embed_text")))


def changed(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of current (chunk_id, embed_hash) that the index does not have in this form."""
    return current.join(stored.select("chunk_id", "embed_hash"), ["chunk_id", "embed_hash"], "left_anti")


def stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the index whose chunk no longer exists."""
    return stored.join(current.select("chunk_id"), "chunk_id", "left_anti")


def index_stats(current: DataFrame, stored: DataFrame, batch: int = 64) -> DataFrame:
    """(embedded, skipped, deleted, batches) of an indexing run that also prunes."""
    now = current.select("chunk_id", F.col("embed_hash").alias("new"))
    old = stored.select("chunk_id", F.col("embed_hash").alias("old"))
    both = now.join(old, "chunk_id", "full_outer")
    todo = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    counts = both.agg(
        F.count(F.when(todo, 1)).alias("embedded"),
        F.count(F.when(F.col("new").isNotNull() & ~todo, 1)).alias("skipped"),
        F.count(F.when(F.col("new").isNull(), 1)).alias("deleted"),
    )
    return counts.withColumn("batches", F.ceil(F.col("embedded") / batch))


def updated(stored: DataFrame, fresh: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The index after an upsert of fresh rows (same columns) and, with current, a prune."""
    kept = stored.join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    out = kept.unionByName(fresh.select(*stored.columns))
    return out if current is None else out.join(current.select("chunk_id"), "chunk_id", "left_semi")


def latest(index: DataFrame, order: str) -> DataFrame:
    """Of an index that is only added to: the last row of every chunk."""
    last = Window.partitionBy("chunk_id").orderBy(F.desc(order))
    return index.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def fresh_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Recorded hits whose chunk still exists, with their rank among those left (stale ones are dropped after the search)."""
    left = hits.where("chunk_id is not null").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("hit_rank", "chunk_id")
    return left.withColumn("rank", F.row_number().over(order))


def reusable(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """Queries (query_id, k) that a ranking cache (query_id, depth) answers: cached at least as deep as asked."""
    deep = cached.groupBy("query_id").agg(F.max("depth").alias("depth"))
    return wanted.join(deep, "query_id", "left").withColumn("cached", F.coalesce(F.col("depth") >= F.col("k"), F.lit(False))).drop("depth")


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 16, text: str = "embed_text", attempts: int = 3) -> DataFrame:
    """rows with `vector` from embed(texts), called with at most `batch` texts, again (up to `attempts` times) on connection errors.

    The number of vectors, their length and their elements are checked; a wrong answer fails the task.
    """
    import math
    import time

    import pyarrow as pa

    at = rows.columns.index(text)

    def call(texts):
        for n in range(attempts):
            try:
                return embed(texts)
            except (ConnectionError, TimeoutError):
                if n == attempts - 1:
                    raise
                time.sleep(min(5 * 2**n, 20))

    def run(batches):
        for b in batches:
            texts, found = b.column(at).to_pylist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                if any(not (t or "").strip() for t in part):
                    raise ValueError("a text to embed is blank")
                got = call(part)
                if len(got) != len(part) or any(len(v) != dim or not all(map(math.isfinite, v)) or not any(v) for v in got):
                    raise ValueError("the embedder returned wrong vectors")
                found.extend(got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float32()))], [*b.schema.names, "vector"])

    return rows.mapInArrow(run, widened(rows.schema, "vector", ArrayType(FloatType())))
