"""Dense retrieval: exact cosine rankings of vectors for a stated set of query vectors, in blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20  # of query vectors that are sent to all tasks at once


def valid_vector(vector: Column, dim: int | None = None) -> Column:
    """Finite elements, not all zero, of the expected length."""
    ok = vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(ok if dim is None else ok & (F.size(vector) == dim), F.lit(False))


def checked_vectors(vectors: DataFrame, vector: str, dim: int) -> DataFrame:
    """The rows, or an error on the first vector that is not valid."""
    return vectors.withColumn(vector, F.when(valid_vector(F.col(vector), dim), F.col(vector)).otherwise(F.raise_error(F.lit(f"{vector} must have {dim} finite elements, not all zero")).cast(vectors.schema[vector].dataType)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; null where a length or an element makes it undefined."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x)))
    return F.when(F.size(a) == F.size(b), dot / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, item: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the k most similar vectors for every query vector (itself included if it is a row).

    queries: (query_id, vector). Query vectors go to all tasks in blocks of at most BLOCK_BYTES; every task keeps the k
    best of its rows for each, so what is shuffled is k rows a query and task. Invalid vectors and those of another length
    take no part. `where` is applied before ranking. Scores are rounded to six places, ties go to the smaller item_id.
    """
    spark = vectors.sparkSession
    q = queries.where(valid_vector(F.col(vector))).select(F.col("query_id").cast("long").alias("query_id"), vector)
    rows = vectors.where(valid_vector(F.col(vector)))
    rows = (rows if where is None else rows.where(where)).select(F.col(item).cast("long").alias("item_id"), vector)
    size = q.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, item_id long, score double, rank int")
    blocks = -(-size.n * size.d * 4 // BLOCK_BYTES)
    parts = []
    for i in range(blocks):
        table = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        parts.append(_block_topk(rows, table, k, vector))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))  # repeated rows count once
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(column, d: int):
    lists = [np.asarray(v, np.float64) for v in column.to_pylist()]
    keep = np.array([len(v) == d for v in lists], bool)
    x = np.stack([v for v in lists if len(v) == d]) if keep.any() else np.zeros((0, d))
    return keep, x / np.linalg.norm(x, axis=1, keepdims=True)


def _block_topk(rows: DataFrame, table: pa.Table, k: int, vector: str) -> DataFrame:
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(table.column(vector).to_pylist()):
        by_length.setdefault(len(v), []).append(i)
    ids = table.column("query_id").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast([(ids[at], _matrix(table.column(vector).take(pa.array(at)), d)[1]) for d, at in by_length.items()])

    def run(batches):
        best: list = [(np.full((len(i), 0), -2.0), np.zeros((len(i), 0), np.int64)) for i, _ in shared.value]
        for batch in batches:
            items = batch.column(0).to_numpy()
            for b, (_, qm) in enumerate(shared.value):
                keep, x = _matrix(batch.column(1), qm.shape[1])
                names, first = np.unique(items[keep], return_index=True)
                for at in range(0, len(names), _WIDTH):
                    some = names[at : at + _WIDTH]
                    score = np.round(qm @ x[first[at : at + _WIDTH]].T, 6)
                    key = np.rint((score + 1) * 1e6).astype(np.int64) * _WIDTH + np.arange(len(some))[::-1]  # equal scores: the smaller item first
                    cols = np.argpartition(-key, min(k, len(some)) - 1, axis=1)[:, :k]
                    best[b] = _merged(best[b], (np.take_along_axis(score, cols, 1), some[cols]), k)
        for (i, _), (scores, names) in zip(shared.value, best):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, scores.shape[1])), pa.array(names.ravel()), pa.array(scores.ravel())], ["query_id", "item_id", "score"])

    return rows.mapInArrow(run, "query_id long, item_id long, score double").where("score > -2")


_WIDTH = 4096


def _merged(a, b, k: int):
    """The k best of two lists a row; an item in both counts once."""
    scores, names = (np.concatenate([x, y], axis=1) for x, y in zip(a, b))
    order = np.lexsort((names, -scores), axis=1)
    scores, names = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
    again = np.zeros(names.shape, bool)
    again[:, 1:] = names[:, 1:] == names[:, :-1]
    scores = np.where(again, -2.0, scores)
    order = np.lexsort((names, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic bag-of-words vector of length one, for tests and runs without a model: word hashes counted into `dim` places."""
    from tesserine.functions.text import terms

    places = F.transform(terms(text, ()), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.coalesce(v / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).cast("float"))
