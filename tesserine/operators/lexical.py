"""Lexical retrieval: BM25 and TF-IDF rankings of passages for queries.

The index has one row a passage: the terms of the queries it holds, as positions in their sorted vocabulary, with their numbers.
Terms travel as 64-bit hashes and are counted in the task a text is read in. Scores are summed up there as well, for blocks of
passages in NumPy, and a task passes on only what can be among its k best of a query: pairs of query and passage are never moved
or sorted. Statistics always cover all passages; a passage filter (`where`) is applied after the statistics, so scores do not
depend on it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.runtime import stage

QUERY_ROWS = 500_000  # rows of query terms that are sent to all tasks at once; more are ranked in blocks of queries
VOCABULARY = 8_000_000  # terms of several passages whose frequencies are sent to all tasks; more are joined by shuffle
BLOCK_ROWS = 1 << 15  # passages that are scored at once
OUT_ROWS = 100_000  # rows of results that are passed on at once


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of every query; ties by the smaller item."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _hashed(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _asked(queries: DataFrame, terms: Column) -> tuple[DataFrame, int, np.ndarray]:
    """The terms of every query with their number, how many rows these are, and the sorted vocabulary."""
    asked = stage(queries.select("query_id", F.explode(_hashed(terms)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "query-terms")
    return asked, asked.count(), np.sort(asked.select("term").distinct().toArrow().column(0).to_numpy())


def _places(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The position of every value in the sorted words, -1 where it is none of them."""
    if not len(words):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(words, values), len(words) - 1)
    return np.where(words[at] == values, at, -1)


def _listed(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """values as lists by their ascending rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _index(passages: DataFrame, terms: Column, where: Column | None, words: np.ndarray, common: tuple[int, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(item_id, wanted, length, terms, tfs): a passage's terms among `words` with their numbers.

    length is the number of all its terms; where common (the number of passages, the sorted terms of several ones and their
    frequencies) is given, that of its TF-IDF vector.
    """
    rows = passages.select("item_id", (where if where is not None else F.lit(True)).alias("wanted"), _hashed(terms).alias("terms"))
    shared = rows.sparkSession.sparkContext.broadcast((words, common))

    def run(batches):
        words, common = shared.value
        for batch in batches:
            n, lists = batch.num_rows, batch.column(2)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()
            known, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            asked = _places(words, known)
            if common is None:
                length = np.bincount(row, minlength=n).astype(np.float64)
                row, code = row[asked[code] >= 0], code[asked[code] >= 0]
            # the positions of terms ascend within a row
            width = max(1, len(known))
            keys, tf = np.unique(row * width + code, return_counts=True)
            row, code = keys // width, keys % width
            if common is not None:
                n_all, several, df = common
                at = _places(several, known)
                idf = np.log((n_all + 1) / ((np.where(at >= 0, df[at], 1) if len(df) else 1) + np.ones(len(known)))) + 1
                weight = (np.log(tf) + 1) * idf[code]
                length = np.sqrt(np.bincount(row, weight * weight, minlength=n))
                kept = asked[code] >= 0
                row, code, tf = row[kept], code[kept], tf[kept]
            lists = [_listed(row, values, n) for values in (asked[code], tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length, pa.float64()), *lists], ["item_id", "wanted", "length", "terms", "tfs"])

    return stage(rows.mapInArrow(run, f"item_id {dict(rows.dtypes)['item_id']}, wanted boolean, length double, terms array<int>, tfs array<int>"), "postings")


def _blocks(batches, rows: int):
    """The batches together, in tables of at least so many rows but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(index: DataFrame, weights: DataFrame, words: np.ndarray, part, k: int) -> DataFrame:
    """(query_id, item_id, score) of passages among which are the k best of every query: the sum, over the terms of both, of weight
    times part(term's position, tf, length).

    weights: (query_id, term, weight), sent to all tasks. Scores are rounded to six places, ties go to the smaller item_id.
    """
    table = weights.select("query_id", "term", F.col("weight").cast("double")).toArrow().combine_chunks()
    coded = table.column(0).combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    start = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    place = _places(words, table.column(1).to_numpy())[order]
    shared = index.sparkSession.sparkContext.broadcast((coded.dictionary, start, place, table.column(2).to_numpy()[order], len(words)))
    kinds = dict(weights.dtypes)["query_id"], dict(index.dtypes)["item_id"]

    def run(batches):
        ids, start, place, weight, width = shared.value
        best, low = np.zeros((len(ids), k)), np.zeros(len(ids))  # the k best of a query in millionths, and what a score must exceed to be among them
        for block in _blocks(batches, BLOCK_ROWS):
            block = block.take(pc.sort_indices(block.column("item_id"), null_placement="at_start")).combine_chunks()
            items, n = block.column("item_id").combine_chunks(), block.num_rows
            terms, tfs = (block.column(c).combine_chunks() for c in ("terms", "tfs"))
            item = np.repeat(np.arange(n), terms.value_lengths().to_numpy(zero_copy_only=False))
            term = terms.flatten().to_numpy()
            value = part(term, tfs.flatten().to_numpy(), block.column("length").to_numpy()[item])
            by_term = np.argsort(term, kind="stable")
            item, value, bounds = item[by_term], value[by_term], np.searchsorted(term[by_term], np.arange(width + 1))
            dense = {}
            for t in np.flatnonzero(np.diff(bounds) * 6 > n):  # terms of many passages: adding whole columns is faster
                dense[t] = np.zeros(n)
                dense[t][item[bounds[t] : bounds[t + 1]]] = value[bounds[t] : bounds[t + 1]]
            score, queries, found, scores, rows = np.zeros(n), [], [], [], 0
            for q in range(len(ids)):
                score[:] = 0
                for j in range(start[q], start[q + 1]):
                    t = place[j]
                    if t in dense:
                        score += weight[j] * dense[t]
                    elif bounds[t] < bounds[t + 1]:
                        score[item[bounds[t] : bounds[t + 1]]] += weight[j] * value[bounds[t] : bounds[t + 1]]
                at = np.flatnonzero(score > low[q])
                if not len(at):
                    continue
                points = np.floor(score[at] * 1e6 + 0.5)
                if len(at) > k:
                    least = np.partition(points, len(at) - k)[len(at) - k]
                    above = np.flatnonzero(points > least)
                    kept = np.concatenate((above, np.flatnonzero(points == least)[: k - len(above)]))  # passages stand in the order of their ids
                    at, points = at[kept], points[kept]
                best[q] = np.partition(np.concatenate((best[q], points)), len(at))[len(at) :]
                low[q] = max(0.0, (best[q].min() - 0.6) / 1e6)  # equal scores are passed on
                queries.append(np.full(len(at), q))
                found.append(at)
                scores.append(score[at])
                rows += len(at)
                if rows >= OUT_ROWS:
                    yield _found(ids, items, queries, found, scores)
                    queries, found, scores, rows = [], [], [], 0
            if rows:
                yield _found(ids, items, queries, found, scores)

    # every task passes on k rows a query, so there are no more tasks than cores keep busy
    few = index.select("item_id", "length", "terms", "tfs").coalesce(2 * index.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(run, f"query_id {kinds[0]}, item_id {kinds[1]}, score double").withColumn("score", F.round("score", 6))


def _found(ids: pa.Array, items: pa.Array, queries: list, found: list, scores: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(queries))), items.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], ["query_id", "item_id", "score"])


def _in_blocks(index: DataFrame, weights: DataFrame, rows: int, words: np.ndarray, part, k: int) -> DataFrame:
    """_best of blocks of queries that have about QUERY_ROWS terms at most."""
    blocks = max(1, -(-rows // QUERY_ROWS))
    return reduce(DataFrame.unionByName, [_best(index, weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), words, part, k) for i in range(blocks)])


def bm25(passages: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, where: Column | None = None, stop_words=T.STOP_WORDS) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best passages: passages(item_id, text, ...), queries(query_id, query).

    Okapi BM25 with the idf log(1 + (N - df + 0.5) / (df + 0.5)); repeated query terms count as often as they occur;
    passages without any query term are left out. Null texts are empty passages. Scores are rounded to six places, ties
    go to the smaller item_id. Keys must be unique (see runtime.once); `where` may use any column of passages.
    """
    asked, rows, words = _asked(queries, T.terms(F.col("query"), stop_words))
    index = _index(passages, T.terms(F.col("text"), stop_words), where, words)
    stats = index.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    mean = stats.mean or 1.0
    counts = index.select(F.explode("terms").alias("place")).groupBy("place").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(words))
    df[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))

    def part(term, tf, length):
        return idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    found = _in_blocks(index.where("wanted"), asked.select("query_id", "term", F.col("qtf").alias("weight")), rows, words, part, k)
    return _ranked(found.where("score > 0"), k)


def tfidf(passages: DataFrame, queries: DataFrame, k: int = 10, stop_words=T.STOP_WORDS) -> DataFrame:
    """(query_id, item_id, score, rank): cosine of TF-IDF vectors over words and pairs of neighbouring words.

    Weights are (1 + ln tf) * (1 + ln((1 + N) / (1 + df))), vectors have length one. Only passages that share a term with
    the query are ranked. Rounding, ties and keys as in bm25.
    """
    passages = passages.select("item_id", T.plain_words(F.col("text"), stop_words).alias("w"))
    terms = T.with_pairs(F.col("w"))
    asked, rows, words = _asked(queries, T.ngram_terms(F.col("query"), stop_words))
    held = F.explode(F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(_hashed(terms))))  # a null for every passage
    # terms of a single passage are left out: what is not listed has the frequency 1
    df = stage(passages.select(held.alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df > 1 OR term IS NULL"), "frequencies")
    n = (df.where("term IS NULL").first() or [0, 0])[1]
    several = df.where("term IS NOT NULL")
    idf = lambda c: F.log((F.lit(n) + 1) / (F.coalesce(c, F.lit(1)) + 1)) + 1
    if several.count() <= VOCABULARY:
        table = several.toArrow()
        order = np.argsort(table.column(0).to_numpy())
        index = _index(passages, terms, None, words, (n, table.column(0).to_numpy()[order], table.column(1).to_numpy()[order].astype(np.int32)))
    else:
        index = _index(passages, terms, None, words)
        each = passages.select("item_id", F.explode(_hashed(terms)).alias("term")).groupBy("item_id", "term").agg((F.log(F.count("*")) + 1).alias("w")).join(several, "term", "left")
        lengths = each.groupBy("item_id").agg(F.sqrt(F.sum((F.col("w") * idf(F.col("df"))) ** 2)).alias("length"))
        index = stage(index.drop("length").join(lengths, "item_id").select("item_id", "wanted", "length", "terms", "tfs"), "postings")
    places = df.where(F.col("term").isNotNull()).join(asked.select("term").distinct(), "term", "left_semi").toArrow()
    known = np.ones(len(words))
    known[_places(words, places.column(0).to_numpy())] = places.column(1).to_numpy()
    weight = np.log((n + 1) / (known + 1)) + 1

    def part(term, tf, length):
        return (np.log(tf) + 1) * weight[term] / length

    # terms that no passage has take no part, in the length of a query neither
    there = index.select(F.explode("terms").alias("place")).distinct().toArrow().column(0).to_numpy()
    spark = asked.sparkSession
    listed = spark.createDataFrame(pa.table({"term": words[there], "idf": weight[there]}))
    raw = asked.join(F.broadcast(listed) if rows <= QUERY_ROWS else listed, "term").select("query_id", "term", ((F.log("qtf") + 1) * F.col("idf")).alias("weight"))
    raw = stage(raw, "query-weights")
    q_length = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("q_length"))
    weights = stage(raw.join(q_length, "query_id").select("query_id", "term", (F.col("weight") / F.col("q_length")).alias("weight")), "query-weights")
    return _ranked(_in_blocks(index, weights, rows, words, part, k), k)
