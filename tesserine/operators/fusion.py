"""Rank fusion, reranking and grids of fusion settings over long ranking tables (list_no, query_id, item_id, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacked(*rankings: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """The rankings as one table with list_no (from 0) and weight (1 where none are given)."""
    weights = [1.0] * len(rankings) if weights is None else weights
    if len(weights) != len(rankings):
        raise ValueError(f"got {len(weights)} weights for {len(rankings)} rankings")
    parts = [r.select(F.lit(i).alias("list_no"), F.lit(float(w)).alias("weight"), "query_id", "item_id", "rank") for i, (r, w) in enumerate(zip(rankings, weights))]
    return reduce(DataFrame.unionByName, parts)


def rrf(lists: DataFrame, k_rrf: int = 60, limit: int | None = None, depth: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): reciprocal rank fusion, score = sum of weight / (k_rrf + rank).

    Ties keep the order of first sight: by list, then by rank in it. depth: ranks beyond it are ignored.
    """
    lists = lists if depth is None else lists.where(F.col("rank") <= depth)
    fused = lists.groupBy("query_id", "item_id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k_rrf) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "item_id")
    out = fused.withColumn("rank", F.row_number().over(order))
    return (out if limit is None else out.where(F.col("rank") <= limit)).select("query_id", "item_id", "score", "rank")


def reranked(ranking: DataFrame, scores: DataFrame, candidates: int = 20, limit: int | None = None) -> DataFrame:
    """(query_id, item_id, rank): the first `candidates` by their pair score (best first, stable), the rest behind them as it was.

    scores: (query_id, item_id, pair_score); a candidate without a score comes last among the candidates.
    """
    order = Window.partitionBy("query_id").orderBy("tail", F.desc_nulls_last("pair_score"), "base_rank")
    base = ranking.select("query_id", "item_id", F.col("rank").alias("base_rank"), (F.col("rank") > candidates).alias("tail"))
    head = base.where("not tail").join(scores, ["query_id", "item_id"], "left").select("query_id", "item_id", "base_rank", "tail", "pair_score")
    both = head.unionByName(base.where("tail").withColumn("pair_score", F.lit(None).cast("double")))
    out = both.withColumn("rank", F.row_number().over(order))
    return (out if limit is None else out.where(F.col("rank") <= limit)).select("query_id", "item_id", "rank")


def rrf_grid(lists: DataFrame, ks: list[int], second_weights: list[float]) -> DataFrame:
    """(k_rrf, weight, query_id, item_id, rank) of every setting at once: list 0 weighs 1, all others the weight of the setting."""
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k_rrf"), F.lit(float(w)).alias("weight")) for k in ks for w in second_weights]))
    rows = lists.drop("weight").withColumn("g", grid)
    part = F.when(F.col("list_no") == 0, F.lit(1.0)).otherwise(F.col("g.weight")) / (F.col("g.k_rrf") + F.col("rank"))
    fused = rows.groupBy("g", "query_id", "item_id").agg(F.round(F.sum(part), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy("g", "query_id").orderBy(F.desc("score"), "seen", "item_id")
    return fused.withColumn("rank", F.row_number().over(order)).select("g.k_rrf", "g.weight", "query_id", "item_id", "rank")
