"""Retrievers as composable objects: fit on passages(item_id, text, ...), then search(queries(query_id, query), k) as a ranking table.

A retriever's name says how it is made up; a ranking has (query_id, item_id, rank). Nothing runs until a ranking is used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import dense, fusion, incremental, lexical
from tesserine.sources.files import unique


@dataclass
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    where: Column | None = None
    name: str = "bm25"
    passages: DataFrame | None = field(default=None, repr=False)

    def fit(self, passages: DataFrame) -> Bm25:
        self.passages = passages
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.bm25(self.passages, queries, k, self.k1, self.b, self.where).select("query_id", "item_id", "rank")


@dataclass
class Tfidf:
    name: str = "tfidf"
    passages: DataFrame | None = field(default=None, repr=False)

    def fit(self, passages: DataFrame) -> Tfidf:
        self.passages = passages
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.tfidf(self.passages, queries, k).select("query_id", "item_id", "rank")


@dataclass
class Dense:
    """Cosine over vectors from embed(text column) -> vector column; the instruction goes before queries only."""

    embed: Callable[[Column], Column] = dense.hashed_embedding
    instruction: str | None = None
    model: str = "hashed"
    vectors: DataFrame | None = field(default=None, repr=False)

    @property
    def name(self) -> str:
        return f"dense-{self.model}" + ("" if self.instruction else "-noinstr")

    def fit(self, passages: DataFrame) -> Dense:
        """Items get numbers by hash, which are checked to be different; the names come back by join, so any type of item_id will do."""
        self.vectors = passages.select("item_id", F.xxhash64("item_id").alias("key"), self.embed(F.col("text")).alias("v"))
        unique(self.vectors.select("key", "item_id").distinct(), "key")
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.select("query_id", self.embed(T.instructed(F.col("query"), self.instruction)).alias("v"))
        found = dense.cosine_topk(self.vectors.select("key", "v"), asked, k, "key", "v")
        return found.withColumnRenamed("item_id", "key").join(self.vectors.select("key", "item_id"), "key").select("query_id", "item_id", "rank")


@dataclass
class Fused:
    """Weighted reciprocal rank fusion of retrievers, each searched to max(k, depth)."""

    parts: list
    k_rrf: int = 60
    depth: int = 50
    weights: list[float] | None = None

    @property
    def name(self) -> str:
        weights = "" if self.weights is None else " w=" + ",".join(f"{w:g}" for w in self.weights)
        return f"rrf({'+'.join(p.name for p in self.parts)}, k={self.k_rrf}{weights})"

    def fit(self, passages: DataFrame) -> Fused:
        for p in self.parts:
            p.fit(passages)
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        lists = fusion.stacked(*(p.search(queries, max(k, self.depth)) for p in self.parts), weights=self.weights)
        return fusion.rrf(lists, self.k_rrf, k).select("query_id", "item_id", "rank")


@dataclass
class Reranked:
    """The first candidates of a retriever ordered by score(query column, text column) -> column."""

    base: object
    score: Callable[[Column, Column], Column]
    candidates: int = 20
    model: str = "pair"
    passages: DataFrame | None = field(default=None, repr=False)

    @property
    def name(self) -> str:
        return f"{self.base.name} > {self.model}@{self.candidates}"

    def fit(self, passages: DataFrame) -> Reranked:
        self.base.fit(passages)
        self.passages = passages
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        base = self.base.search(queries, max(k, self.candidates))
        pairs = base.where(F.col("rank") <= self.candidates).join(queries.select("query_id", "query"), "query_id").join(self.passages.select("item_id", "text"), "item_id")
        scores = pairs.select("query_id", "item_id", self.score(F.col("query"), F.col("text")).alias("pair_score"))
        return fusion.reranked(base, scores, self.candidates, k)


@dataclass
class Cached:
    """Rankings of a cache table (query, item_id, rank) where it is deep enough; the rest is searched and can be added to it."""

    base: object
    cache: DataFrame

    @property
    def name(self) -> str:
        return self.base.name

    def fit(self, passages: DataFrame) -> Cached:
        self.base.fit(passages)
        self.known = passages.select("item_id")
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        depth = self.cache.groupBy("query").agg(F.max("rank").alias("depth"))
        state = incremental.reusable(depth.withColumnRenamed("query", "query_id"), queries.select(F.col("query").alias("query_id"), F.lit(k).alias("k")).distinct())
        deep = state.where("cached").select(F.col("query_id").alias("query"))
        hits = queries.join(deep, "query", "left_semi").join(self.cache.where(F.col("rank") <= k), "query").select("query_id", "item_id", "rank")
        hits = hits.join(self.known, "item_id", "left_semi").select("query_id", "item_id", "rank")  # what was removed since is dropped
        return hits.unionByName(self.base.search(queries.join(deep, "query", "left_anti"), k))


def figure_searcher(passages: DataFrame, embed: Callable[[Column], Column] = dense.hashed_embedding, ref_id: str | None = None, instruction: str | None = None):
    """Hybrid search over figure chunks only (statistics included), of one paper where ref_id is given."""
    own = passages.where("kind = 'figure'")
    within = None if ref_id is None else F.col("ref_id") == ref_id
    meaning = Dense(embed, instruction).fit(own if within is None else own.where(within))
    words = Bm25(where=within).fit(own)
    return Fused([words, meaning])
