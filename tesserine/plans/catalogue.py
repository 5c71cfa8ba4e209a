"""The queries of the core and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.plans import corpus, judging, preparation, retrieval


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks by BM25 for every query."""
    return retrieval.bm25_topk(spark, sf_dir)


QUERIES: dict = {**retrieval.QUERIES, **corpus.QUERIES, **judging.QUERIES, **preparation.QUERIES}
SQL: dict[str, str] = {**retrieval.SQL, **corpus.SQL, **judging.SQL, **preparation.SQL}
