"""Named chunking strategies: from blocks (with a title column) to finished chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators import chunking, enrich


def _prefixed(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    with_title = chunks.join(titles, "doc_id", "left")
    prefixed = enrich.heading_prefix(F.col("title"), F.col("heading_path"), F.col("embed_text"))
    return with_title.withColumn("embed_text", prefixed).select(*chunks.columns)


def _strategy(name: str, make: Callable, prefix: bool, default: int):
    def build(blocks: DataFrame, limit: int | None = None) -> DataFrame:
        chunks = make(blocks, name, limit or default)
        titles = blocks.where("title is not null").groupBy("doc_id").agg(F.min("title").alias("title")) if prefix else None
        return _prefixed(chunks, titles) if prefix else chunks

    return build


_hybrid = lambda b, name, limit: chunking.packed_chunks(b, name, replace(chunking.HYBRID, limit=limit))
STRATEGIES = {
    "hybrid": _strategy("hybrid", _hybrid, True, 400),
    "hybrid_raw": _strategy("hybrid_raw", _hybrid, False, 400),
    "hybrid_fig": _strategy("hybrid_fig", _hybrid, True, 400),  # blocks read with a figure_text add one chunk a figure
    "hybrid_figlabels": _strategy("hybrid_figlabels", _hybrid, True, 400),
    "section": _strategy("section", lambda b, name, limit: chunking.packed_chunks(b, name, replace(chunking.SECTION, limit=limit)), True, 1200),
    "fixed": _strategy("fixed", lambda b, name, limit: chunking.fixed_chunks(b, limit, 50, name), False, 300),
}


def chunks(blocks: DataFrame, strategy: str, limit: int | None = None) -> DataFrame:
    """Chunks of blocks (BLOCK_COLUMNS and title) by a named strategy."""
    if strategy not in STRATEGIES:
        raise KeyError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](blocks, limit)
