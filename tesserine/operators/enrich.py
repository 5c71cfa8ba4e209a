"""What is added to chunks: heading prefixes, corpus metadata, flat citation metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T

CORPUS_FIELDS = {"id": "ref_id", "url": "url", "year": "year", "type": "doc_type", "title": "ref_title"}


def embedded_text(text: Column, embed_text: Column) -> Column:
    """embed_text, or the text where it is null or empty."""
    return F.coalesce(F.nullif(embed_text, F.lit("")), text)


def heading_prefix(title: Column | None, path: Column, text: Column, separator: str = " > ") -> Column:
    """`Title > Section > Subsection`, a blank line and the text; the text alone where there is neither title nor path."""
    path = F.coalesce(path, F.array().cast("array<string>"))
    whole = path if title is None else F.concat(F.filter(F.array(title), lambda t: t.isNotNull()), path)
    return F.when(F.size(whole) > 0, F.concat(F.array_join(whole, separator), F.lit("\n\n"), text)).otherwise(text)


def stem(path: Column) -> Column:
    """A file's name without folders and the last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def corpus_metadata(chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """chunks joined (left) with their paper's row by file stem; of several rows for one stem the largest id counts.

    Empty strings count as missing. Chunks of unknown papers keep null columns.
    """
    cleaned = [F.nullif(F.col(source), F.lit("")).alias(name) for source, name in CORPUS_FIELDS.items()]
    papers = corpus.where("coalesce(local_path, '') <> ''").select(stem(F.col("local_path")).alias("doc_id"), F.struct(*cleaned).alias("m"), F.coalesce("id", F.lit("")).alias("at"))
    papers = papers.groupBy("doc_id").agg(F.max_by("m", "at").alias("m"))
    return chunks.join(papers, "doc_id", "left").select(*chunks.columns, *[F.col(f"m.{name}").alias(name) for name in CORPUS_FIELDS.values()])


def citation_columns(chunks: DataFrame, model: str) -> DataFrame:
    """Scalars a vector index keeps for a chunk: path and pages as text, the first page or -1, the hash of what is embedded."""
    text = embedded_text(F.col("text"), F.col("embed_text"))
    keys = [F.nullif(F.try_element_at(F.col("metadata"), F.lit(k)), F.lit("")).alias(k) for k in ("ref_id", "title", "url", "year")]
    pages = F.coalesce("pages", F.array().cast("array<int>"))
    return chunks.select(
        "chunk_id", "doc_id", "kind", "strategy",
        F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ").alias("heading_path"),
        F.array_join(pages.cast("array<string>"), ",").alias("pages"),
        F.coalesce(F.get(pages, F.lit(0)), F.lit(-1)).alias("page_start"),
        T.embed_hash(F.lit(model), text).alias("embed_hash"),
        *keys,
    )
