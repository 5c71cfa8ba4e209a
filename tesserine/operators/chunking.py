"""From blocks to chunks: sentence splitting, packing within sections, section chunks and fixed windows."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tesserine.functions import text as T
from tesserine.operators.ordered import numbered, running_sum, runs
from tesserine.runtime import stage, widened

ATOMIC = ("table", "figure")
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9(\"'])"
# Sections that say nothing about a document's subject.
DROPPED_SECTIONS = ("references", "bibliography", "citations and bibliography", "contents", "table of contents", "list of figures", "list of tables")


def outside_sections(path: Column, names=DROPPED_SECTIONS) -> Column:
    """No heading above the block names one of the sections."""
    return ~F.exists(F.coalesce(path, F.array().cast("array<string>")), lambda h: T.section_name(h).isin(*names))


def at_least(text: Column, tokens: int = 5) -> Column:
    return T.approx_tokens(text) >= tokens


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


_SPLIT = re.compile(SENTENCE_END)


def tokens_of(words: int) -> int:
    return math.ceil(words * T.TOKENS_PER_WORD)


def sentence_pieces(text: str, limit: int) -> list[str]:
    """Consecutive sentences joined up to the limit; a sentence over the limit falls into windows of words."""
    most = max(1, int(limit / T.TOKENS_PER_WORD))
    out: list[str] = []
    held: list[str] = []
    count = 0
    for sentence in _SPLIT.split(text):
        split = sentence.split()
        fits = tokens_of(len(split)) <= limit
        for unit in [sentence] if fits else [" ".join(split[i : i + most]) for i in range(0, len(split), most)]:
            n = len(split) if fits else len(unit.split())
            if held and tokens_of(count + n) > limit:
                out.append(" ".join(held).strip())
                held, count = [], 0
            held.append(unit)
            count += n
    if held and " ".join(held).strip():
        out.append(" ".join(held).strip())
    return out


@dataclass(frozen=True)
class Packing:
    """How the blocks of a section become chunks. separate: tables stand alone, figures come after the text."""

    limit: int = 400
    least: int = 50
    separate: bool = True


HYBRID, SECTION = Packing(), Packing(1200, 0, False)


def packed_groups(kinds: list[str], sizes: list[int], how: Packing) -> list[int]:
    """Chunk number (in chunk order) of every block of one section."""
    number = [-1] * len(sizes)
    alone: list[bool] = []
    totals: list[int] = []
    filling = False
    figures = []
    for i, (kind, size) in enumerate(zip(kinds, sizes)):
        if how.separate and kind == "figure":
            figures.append(i)
            continue
        table = how.separate and kind == "table"
        if table or not filling or totals[-1] + size > how.limit:
            alone.append(table)
            totals.append(0)
        filling = not table
        totals[-1] += size
        number[i] = len(totals) - 1
    n = len(totals)
    if n > 1 and not alone[-1] and not alone[-2] and totals[-1] < how.least and totals[-1] + totals[-2] <= how.limit + how.least:
        number = [n - 2 if x == n - 1 else x for x in number]
        n -= 1
    for i in figures:
        number[i] = n
        n += 1
    return number


BLOCK_COLUMNS = ("doc_id", "block_no", "kind", "text", "heading_path", "page", "source_refs", "metadata")


def exploded(blocks: DataFrame, limit: int) -> DataFrame:
    """blocks with piece_no: blocks over the limit that are not atomic come out in sentence pieces, the rest as they are.

    Only texts over the limit are sent to Python, all in one pass.
    """

    @F.pandas_udf("array<string>")
    def cut(texts):
        return texts.map(lambda t: None if t is None else sentence_pieces(t, limit))

    big = (T.approx_tokens(F.col("text")) > limit) & ~F.col("kind").isin(*ATOMIC)
    names = [c for c in blocks.columns if c != "text"]
    pieces = F.coalesce(cut(F.when(big, F.col("text"))), F.array("text"))
    return blocks.select(*names, F.posexplode(pieces).alias("piece_no", "text"))


def sections(blocks: DataFrame) -> DataFrame:
    """blocks with section_no: the block number at which the run of blocks with this heading path began."""
    return runs(blocks, ["doc_id"], "block_no", "heading_path", "section_no")


def packed(blocks: DataFrame, how: Packing) -> DataFrame:
    """The pieces of blocks (see exploded) with section_no and chunk_no in it. Only kinds and sizes of a section are gathered."""
    pieces = stage(exploded(sections(blocks), how.limit).withColumn("size", T.approx_tokens(F.col("text"))), "pieces")
    order = F.array_sort(F.collect_list(F.struct("block_no", "piece_no", "kind", "size")))
    gathered = pieces.groupBy("doc_id", "section_no").agg(order.alias("parts"))

    def run(batches):
        for batch in batches:
            numbers = [packed_groups([p["kind"] for p in parts], [p["size"] for p in parts], how) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.list_(pa.int32()))], [*batch.schema.names, "numbers"])

    found = gathered.mapInArrow(run, widened(gathered.schema, "numbers", ArrayType(IntegerType())))
    each = found.select("doc_id", "section_no", F.explode(F.arrays_zip("parts", "numbers")).alias("z"))
    each = each.select("doc_id", "section_no", F.col("z.parts.block_no").alias("block_no"), F.col("z.parts.piece_no").alias("piece_no"), F.col("z.numbers").alias("chunk_no"))
    return pieces.join(each, ["doc_id", "section_no", "block_no", "piece_no"])


def last_wins(maps: Column) -> Column:
    """One map of an array of maps; of equal keys the last one's value counts."""
    entries = F.flatten(F.transform(F.filter(maps, lambda m: m.isNotNull()), F.map_entries))
    latest = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(latest)


def assembled(pieces: DataFrame, by: list[str]) -> DataFrame:
    """One chunk per key of `by`: texts joined in order (list items by a line end, all else by a blank line), pages, references."""
    part = F.struct("block_no", "piece_no", "kind", "text", "heading_path", "page", "source_refs", F.col("metadata").alias("meta"))
    slim = pieces.select(*by, F.struct("block_no", "piece_no").alias("o"), part.alias("p"))
    rows = slim.groupBy(*by).agg(F.collect_list(F.struct("o", F.struct("p.kind", "p.text", "p.heading_path", "p.page", "p.source_refs", F.map_entries("p.meta").alias("meta")).alias("b"))).alias("parts"))
    rows = rows.withColumn("parts", F.transform(F.array_sort("parts"), lambda p: p["b"]))
    p = F.col("parts")
    apart = lambda x, i: F.when(i == 0, F.lit("")).when((x["kind"] == "list_item") & (F.get(p, i - 1)["kind"] == "list_item"), F.lit("\n")).otherwise(F.lit("\n\n"))
    text = F.array_join(F.transform(p, lambda x, i: F.concat(apart(x, i), F.coalesce(x["text"], F.lit("")))), "")
    kind = F.when(F.forall(p, lambda x: x["kind"] == "table"), "table").when(F.forall(p, lambda x: x["kind"] == "figure"), "figure").otherwise("text")
    pages = F.array_sort(F.array_distinct(F.filter(F.transform(p, lambda x: x["page"]), lambda x: x.isNotNull())))
    refs = F.flatten(F.transform(p, lambda x: F.coalesce(x["source_refs"], F.array().cast("array<string>"))))
    meta = last_wins(F.transform(p, lambda x: F.map_from_entries(x["meta"])))
    return rows.select(*by, text.alias("text"), F.get(p, F.lit(0))["heading_path"].alias("heading_path"), pages.alias("pages"), kind.alias("kind"), refs.alias("source_refs"), meta.alias("metadata"))


def identified(chunks: DataFrame, strategy: str) -> DataFrame:
    """Chunks (doc_id, section_no, chunk_no, ...) with pos, dense in each document, chunk_id, strategy and embed_text."""
    rows = numbered(chunks, ["doc_id"], "section_no", "pos", ["chunk_no"])
    name = F.format_string("%s::%s::%04d", F.col("doc_id"), F.lit(strategy), F.col("pos"))
    return rows.withColumn("pos", F.col("pos").cast("int")).withColumn("chunk_id", name).withColumn("strategy", F.lit(strategy)).withColumn("embed_text", F.col("text"))


def packed_chunks(blocks: DataFrame, strategy: str = "hybrid", how: Packing = HYBRID, least_tokens: int = 5) -> DataFrame:
    """Chunks of blocks, section by section: filter blocks, pack, filter chunks, number them.

    Blocks are unique by (doc_id, block_no); null texts are empty. No chunk crosses a section.
    """
    kept = blocks.select(*BLOCK_COLUMNS).where(outside_sections(F.col("heading_path"))).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("kind", F.coalesce("kind", F.lit("text")))
    chunks = assembled(packed(kept, how), ["doc_id", "section_no", "chunk_no"])
    return identified(chunks.where(at_least(F.col("text"), least_tokens)), strategy)


def text_windows(rows: DataFrame, key: str, text: str, limit: int = 300, overlap: int = 50) -> DataFrame:
    """(key, window_no, words, text): sliding windows of int(limit / 1.3) words, int(overlap / 1.3) of them shared with the next."""
    size, step = window_shape(limit, overlap)
    w = rows.select(key, T.words(F.coalesce(F.col(text), F.lit(""))).alias("w")).where(F.size("w") > 0)
    last = F.ceil(F.greatest(F.size("w") - size, F.lit(0)) / step)
    each = w.select(key, "w", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("window_no"))
    part = F.slice("w", (F.col("window_no") * step + 1).cast("int"), size)
    return each.select(key, F.col("window_no").cast("int").alias("window_no"), F.size(part).alias("words"), F.array_join(part, " ").alias("text"))


def window_shape(limit: int, overlap: int) -> tuple[int, int]:
    size = max(1, int(limit / T.TOKENS_PER_WORD))
    return size, max(1, size - int(overlap / T.TOKENS_PER_WORD))


def fixed_chunks(blocks: DataFrame, limit: int = 300, overlap: int = 50, strategy: str = "fixed", least_tokens: int = 5) -> DataFrame:
    """Sliding windows over the words of all blocks of a document, whatever their sections.

    Every block sends its words to the windows they lie in (word offsets are prefix sums), so no document is gathered whole.
    """
    size, step = window_shape(limit, overlap)
    kept = blocks.select(*BLOCK_COLUMNS).where(outside_sections(F.col("heading_path"))).withColumn("w", T.words(F.coalesce("text", F.lit("")))).where(F.size("w") > 0)
    sizes = kept.select("doc_id", "block_no", F.size("w").alias("n"))
    placed = stage(running_sum(sizes, ["doc_id"], "block_no", F.col("n"), "first"), "offsets")
    total = placed.groupBy("doc_id").agg(F.max(F.col("first") + F.col("n")).alias("total"))
    last = F.ceil(F.greatest(F.col("total") - size, F.lit(0)) / step)
    end = F.col("first") + F.size("w")
    low = F.greatest(F.lit(0), F.floor((F.col("first") - size) / step) + 1)
    high = F.least(last, F.floor((end - 1) / step))
    each = kept.join(placed.join(total, "doc_id").drop("n"), ["doc_id", "block_no"]).where(low <= high).withColumn("chunk_no", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    begin = F.greatest(F.col("first"), F.col("chunk_no") * step)
    stop = F.least(F.col("first") + F.size("w"), F.col("chunk_no") * step + size)
    each = each.where(begin < stop).withColumn("text", F.array_join(F.slice("w", (begin - F.col("first") + 1).cast("int"), (stop - begin).cast("int")), " "))
    chunks = assembled(each.withColumn("piece_no", F.lit(0)).withColumn("kind", F.lit("text")), ["doc_id", "chunk_no"])
    joined = chunks.withColumn("text", F.regexp_replace("text", r"\n\n", " ")).withColumn("section_no", F.col("chunk_no"))
    return identified(joined.where(at_least(F.col("text"), least_tokens)), strategy)
