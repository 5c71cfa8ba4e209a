"""CSV and JSON-lines sources and sinks with fixed schemas, and a registry by file suffix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.sources import parsed

CHUNKS = (
    "chunk_id string, doc_id string, strategy string, kind string, text string, embed_text string, heading_path array<string>, pages array<int>, "
    "source_refs array<string>, metadata map<string,string>"
)
ANSWERS = ("id", "question", "answer", "answer_value", "answer_unit", "ref_id", "ref_url", "supporting_materials", "explanation")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A CSV file with a header; all values stay text, a byte order mark is dropped, missing columns are an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*columns) if columns else df


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer_unit) only, so nothing of a gold answer can leak; blank or repeated ids and blank questions are errors."""
    df = read_csv(spark, path, ("id", "question", "answer_unit")).fillna("")
    bad = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max((F.trim("id") == "") | (F.trim("question") == "")).alias("blank")).first()
    if not bad.n or bad.blank:
        raise ValueError("questions must have ids and text")
    if bad.n != bad.ids:
        raise ValueError("question ids repeat")
    return df


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; an empty embed_text is the text. Repeated chunk_ids are an error."""
    df = unique(spark.read.schema(CHUNKS).json(path), "chunk_id")
    return df.withColumn("embed_text", F.coalesce(F.nullif("embed_text", F.lit("")), F.col("text")))


def write_chunks(chunks: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    chunks.select(*names).write.mode("overwrite").json(path)


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, or an error where a key repeats."""
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    return df


def write_answers(answers: DataFrame, path: str) -> None:
    answers.select(*ANSWERS).write.mode("overwrite").csv(path, header=True, escape='"')


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".json": parsed.read_json_files, ".jsonl": read_chunks, ".csv": read_csv}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Whatever loader is registered for the path's suffix."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in LOADERS:
        raise ValueError(f"no loader for {suffix or path}; there are {sorted(LOADERS)}")
    return LOADERS[suffix](spark, path)


FLAGS = ("Quote", "Table", "Figure", "Math", "CrossPaper")


def gold_questions(rows: DataFrame) -> DataFrame:
    """(id, question, refs, evidence, flags) of the answerable rows of a gold table that refer to a paper."""
    has = lambda c: c in rows.columns
    answerable = rows.where(F.coalesce("is_NA", F.lit("")) != "1") if has("is_NA") else rows
    flags = F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.coalesce(F.col(f) == "1", F.lit(False)) if has(f) else F.lit(False))])
    supporting = F.col("supporting_materials") if has("supporting_materials") else F.lit("")
    out = answerable.select("id", "question", T.ref_ids(F.col("ref_id")).alias("refs"), T.evidence(supporting).alias("evidence"), flags.alias("flags"))
    return out.where(F.size("refs") > 0)


def figure_questions(rows: DataFrame) -> DataFrame:
    """(id, question, refs, figures, number) of the answerable questions about figures."""
    wanted = rows.where((F.col("Figure") == "1") & (F.coalesce("is_NA", F.lit("")) != "1"))
    number = T.answer_number(F.col("answer_value"), F.col("answer_unit"))
    return wanted.select("id", "question", T.ref_ids(F.col("ref_id")).alias("refs"), T.figure_numbers(F.col("supporting_materials")).alias("figures"), number.alias("number"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, figure_index, image_hash, width, height, pixels) of PNG files `<doc_id>/figure_<n>.png`; sizes from the file's head."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 4)) == "89504E47"
    out = files.select(
        F.element_at(F.split("path", "/"), -2).alias("doc_id"),
        F.regexp_extract("path", r"figure_([0-9]+)\.png$", 1).try_cast("int").alias("figure_index"),
        F.sha2("content", 256).alias("image_hash"),
        F.when(png, number(17)).alias("width"),
        F.when(png, number(21)).alias("height"),
    )
    return out.withColumn("pixels", F.col("width") * F.col("height"))


def atom_entry(xml):
    """Struct of title, published year and authors of the first entry of an Atom feed."""
    text = lambda path: F.get(F.xpath(xml, F.lit(path)), F.lit(0))
    bare = lambda tag: f"//*[local-name()='entry'][1]/*[local-name()='{tag}']"
    title = T.collapsed(text(bare("title") + "/text()"))
    authors = F.xpath(xml, F.lit(bare("author") + "/*[local-name()='name']/text()"))
    return F.struct(title.alias("title"), F.substring(text(bare("published") + "/text()"), 1, 4).alias("year"), authors.alias("authors"))
