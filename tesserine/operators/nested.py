"""Deeply nested JSON records as related flat tables, by Dewey labels.

Every object, every array and every scalar element of an array is a node. Its label is the path of ordinals from the root
(a field counts by its place in its object, an element by its place in its array), an ARRAY<INT> that sorts in document
order. The parent of a node is its label without the last ordinal, an ancestor any shorter prefix, so links need no
look-ups. Nodes with the same schema path (`texts[].prov[]`) form one flat table.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_FIELDS = "dewey array<int>, parent array<int>, path string, ordinal int, value string, fields map<string,string>"
_ARROW = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
_START = re.compile(r"[\[{]")
_BLANK = " \t\r\n﻿​\x00"


def parse(raw: str | None):
    """The one complete JSON document in raw, possibly behind stray characters; None where there is none."""
    if raw is None or not (m := _START.search(raw)):
        return None
    try:
        found, end = json.JSONDecoder(strict=False).raw_decode(raw, m.start())
    except (ValueError, RecursionError):
        return None
    return None if raw[end:].strip(_BLANK) else found


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def walk(document, wanted=None, scalars=None):
    """(label, schema path, ordinal, scalar, scalar fields) of every node whose path is wanted, in document order."""
    stack = [((), "", 0, document)]
    while stack:
        label, path, ordinal, x = stack.pop()
        if isinstance(x, dict):
            if wanted is None or wanted(path):
                yield label, path, ordinal, None, [(k, _text(v)) for k, v in x.items() if not isinstance(v, (dict, list)) and (scalars is None or k in scalars)]
            inner = [(label + (i,), f"{path}.{k}" if path else k, i, v) for i, (k, v) in enumerate(x.items()) if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            if wanted is None or wanted(path):
                yield label, path, ordinal, None, []
            inner = [(label + (i,), path + "[]", i, v) for i, v in enumerate(x)]
        else:
            if wanted is None or wanted(path):
                yield label, path, ordinal, _text(x), []
            continue
        stack.extend(reversed(inner))


def nodes(records: DataFrame, key: str, raw: str, paths: str | None = None, scalars: tuple[str, ...] | None = None) -> DataFrame:
    """(key, dewey, parent, path, ordinal, value, fields): one row per node of each record's JSON document.

    paths: a regular expression; only nodes whose whole schema path matches it come out (labels stay the same). scalars:
    the scalar fields that are kept, all by default. Records
    that are null, cut off, or hold something after the document give no nodes; rows with a null key take no part; equal
    rows come out once. `fields` has the scalar fields of an object, nulls included; `value` a scalar element.
    """
    kind = dict(records.dtypes)[key]
    wanted = re.compile(paths).fullmatch if paths else None

    def run(batches):
        for batch in batches:
            at, columns = [], [[] for _ in _ARROW]
            size = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                document = parse(text)
                if document is None:
                    continue
                for label, path, ordinal, value, fields in walk(document, wanted, scalars):
                    at.append(i)
                    for column, x in zip(columns, (label, label[:-1], path, ordinal, value, fields)):
                        column.append(x)
                    size += 1
                if size >= 20_000:
                    yield _batch(batch, at, columns, key)
                    at, columns, size = [], [[] for _ in _ARROW], 0
            yield _batch(batch, at, columns, key)

    rows = records.where(F.col(key).isNotNull()).select(key, raw)
    return rows.mapInArrow(run, f"`{key}` {kind}, {NODE_FIELDS}")


def _batch(batch, at, columns, key):
    arrays = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, _ARROW)]
    return pa.RecordBatch.from_arrays(arrays, [key, "dewey", "parent", "path", "ordinal", "value", "fields"])


def ancestor(dewey: Column, up: int) -> Column:
    """The label `up` levels above."""
    return F.slice(dewey, 1, F.greatest(F.size(dewey) - up, F.lit(0)))


def flat_table(all_nodes: DataFrame, path: str, columns: dict[str, str]) -> DataFrame:
    """The nodes of one schema path as a flat table: their keys, labels, and the named scalar fields as columns."""
    key = all_nodes.columns[0]
    picked = [F.col("fields")[source].alias(name) for name, source in columns.items()]
    return all_nodes.where(F.col("path") == path).select(key, "dewey", "parent", "ordinal", *picked)


# The shape of parsed documents: where items are and what hangs on them.
ITEM = r"body|(?:texts|groups|tables|pictures)\[\]"
REFERENCES = ("children", "captions", "footnotes")


LINK_FIELDS = ("self_ref", "$ref", "cref")


def document_nodes(records: DataFrame, key: str = "record_id", raw: str = "raw", scalars: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of parsed documents that items, page positions, cells and references are made of, equal ones once."""
    found = nodes(records, key, raw, rf"(?:{ITEM})(?:\.(?:{'|'.join(REFERENCES)}|prov)\[\]|\.data\.grid\[\]\[\])?", scalars)
    return found.dropDuplicates([key, "dewey"])


def items(document: DataFrame) -> DataFrame:
    """(record_id, item_dewey, collection, self_ref, label, content_layer, name, text): bodies, texts, groups, tables and pictures.

    An item without a self_ref is known by its place (`#/texts/3`).
    """
    key = document.columns[0]
    collection = F.regexp_extract("path", r"^[a-z]+", 0)
    place = F.when(F.col("path") == "body", F.lit("#/body")).otherwise(F.concat(F.lit("#/"), collection, F.lit("/"), F.col("ordinal")))
    f = F.col("fields")
    return document.where(F.col("path").rlike(rf"^(?:{ITEM})$")).select(
        key,
        F.col("dewey").alias("item_dewey"),
        collection.alias("collection"),
        F.coalesce(f["self_ref"], place).alias("self_ref"),
        f["label"].alias("label"),
        f["content_layer"].alias("content_layer"),
        f["name"].alias("name"),
        f["text"].alias("text"),
    )


def attached(document: DataFrame) -> DataFrame:
    """(record_id, item_dewey, item_ref, part, dewey, ordinal, row, fields, value): references, page positions and cells with their item."""
    key = document.columns[0]
    part = F.regexp_extract("path", r"\.(children|captions|footnotes|prov|data\.grid)(?:\[\])+$", 1)
    parts = document.select(key, "dewey", "ordinal", "fields", "value", part.alias("part")).where("part <> ''")
    up = F.when(F.col("part") == "data.grid", 4).otherwise(2)
    parts = parts.withColumn("item_dewey", ancestor(F.col("dewey"), up)).withColumn("row", F.when(F.col("part") == "data.grid", F.element_at("dewey", -2)))
    owners = items(document).select(key, "item_dewey", F.col("self_ref").alias("item_ref"))
    return parts.join(owners, [key, "item_dewey"])


def links(document: DataFrame) -> DataFrame:
    """(record_id, parent_ref, child_ref, link): every link from an item to what is its child.

    children, captions, footnotes: each distinct reference whose target is an item of the record; prov: each page
    position as `<self_ref>/prov/<i>`; cell: each table cell as `<self_ref>/data/grid/<row>/<column>`.
    """
    key = document.columns[0]
    parts = attached(document)
    target = F.coalesce(F.col("fields")["$ref"], F.col("fields")["cref"], F.col("value"))
    known = items(document).select(key, F.col("self_ref").alias("child_ref")).distinct()
    references = parts.where(F.col("part").isin(*REFERENCES)).select(key, F.col("item_ref").alias("parent_ref"), target.alias("child_ref"), F.col("part").alias("link")).distinct()
    references = references.join(known, [key, "child_ref"], "left_semi").select(key, "parent_ref", "child_ref", "link")
    place = F.when(F.col("part") == "prov", F.concat_ws("/", "item_ref", F.lit("prov"), "ordinal")).otherwise(F.concat_ws("/", "item_ref", F.lit("data/grid"), "row", "ordinal"))
    own = parts.where(F.col("part").isin("prov", "data.grid")).select(
        key, F.col("item_ref").alias("parent_ref"), place.alias("child_ref"), F.when(F.col("part") == "prov", "prov").otherwise("cell").alias("link")
    )
    return references.unionByName(own).distinct()
