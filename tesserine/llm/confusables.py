"""One consistent form for text that looks the same but differs in its characters.

Skeleton of a text: decompose, replace every character by its prototype from a look-alike table, decompose again.
Texts that look alike get equal skeletons; letter case, accents, digits, wording and super- or subscripts stay apart,
because they are visible. What is invisible vanishes, every kind of blank becomes a space (the number of blanks and
line ends stay), and width, ligatures and font variants resolve through the decompositions Unicode gives for them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Letters of other scripts and the Latin (or, for want of one, Greek) letter they cannot be told from.
LOOK_ALIKES = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ρp ϲc ϳj ιı αɑ γɣ "
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҺH ԚQ ԜW ԌG аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl ґґ "
    "ՕO ՏS օo սu հh ցg զq ոn ռn յj ԱU ℓl ɡg ꜱs ᴄc ᴏo ᴠv ᴡw ᴢz ӀI ʼ’ "
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    "ⲞO ⲟo ⲤC ⲥc ⲢP ⲣp ⲎH ⲘM ⲚN ⲔK ⲦT ⲨY ⲬX ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
)
# Hyphens that print as the plain one.
SAME_MARKS = {"‐": "-", "‑": "-", "­": ""}
# Names of compatibility characters that print as what they decompose to.
SAME_PRINT = ("ROMAN NUMERAL", "SMALL ROMAN NUMERAL", "KANGXI RADICAL", "CJK RADICAL")
# Decompositions whose result looks the same as the character itself; <super>, <sub>, <fraction>, <circle>, <square> differ visibly.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


def _resolved(ch: str) -> str:
    """ch through its canonical and its equal-looking compatibility decompositions."""
    form = unicodedata.decomposition(ch)
    if not form:
        return unicodedata.normalize("NFD", ch)
    tag, _, rest = form.partition(" ") if form.startswith("<") else ("", "", form)
    if tag and tag not in SAME_LOOK:
        return ch
    parts = "".join(chr(int(x, 16)) for x in rest.split())
    name = unicodedata.name(ch, "")
    if tag == "<compat>" and "LIGATURE" not in name and not name.startswith(SAME_PRINT) and not 0x1C4 <= ord(ch) <= 0x1F3 and ch != "µ":
        return ch  # spacing accents, dots, numbered forms and variant letters keep their own look
    return "".join(map(_resolved, parts))


@cache
def prototypes() -> dict[int, str]:
    """Code point -> what it is replaced by, for every code point that is replaced at all."""
    alike = {pair[0]: pair[1] for pair in LOOK_ALIKES.split() if pair[0] != pair[1]}
    table: dict[int, str] = {}
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Zs":
            to = " "
        elif ch in SAME_MARKS:
            to = SAME_MARKS[ch]
        elif kind == "Cf" or 0xFE00 <= code <= 0xFE0F or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            to = ""
        elif 0xAC00 <= code <= 0xD7A3:
            continue  # Hangul syllables: normalisation splits them
        else:
            to = alike.get(ch) or "".join(alike.get(c, c) for c in _resolved(ch))
        if to != ch:
            table[code] = to
    return table


def skeleton(text: str) -> str:
    """The form that look-alike texts share."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


def consistent(text: str) -> str:
    """The skeleton in composed form: what a text is stored as."""
    return unicodedata.normalize("NFC", skeleton(text))


def unified(df: DataFrame, *columns: str) -> DataFrame:
    """df with the text (or array of text) columns in their consistent form, everything else as it is.

    Nulls stay null, empty text stays empty. Rows of plain ASCII never leave the columns they are in unchanged.
    """
    schema = df.schema
    if unknown := [c for c in columns if c not in schema.names]:
        raise ValueError(f"no such columns: {unknown}")

    def run(batches):
        for batch in batches:
            arrays = list(batch.columns)
            for c in columns:
                i = batch.schema.get_field_index(c)
                arrays[i] = pa.array([_each(v) for v in arrays[i].to_pylist()], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return df.mapInArrow(run, StructType(schema.fields))


def _each(value):
    if value is None:
        return None
    if isinstance(value, str):
        return value if value.isascii() else consistent(value)
    return [_each(v) for v in value]


def _joined(path: Column) -> Column:
    """An array of text as one text in which elements and nulls stay apart (skeletons hold neither \\u0000 nor \\u0001)."""
    return F.array_join(F.transform(path, lambda p: F.coalesce(p, F.lit("\u0001"))), "\u0000")


def _digest(text: Column, name: str) -> tuple[Column, Column]:
    """128 bits as two numbers, which aggregate by hash where binary values would be sorted."""
    return F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit(name), text).alias(f"{name}2")


def forms(df: DataFrame, key: str, value: str, scope: str | None = None) -> DataFrame:
    """(key, scope, form1, form2, raw1, raw2): 128-bit digests of the skeleton and of the value itself, one row per key and value; null values take no part.

    value: a text or array of text column; arrays compare element by element.
    """
    is_list = dict(df.dtypes)[value].startswith("array")
    text = _joined(F.col(value)) if is_list else F.col(value)
    rows = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), (F.col(scope) if scope else F.lit("")).alias("scope"), text.alias("text")
    )
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    raw, text = _digest(F.col("text"), "raw"), F.col("text")
    same = [F.xxhash64(text).alias("form1"), F.xxhash64(F.lit("raw"), text).alias("form2")]
    plain = rows.where(ascii_only).select("key", "scope", *same, *raw)

    def run(batches):
        for batch in batches:
            made = pa.array([skeleton(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made, batch.column(3), batch.column(4)], ["key", "scope", "text", "raw1", "raw2"])

    other = rows.where(~ascii_only).select("key", "scope", "text", *raw).mapInArrow(run, "key string, scope string, text string, raw1 long, raw2 long")
    return plain.unionByName(other.select("key", "scope", *same, "raw1", "raw2")).distinct()


def _mixed(rows: DataFrame, group: list[str]) -> DataFrame:
    """The groups that hold two different values."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("raw1", "raw2") for n, f in (("least", F.min), ("most", F.max))]
    return rows.groupBy(*group).agg(*ends).where("least_raw1 <> most_raw1 or least_raw2 <> most_raw2").select(*group)


def look_alikes(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, key_lo, key_hi): pairs of keys of one scope whose values look the same but differ, from the rows of forms().

    A listing of pairs is as long as it has pairs; only groups that hold two different values are joined, value against
    other value, so copies of the same value are never paired. Large groups are split by the engine's skew handling.
    Where a listing of pairs is not what is needed, look_alike_classes gives one row a key.
    """
    group = [*by, "scope", "form1", "form2"]
    rows = rows.join(_mixed(rows, group), group)
    a, b = (rows.select(*group, F.col("key").alias(f"key_{x}"), F.col("raw1").alias(f"one_{x}"), F.col("raw2").alias(f"two_{x}")) for x in "ab")
    pairs = a.join(b, group).where("key_a < key_b and (one_a <> one_b or two_a <> two_b)")
    return pairs.select(*by, F.col("key_a").alias("key_lo"), F.col("key_b").alias("key_hi"))


def look_alike_classes(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, key, class_key, links): every key that looks like one with another value, from the rows of forms(); one row a key and class.

    class_key is the smallest key of the class, links the number of its keys whose value differs from this one's. Counts by
    value combine before they are moved, so a class of any size costs a row a partition and value, and no pairs are formed.
    """
    group, value = [*by, "scope", "form1", "form2"], ["raw1", "raw2"]
    each = rows.groupBy(*group, *value).agg(F.count("*").alias("same"), F.min("key").alias("first"))
    whole = each.groupBy(*group).agg(F.sum("same").alias("all"), F.min("first").alias("class_key"), F.count("*").alias("values")).where("values > 1")
    known = each.join(whole, group).select(*group, *value, "class_key", (F.col("all") - F.col("same")).alias("links"))
    return rows.join(known, [*group, *value]).select(*by, "key", "class_key", "links")
