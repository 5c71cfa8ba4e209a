"""Several values packed in one field, split into one value per row with its position.

The delimiters of a source (here: a field) are inferred from all of its rows: each candidate is scored by how consistent
the number of pieces is that it makes from row to row, and by how regular their types are (the types of the source's
undivided values, one type a row). Quoted and bracketed lists are read by their own syntax. The delimiters are chosen once
a source; a row is split by those of them that occur in it, the strongest first, only where all pieces come out regular.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.runtime import once, stage

# Candidate delimiters, strongest first; the name is what scores are kept by.
CANDIDATES = {
    "newline": r"\s*\n+\s*", "tab": r"[^\S\n]*\t+[^\S\n]*", "double pipe": r"\s*\|\|\s*", "double dash": r"\s+--\s+", "pipe": r"\s*\|\s*", "semicolon": r"\s*;\s*",
    "slash": r"\s+/\s+", "ampersand": r"\s+&\s+", "spaced comma": r"\s*,\s+|\s+,", "and": r",?\s+(?:and|und|et|y)\s+", "comma": r",", "blank": r"[  ]+",
}
_DELIMITERS = {name: re.compile(pattern) for name, pattern in CANDIDATES.items()}
# What a text must hold for a candidate to occur in it; looked for first, because that costs little.
_HOLDS = {"newline": "\n", "tab": "\t", "double pipe": "||", "double dash": "--", "pipe": "|", "semicolon": ";", "slash": "/", "ampersand": "&", "spaced comma": ",", "comma": ",", "and": "", "blank": ""}
WITHIN_SENTENCES = frozenset(("spaced comma", "and", "comma", "blank", "ampersand"))  # these never part sentences
ACCEPT = 0.3  # least score of a delimiter
COMMON = 0.02  # least share of a type among the undivided values of its source
INVISIBLE = tuple("​‌‍⁠﻿")
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
_GROUPED = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:[     '’]\d{3})+(?:[.,]\d+)?|\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?|\d*\.\d+|\d+(?:,\d+)?"
_POWER = r"(?:[eE][+\-−]?\d+|\s*[×x*·]\s*10\^?[+\-−]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)?"
_ONE = rf"[+\-−]?(?:{_GROUPED}){_POWER}"
_ABOUT = r"(?:(?:approx\.?|about|around|circa|ca?\.)\s*|[~≈±]\s*)?"
_NUMBER = re.compile(rf"{_ABOUT}{_ONE}(?:\s*(?:[-–—]|to|bis|à)\s*{_ONE})?(?:\s*%)?")
_AMOUNT = re.compile(rf"{_ABOUT}{_ONE}(?:\s*(?:[-–—]|to|bis|à)\s*{_ONE})?\s*[^\W\d_°%][^\d,;|]*(?:\^?[23]|CO2e?|CO₂e?)?")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://\S+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://")
_CODE = re.compile(r"(?=[^\s]*\d)(?=[^\s]*[^\W\d_])[\w.:\-]+")
_NAME = re.compile(r"[^\W\d_a-zß-öø-ÿ][\w.'’\-]*(?:\s+(?:[^\W\d_a-zß-öø-ÿ][\w.'’\-]*|of|de|la|von|der)){0,3}")


CACHED = 64  # characters of a piece whose type is remembered


def kind_of(piece: str) -> str:
    """Type of a piece: url, number, amount, code, name, sentence, or loose (words that are none of these)."""
    return _short_kind(piece) if len(piece) <= CACHED else _kind(piece)


def _kind(piece: str) -> str:
    if not piece:
        return "empty"
    if _SCHEME.match(piece):
        return "url" if _URL.fullmatch(piece) and len(_SCHEME.findall(piece)) == 1 else "loose"
    if _NUMBER.fullmatch(piece):
        return "number"
    if len(piece) < 48 and _AMOUNT.fullmatch(piece):
        return "amount"
    if _CODE.fullmatch(piece):
        return "code"
    words = len(piece.split())
    if words <= 4 and _NAME.fullmatch(piece):
        return "name"
    first = piece.lstrip("\"'“‘«(¿¡[")[:1]
    return "sentence" if words >= 5 and (first.isupper() or first.isdigit()) else "loose"


_short_kind = lru_cache(1 << 16)(_kind)
REGULAR = frozenset(("url", "number", "amount", "code", "name", "sentence"))
ALIKE = {"amount": "number"}  # types that may stand side by side in one list


def _trimmed(text: str) -> str:
    if not text.isascii():
        for c in INVISIBLE:
            if c in text:
                text = text.replace(c, "")
    return text.strip()


def _unquoted(piece: str) -> str:
    """A piece without surrounding blanks and enclosing quotes, quotes inside restored."""
    piece = _trimmed(piece)
    if len(piece) >= 2 and _QUOTES.get(piece[0]) == piece[-1]:
        inner, q = piece[1:-1], piece[0]
        bare = inner.replace(q + q, "").replace("\\" + q, "")
        if q not in bare:
            return _trimmed(inner.replace(q + q, q).replace("\\" + q, q))
    return piece


_STOPS = {end: re.compile(f"[\\\\{end}]") for end in set(_QUOTES.values())}
_BETWEEN = re.compile(r"[\s,;|&/\-]*(?:and|und|et|y)?[\s,;|&/\-]*")


def quoted_list(text: str) -> list[str] | None:
    """The elements of a list of quoted values with anything short between them, or None where text is not one."""
    i, out = 0, []
    while i < len(text):
        q = text[i]
        if q not in _QUOTES:
            return None
        end, got, i = _QUOTES[q], [], i + 1
        while True:
            stop = _STOPS[end].search(text, i)
            if stop is None:
                return None
            got.append(text[i : stop.start()])
            i = stop.start()
            after = text[i + 1 : i + 2]
            if text[i] == "\\":
                escaped = after != "" and after in "\"'\\/nt"
                got.append({"n": "\n", "t": "\t"}.get(after, after) if escaped else "\\")
                i += 2 if escaped else 1
            elif end == q == after and any(got):
                got.append(q)
                i += 2
            elif end not in "'’" or not after.isalnum():
                i += 1
                break
            else:
                got.append(end)
                i += 1
        out.append(_trimmed("".join(got)))
        between = _BETWEEN.match(text, i).end()
        if between < len(text) and between == i:
            return None
        i = between
    return out


def listed(text: str) -> tuple[list[str] | None, str]:
    """(elements, rest): the elements where text is a list by its own syntax, else None and the text without brackets."""
    t = _trimmed(text)
    bracketed = len(t) >= 2 and _BRACKETS.get(t[0]) == t[-1]
    if bracketed and t[0] == "[":
        try:
            got = json.loads(t)
            if isinstance(got, list):
                return [_trimmed(x if isinstance(x, str) else json.dumps(x)) for x in got if x is not None and not isinstance(x, (list, dict))], t
        except ValueError:
            pass
    if bracketed and t[1:-1].count(t[0]) == t[1:-1].count(t[-1]) and (t[0] != "(" or t.find(")") == len(t) - 1 or "(" in t[1:]):
        t = _trimmed(t[1:-1])
    if t[:1] in _QUOTES and (got := quoted_list(t.rstrip(" ,;|"))) is not None:
        return got, t
    return None, t


def _raw_pieces(text: str, name: str) -> list[str]:
    if "://" not in text:
        return _DELIMITERS[name].split(text)
    joined, at = [], 0  # a delimiter inside a URL is none: pieces that do not start one belong to the piece before
    for m in _DELIMITERS[name].finditer(text):
        if _SCHEME.match(text, m.end()) or not text[m.end() :].strip(" ;,|"):
            joined.append(text[at : m.start()])
            at = m.end()
    return [*joined, text[at:]]


def _cut(text: str, name: str) -> list[str]:
    return [p for p in map(_unquoted, _raw_pieces(text, name)) if p.strip(" ;,|")]


_ANY = re.compile("|".join(CANDIDATES[n] for n in CANDIDATES if n not in ("blank", "and", "comma")))


def _look(raw: str) -> tuple[str | None, str, str] | None:
    """Type of a piece as it was cut, or None in the first place where it is irregular: then the types of its first and its
    last part between any candidates count. Empty places look like nothing at all."""
    piece = _unquoted(raw)
    if not piece.strip(" ;,|"):
        return None
    kind = kind_of(piece)
    if kind in REGULAR:
        kind = ALIKE.get(kind, kind)
        return kind, kind, kind
    parts = [x for x in map(_unquoted, _ANY.split(piece)) if x] or [piece]
    first, last = kind_of(parts[0]), kind_of(parts[-1])
    return None, ALIKE.get(first, first), ALIKE.get(last, last)


_short_look = lru_cache(1 << 17)(_look)


def _looks(text: str, name: str) -> list[tuple]:
    return [look for look in [_short_look(p) if len(p) <= CACHED else _look(p) for p in _raw_pieces(text, name)] if look]


def _beside(looks: list[tuple]) -> list[str]:
    """Types of what stands directly beside a delimiter."""
    out, last = [], len(looks) - 1
    for i, (kind, first, end) in enumerate(looks):
        if kind:
            out.append(kind)
        else:
            out += [first] * (i > 0) + [end] * (i < last)
    return out


def _split(text: str, accepted: list[str], depth: int = 0) -> list[str] | None:
    """The pieces of text by the accepted delimiters, or None where they do not come out regular and of one type."""
    for name in accepted:
        pieces = _cut(text, name) if _HOLDS[name] in text else ()
        if len(pieces) < 2:
            continue
        out: list[str] = []
        for p in pieces:
            inner = None
            if kind_of(p) not in REGULAR or name in WITHIN_SENTENCES and kind_of(p) == "sentence" or depth < 3 and any(_DELIMITERS[n].search(p) for n in accepted if n not in (name, "blank", "and", "comma", "ampersand")):
                inner = _split(p, accepted, depth + 1)
            out.extend(inner or [p])
        kinds = {ALIKE.get(k, k) for k in map(kind_of, out)}
        if len(kinds) == 1 and kinds <= REGULAR and not (name in WITHIN_SENTENCES and "sentence" in kinds):
            return out
    return None


def values_of(text: str | None, accepted: list[str]) -> list[str]:
    """The values of one field, in order."""
    if text is None:
        return []
    got, rest = listed(text)
    if got is not None:
        return [g for g in got if g]
    core = rest.strip(" \t\r\n;,|") if "://" not in rest else rest.strip()
    # in brackets a comma between digits that groups no thousands parts two values, elsewhere it is a decimal comma
    pair = len(rest) < len(_trimmed(text)) and re.fullmatch(r"\d+,\d+", core) and not re.fullmatch(r"\d{1,3},\d{3}", core)
    pieces = _split(core, accepted) if pair or kind_of(core) not in ("number", "url", "code", "amount") else None
    single = _unquoted(core if kind_of(core) == "url" else rest)
    return pieces or ([single] if single else [])


def delimiter_scores(fields: DataFrame) -> DataFrame:
    """(source, delimiter, rows, consistency, regularity, score) from (source, text) over all rows; score = consistency * regularity.

    consistency: how steady the number of pieces is over the rows with the delimiter, 1 / (1 + variance / mean), which is 1
    where all rows have equally many; regularity: share of pieces whose type is common among the source's values that hold
    no candidate but blanks, times the share of rows whose pieces all have one type.
    """

    def run(batches):
        for batch in batches:
            counts: dict = {}

            def add(source, name, what, n=1):
                key = (source, name, what)
                counts[key] = counts.get(key, 0) + n

            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got, rest = listed(text) if text else ([], "")
                if got is not None:
                    for g in got:
                        add(source, "", kind_of(g))
                    continue
                rest = rest.strip(" \t\r\n;,|") if "://" not in rest else rest.strip()
                seen = False
                for name in CANDIDATES:
                    looks = _looks(rest, name) if _HOLDS[name] in rest else ()
                    if len(looks) > 1:
                        seen = seen or name != "blank"
                        kinds = Counter(_beside(looks))
                        for k, n in kinds.items():
                            add(source, name, k, n)
                        add(source, name, ROWS)
                        add(source, name, ONE_TYPE, len(kinds) == 1)
                        add(source, name, PIECES, len(looks))
                        add(source, name, SQUARES, len(looks) ** 2)
                if not seen and rest:
                    add(source, "", ALIKE.get(kind_of(rest), kind_of(rest)))
            rows = [(*k, int(v)) for k, v in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["source", "delimiter", "kind", "n"])

    counted = fields.select("source", "text").mapInArrow(run, "source string, delimiter string, kind string, n long").groupBy("source", "delimiter", "kind").agg(F.sum("n").alias("n"))
    counted = stage(counted, "delimiter-counts")  # a few rows a source, read four times below
    whole = counted.where("delimiter = ''").groupBy("source").agg(F.sum("n").alias("all"))
    common = counted.where("delimiter = ''").join(whole, "source").where(F.col("kind").isin(*REGULAR) & (F.col("n") >= COMMON * F.col("all"))).select("source", "kind", F.lit(1).alias("common"))
    made = counted.where(F.col("delimiter") != "").where(~F.col("kind").isin(*COUNTERS)).join(common, ["source", "kind"], "left")
    usual = made.groupBy("source", "delimiter").agg((F.sum(F.col("n") * F.coalesce("common", F.lit(0))) / F.sum("n")).alias("usual"))
    total = lambda name: F.sum(F.when(F.col("kind") == name, F.col("n"))).alias(name)
    steady = counted.where(F.col("kind").isin(*COUNTERS)).groupBy("source", "delimiter").agg(*map(total, COUNTERS))
    mean = F.col(PIECES) / F.col(ROWS)
    consistency = 1 / (1 + (F.col(SQUARES) / F.col(ROWS) - mean * mean) / mean)
    both = usual.join(steady, ["source", "delimiter"]).withColumn("consistency", consistency).withColumn("regularity", F.col("usual") * F.col(ONE_TYPE) / F.col(ROWS))
    return both.select("source", "delimiter", F.col(ROWS).alias("rows"), "consistency", "regularity", (F.col("consistency") * F.col("regularity")).alias("score"))


ROWS, ONE_TYPE, PIECES, SQUARES = COUNTERS = ("rows", "one type", "pieces", "squares")


def unpacked(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, pos, item, n_values): every value of the fields, one per row, with its position from 1.

    A value is as written but without surrounding blanks, brackets and enclosing quotes; quotes inside are restored. Empty
    places do not count and give no rows, like null and empty fields. A range, a number with grouped digits, a sentence
    and a URL are one value each. Equal rows (in key and fields) count once; rows with a null key take no part.
    """
    kind = dict(rows.dtypes)[key]
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    single = once(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *fields), "_key", "_key", *fields)
    long = single.select(F.col("_key").alias("id"), stacked.alias("s")).select("id", "s.field", "s.text").where("text is not null")
    accepted = delimiter_scores(long.select(F.col("field").alias("source"), "text")).where(F.col("score") >= ACCEPT)
    order = {name: i for i, name in enumerate(CANDIDATES)}
    chosen: dict[str, list[str]] = {f: [] for f in fields}
    for r in accepted.collect():  # at most one row for each field and candidate
        chosen[r.source].append(r.delimiter)
    chosen = {f: sorted(names, key=order.get) for f, names in chosen.items()}

    def run(batches):
        for batch in batches:
            found = [values_of(t, chosen[f]) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["id", "field", "items"])

    split = long.mapInArrow(run, f"id {kind}, field string, items array<string>")
    out = split.select("id", "field", F.size("items").alias("n_values"), F.posexplode("items").alias("pos", "item"))
    return out.select(F.col("id").alias(key), "field", (F.col("pos") + 1).cast("int").alias("pos"), "item", "n_values")
