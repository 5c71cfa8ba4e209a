"""Splitting oversized items at natural boundaries, by pointer doubling.

Sizes are ceil(1.3 * words). Every place between two words is a boundary with a rank: before a heading of the item's
path, at a paragraph, a line, a sentence, a clause, or merely between words. Every boundary is joined to its farthest
legal successor: the last boundary of the best rank for which the piece, overlap included, stays within the limit.
Squaring the successor tables (all items of an Arrow batch are one table) yields all greedy cuts in a logarithmic
number of vectorised steps instead of one step a piece. An item is one row, so no shuffle is needed to split it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.runtime import once

TOKENS_PER_WORD = 1.3
WORD = re.compile(r"\S+")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
LINE = re.compile(r"\n+")
SENTENCE = re.compile(r"[.!?…][\"'»”’)\]]*\s+(?=[\"'«“‘(\[¿¡]*[^\W_a-zß-öø-ÿ])")
CLAUSE = re.compile(r"[;:,)]\s+|\s(?=[(])")
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("e.g.", "i.e.", "Fig.", "fig.", "cf.", "vs.", "approx.", "etc.", "No.", "Eq.", "z.", "B.", "z.B.", "d.h.", "bzw.", "p.", "ex.", "Abb.", "Dr.", "St.")
TEXT_RANKS = ((PARAGRAPH, 4), (LINE, 3), (SENTENCE, 3), (CLAUSE, 1))
KIND_RANKS = {
    "table": ((PARAGRAPH, 3), (LINE, 4)),  # rows stay whole; what precedes the grid is one unit with it
    "code": ((re.compile(r"\n\s*\n"), 4), (re.compile(r"\n(?=\S)"), 3), (LINE, 2)),  # blank lines, then statements that start a line
    "list_item": ((re.compile(r"\n\s*(?=[-*•]\s)"), 4), (PARAGRAPH, 4), (LINE, 3), (SENTENCE, 2), (CLAUSE, 1)),
}
# How much of its room a piece must use to end at a boundary of the rank; a better rank may cost more room.
LEAST_FILL = {5: 0.1, 4: 0.35, 3: 0.5, 2: 0.5, 1: 0.6, 0: 0.0}
PIECES = "item_key string, piece_no int, start_char int, new_char int, end_char int, tokens int, text string"


def tokens(words: int) -> int:
    return math.ceil(words * TOKENS_PER_WORD)


def _ranks(text: str, starts: np.ndarray, kind: str | None, path: list | None) -> np.ndarray:
    """Rank of the boundary before every word; -1: no cut there."""
    rank = np.zeros(len(starts), np.int8)
    for pattern, value in KIND_RANKS.get(kind or "", TEXT_RANKS):
        ends = []
        for m in pattern.finditer(text):
            if pattern is SENTENCE and _abbreviated(text, m.start()):
                continue
            ends.append(m.end())
        if ends:
            at = np.searchsorted(starts, ends)
            at = at[at < len(starts)]
            rank[at] = np.maximum(rank[at], value)
    for heading in path or ():
        if heading:
            for m in re.finditer(rf"(?m)^[ \t#]*{re.escape(heading)}[ \t]*$", text):
                before, after = np.searchsorted(starts, [m.start(), m.end()])
                if before < len(rank):
                    rank[before] = 5
                rank[before + 1 : after + 1] = -1  # a heading stays with what follows
    return rank


def _abbreviated(text: str, dot: int) -> bool:
    start = dot
    while start > 0 and dot - start < 8 and not text[start - 1].isspace():
        start -= 1
    return text[start : dot + 1].lstrip("([\"'") in ABBREVIATIONS


def _successors(rank: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Farthest legal cut after a cut before word i (the first piece has no overlap), for every i in 0..n."""
    n = len(rank)
    i = np.arange(n + 1)
    last = np.minimum(np.where(i == 0, 0, np.maximum(i - overlap, 0)) + limit, n)
    result = np.full(n + 1, -1)
    for value, fill in LEAST_FILL.items():
        least = i + np.maximum(1, ((last - i) * fill).astype(np.int64))
        at = np.flatnonzero(rank == value)
        if len(at):
            spot = np.searchsorted(at, last, side="right") - 1
            found = np.where(spot >= 0, at[np.maximum(spot, 0)], -1)
            result = np.where((result < 0) & (found >= least), found, result)
    result = np.where(result < 0, last, result)  # nothing allowed: a plain cut at the limit
    return np.where(last == n, n, result)


def cuts(successors: list[np.ndarray]) -> list[np.ndarray]:
    """All cuts of every item from the tables of its successors, by doubling over all items at once."""
    sizes = np.array([len(s) for s in successors])
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    jump = np.concatenate([s + b for s, b in zip(successors, base)])
    end = base + sizes - 1
    item, order, place = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), base.copy()
    step = 1
    while True:
        done = np.zeros(len(sizes), bool)
        done[item[place == end[item]]] = True
        live = ~done[item]
        if not live.any():
            break
        reached = jump[place[live]]
        more, at = item[live], order[live] + step
        item, order, place = np.concatenate([item, more]), np.concatenate([order, at]), np.concatenate([place, reached])
        keep = np.lexsort((order, item))
        item, order, place = item[keep], order[keep], place[keep]
        first = np.r_[True, (item[1:] != item[:-1]) | (place[1:] != place[:-1])]  # the end repeats
        item, order, place = item[first], order[first], place[first]
        jump, step = jump[jump], step * 2
    split = np.flatnonzero(np.diff(item)) + 1
    return [p - b for p, b in zip(np.split(place, split), base)]


def pieces(text: str, kind: str | None, path: list | None, limit: int, overlap: int):
    """(word bounds, successor table) of one item, or None where it fits."""
    bounds = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    if tokens(len(bounds)) <= limit:
        return None
    words, lap = int(limit / TOKENS_PER_WORD), int(overlap / TOKENS_PER_WORD)
    return bounds, _successors(_ranks(text, bounds[:, 0], kind, path), words, lap)


def split_oversized(items: DataFrame, key: str, text: str = "text", kind: str | None = "kind", path: str | None = "heading_path", limit: int = 400, overlap: int = 50) -> DataFrame:
    """(item_key, piece_no, start_char, new_char, end_char, tokens, text) of every item of more than `limit` tokens.

    Pieces hold at most `limit` tokens; each piece after the first starts with the last int(overlap / 1.3) words of the
    one before (they hold `overlap` tokens) and brings new text from new_char on; text[start_char:end_char] is the piece.
    The pieces' new parts in order hold every word of the item once. Null and empty texts fit any limit. A repeated row
    (same key, same content) is split once; rows with a null key take no part. Other columns are ignored.
    """
    if limit < 2 or not 0 <= overlap < limit / 2:
        raise ValueError("limit must be at least 2 and overlap less than half of it")
    lap = int(overlap / TOKENS_PER_WORD)
    shortest = 2 * (int(limit / TOKENS_PER_WORD) + 1) - 1  # characters of the shortest text that can be over the limit
    rows = items.where(F.col(key).isNotNull() & (F.length(text) >= shortest)).select(
        F.col(key).alias("item_key"),
        F.col(text).alias("text"),
        (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"),
        (F.col(path) if path else F.lit(None).cast("array<string>")).alias("path"),
    )

    def run(batches):
        for batch in batches:
            found = []
            for k, t, kd, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (x := pieces(t, kd, p, limit, overlap)) is not None:
                    found.append((k, t, *x))
            out: list[list] = [[] for _ in range(7)]
            if found:
                for (k, t, bounds, _), cut in zip(found, cuts([f[3] for f in found])):
                    for no, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                        s = max(0, a - lap) if no else 0
                        row = (k, no, bounds[s, 0], bounds[a, 0], bounds[b - 1, 1], tokens(int(b - s)), t[bounds[s, 0] : bounds[b - 1, 1]])
                        for column, value in zip(out, row):
                            column.append(value)
            kinds = (pa.string(), *[pa.int32()] * 5, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, kd) for c, kd in zip(out, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return once(rows, "item_key").mapInArrow(run, PIECES)
