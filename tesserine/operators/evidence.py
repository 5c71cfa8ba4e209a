"""Finding quoted evidence in passages, in order and approximately."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.runtime import stage


TILE = (4096, 8192)  # segments and passages of one group that are compared in one task
SMALL = 2048  # segments of small groups that go together, about
DENSE_ROWS = 256  # up to so many passages every word is counted in a full row, beyond only words of a sixteenth of them
PAIRS = 2_000_000  # pairs with enough words that are held at once, about
CLOSE_WORDS = 1 << 20  # words of pairs that are brought in order at once, about
WINDOW = 32  # words of a chain at most
CLOSE = 3  # close words have their places within a passage's length divided by this
OUT_ROWS = 50_000  # rows of results in one batch


def in_order(segment: list, passage: list, least: float = 0.0, matcher: SequenceMatcher | None = None) -> float:
    """Share of the segment's words in the matching blocks of segment and passage; 0 where it surely is below `least`.

    The other blocks lie before or behind the longest one in both, so they hold no more than the words the two have in common
    there, in whatever order. A matcher that holds the passage already may be given.
    """
    if not segment:
        return 0.0
    matcher = matcher or SequenceMatcher(None, [], passage, autojunk=False)
    matcher.set_seq1(segment)
    if least:
        a, b, n = matcher.find_longest_match()
        most = n + _in_common(segment[:a], passage[:b]) + _in_common(segment[a + n :], passage[b + n :])
        if most < least * len(segment) - 1e-9:
            return 0.0
    return sum(m.size for m in matcher.get_matching_blocks()) / len(segment)


def _in_common(a: list, b: list) -> int:
    return (Counter(a) & Counter(b)).total()


def bag_coverage(segments: DataFrame, passages: DataFrame, least: float = 0.7) -> DataFrame:
    """(segment_id, item_id, shared, words, bag): pairs of one group where the passage has at least `least` of the segment's words.

    segments(segment_id, group, text), passages(item_id, group, text); words count as often as they occur. The coverage in
    order is never larger. What is moved is the hashed words of segments and passages, not pairs of them.
    """
    return _compared(segments, passages, least, False).withColumn("bag", F.col("shared") / F.col("words"))


def coverage(segments: DataFrame, passages: DataFrame, least: float = 0.7) -> DataFrame:
    """(segment_id, item_id, coverage) of the pairs of one group whose coverage in order is at least `least`."""
    return _compared(segments, passages, least, True)


def _compared(segments: DataFrame, passages: DataFrame, least: float, ordered: bool) -> DataFrame:
    """Segments and passages of a group meet in one task; those of large groups in tiles, those of small ones in buckets of groups."""
    hashed = F.transform(T.terms(F.col("text"), ()), lambda t: F.xxhash64(t)).alias("t")
    known = segments.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("s")).join(passages.groupBy("group").agg(F.count("*").alias("p")), "group")
    known = stage(known, "groups")
    large = known.where((F.col("s") > TILE[0]) | (F.col("p") > TILE[1])).select("group", F.ceil(F.col("s") / TILE[0]).alias("sides"), F.ceil(F.col("p") / TILE[1]).alias("tops"))
    total = known.agg(F.sum("s")).first()[0] or 0
    buckets = F.lit(int(total // SMALL) + 1)

    def tiled(rows: DataFrame, key: str, own: str, other: str, at: list[str]) -> DataFrame:
        rows = rows.where("group IS NOT NULL").select(key, "group", hashed).where(F.size("t") > 0).join(F.broadcast(large), "group", "left")  # a large group has over 4,096 rows
        bucket = F.when(F.col("sides").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), buckets))).otherwise(F.concat(F.lit("g"), F.col("group").cast("string")))
        here = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).alias(at[0])
        return rows.select(key, "group", "t", bucket.alias("bucket"), here, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)).alias(at[1]))

    seg = tiled(segments, "segment_id", "sides", "tops", ["side", "top"])
    pas = tiled(passages, "item_id", "tops", "sides", ["top", "side"])
    names = ["coverage"] if ordered else ["shared", "words"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = []
        s_ids, p_ids = (t.column(c).combine_chunks() for t, c in ((left, "segment_id"), (right, "item_id")))
        for s_rows, p_rows in _shared_groups(left, right):
            s_words, p_words = _words_of(left, s_rows), _words_of(right, p_rows)
            for s, p, *values in _covered(s_words, p_words, least) if ordered else _bags(s_words, p_words, least):
                for i in range(0, len(s), OUT_ROWS):
                    at = slice(i, i + OUT_ROWS)
                    batches.append(pa.RecordBatch.from_arrays([s_ids.take(pa.array(s_rows[s[at]])), p_ids.take(pa.array(p_rows[p[at]])), *(pa.array(v[at]) for v in values)], ["segment_id", "item_id", *names]))
        if not batches:
            return pa.table({"segment_id": s_ids[:0], "item_id": p_ids[:0]} | {n: pa.array([], pa.float64() if ordered else pa.int64()) for n in names})
        return pa.Table.from_batches(batches)

    kinds = dict(seg.dtypes)["segment_id"], dict(pas.dtypes)["item_id"]
    schema = f"segment_id {kinds[0]}, item_id {kinds[1]}, " + ("coverage double" if ordered else "shared long, words long")
    key = ["bucket", "side", "top"]
    return seg.groupBy(*key).cogroup(pas.groupBy(*key)).applyInArrow(run, schema)


def _shared_groups(left: pa.Table, right: pa.Table):
    """The rows of every group that both have; repeated keys once."""
    found = []
    for table in (left, right):
        seen, by = set(), {}
        for i, (key, group) in enumerate(zip(table.column(0).to_pylist(), table.column("group").to_pylist())):
            if (group, key) not in seen:
                seen.add((group, key))
                by.setdefault(group, []).append(i)
        found.append(by)
    for group in found[0].keys() & found[1].keys():
        yield np.array(found[0][group]), np.array(found[1][group])


def _words_of(table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of rows one after another, and where each row's begin."""
    lists = table.column("t").take(pa.array(rows)).combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))


def _counts(code: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, number) of the known words (not -1) of rows."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys, n = np.unique((row * width + code)[code >= 0], return_counts=True)
    return keys // width, keys % width, n


def _coded(segments, passages):
    vocabulary, s_code = np.unique(segments[0], return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, passages[0]), len(vocabulary) - 1)
    return len(vocabulary), s_code, np.where(vocabulary[at] == passages[0], at, -1)


def _bags(segments, passages, least: float, part: int = OUT_ROWS):
    """(segment, passage, shared, words) of pairs with enough shared words, in parts: all words of a segment are counted up over all passages."""
    width, s_code, p_code = _coded(segments, passages)
    size, n = np.diff(segments[1]), len(passages[1]) - 1
    row, code, number = _counts(p_code, passages[1], width)
    by_code = np.argsort(code, kind="stable")
    row, number, bounds = row[by_code], number[by_code], np.searchsorted(code[by_code], np.arange(width + 1))
    kind = np.int16 if size.max() < 1 << 15 else np.int32
    number = np.minimum(number, size.max()).astype(kind)
    df = np.diff(bounds)
    often = np.flatnonzero(df > (0 if n <= DENSE_ROWS else n >> 4))
    dense = np.full(width, -1)
    dense[often] = np.arange(len(often))
    table = np.zeros((len(often), n), kind)
    in_table = dense[np.repeat(np.arange(width), df)]
    table[in_table[in_table >= 0], row[in_table >= 0]] = number[in_table >= 0]
    s_row, s_term, s_number = _counts(s_code, segments[1], width)
    s_number, s_bounds = s_number.astype(kind), np.searchsorted(s_row, np.arange(len(size) + 1))
    total, some = np.zeros(n, kind), np.zeros(n, kind)
    out: list = []
    rows = 0
    for s in range(len(size)):
        terms, times = s_term[s_bounds[s] : s_bounds[s + 1]], s_number[s_bounds[s] : s_bounds[s + 1]]
        at = dense[terms]
        if n <= DENSE_ROWS:
            total = np.minimum(table[at[at >= 0]], times[at >= 0, None]).sum(0, dtype=kind)
        else:
            total[:] = 0
            for t, d, m in zip(terms.tolist(), at.tolist(), times):
                if d >= 0:
                    np.minimum(table[d], m, out=some)
                    total += some
                elif bounds[t] < bounds[t + 1]:
                    total[row[bounds[t] : bounds[t + 1]]] += np.minimum(number[bounds[t] : bounds[t + 1]], m)
        found = np.flatnonzero(total >= np.ceil(least * size[s] - 1e-9))
        found = found[total[found] > 0]
        if len(found):
            out.append((np.full(len(found), s), found, total[found].astype(np.int64), np.full(len(found), size[s], np.int64)))
            rows += len(found)
        if rows >= part:
            yield [np.concatenate(c) for c in zip(*out)]
            out, rows = [], 0
    if out:
        yield [np.concatenate(c) for c in zip(*out)]


def _covered(segments, passages, least: float):
    """(segment, passage, coverage) of the pairs with enough words in order, in parts.

    Matching blocks are a common subsequence. So of the pairs with enough words, those are left out whose rare words stand in too
    different an order, many pairs at once, then those whose longest common subsequence is too short; the rest is aligned.
    """
    width, s_code, p_code = _coded(segments, passages)
    again = _again(s_code, segments[1], width)
    for s, p, shared, size in _bags(segments, passages, least, PAIRS):
        order = np.argsort(p, kind="stable")
        s, p, need = s[order], p[order], np.ceil(least * size[order] - 1e-9).astype(np.int64)
        kept = np.flatnonzero(_ordered(s, p, shared[order] - need, (s_code, segments[1], again), (p_code, passages[1]), width))
        s, p, need, values = s[kept], p[kept], need[kept], np.zeros(len(kept))
        bounds = np.flatnonzero(np.diff(p, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            places = _Places(p_code[passages[1][p[a]] : passages[1][p[a] + 1]])
            for i, j, enough in zip(range(a, b), s[a:b].tolist(), need[a:b].tolist()):
                rows = list(map(places.__getitem__, s_code[segments[1][j] : segments[1][j + 1]].tolist()))
                values[i] = _same_blocks(rows, places.length, enough) / len(rows)
        found = np.flatnonzero(values >= least)
        yield s[found], p[found], values[found]


def _again(code: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """How often each word stands in its row before."""
    keys = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * width + code
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    out = np.empty(len(code), np.int32)
    out[order] = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
    return out


def _ordered(s, p, spare, segments, passages, width: int) -> np.ndarray:
    """Whether the order of words that stand close together in the passage lets the pair lose no more than its spare words.

    Pairs stand in the order of their passages. A word can come before another where its first place lies before the other's last one. Of the
    close words, runs of WINDOW in the segment match no more than their longest chain of words of which each can come before the next.
    """
    (s_code, s_starts, again), (p_code, p_starts) = segments, passages
    out = np.ones(len(s), bool)
    first, last, times = np.zeros(width, np.int32), np.full(width, -1, np.int32), np.zeros(width, np.int32)
    bounds = np.flatnonzero(np.diff(p, prepend=-1, append=-1))
    begin, held, n = 0, [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        code = p_code[p_starts[p[a]] : p_starts[p[a] + 1]]
        at = np.flatnonzero(code >= 0).astype(np.int32)
        code = code[at]
        np.add.at(times, code, 1)
        last[code] = at
        first[code[::-1]] = at[::-1]
        far = code[(last[code] - first[code]) * CLOSE > len(at)]
        last[far] = -1
        size = s_starts[s[a:b] + 1] - s_starts[s[a:b]]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(s_starts[s[a:b]] - ends + size, size)
        word = s_code[where]
        close = np.flatnonzero(last[word] >= 0)
        word, row = word[close], np.repeat(np.arange(a, b), size)[close]
        held.append((row, first[word], last[word], again[where[close]] < times[word]))
        times[code], last[code] = 0, -1
        n += len(row)
        if n >= CLOSE_WORDS or b == len(p):
            row, low, high, counted = (np.concatenate(c) for c in zip(*held))
            out[begin:b] = np.bincount(row[counted] - begin, minlength=b - begin) - _chains(row - begin, low, high, b - begin) <= spare[begin:b]
            begin, held, n = b, [], 0
    return out


def _chains(row: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the lengths of the longest chains in its windows together."""
    size = np.bincount(row, minlength=n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    parts = -(-size // WINDOW)
    window = np.repeat(np.cumsum(parts) - parts, size) + at // WINDOW
    total = int(parts.sum())
    lows, highs = np.zeros((WINDOW, total), np.int32), np.full((WINDOW, total), -1, np.int32)
    lows[at % WINDOW, window], highs[at % WINDOW, window] = low, high
    length = np.zeros((WINDOW, total), np.int8)
    for i in range(WINDOW):
        for j in range(i):
            np.maximum(length[i], length[j] * (lows[j] < highs[i]), out=length[i])
        length[i] += highs[i] >= 0
    return np.bincount(np.repeat(np.arange(n), parts), length.max(0, initial=0), n).astype(np.int64)


class _Places(dict):
    """The places of a passage's words: of a word the number whose bits are set where it stands."""

    def __init__(self, code: np.ndarray):
        super().__init__()
        self.length, at = len(code), np.flatnonzero(code >= 0)
        self.order = at[np.argsort(code[at], kind="stable")]
        known, first, times = np.unique(code[self.order], return_index=True, return_counts=True)
        self.where = dict(zip(known.tolist(), zip(first.tolist(), (first + times).tolist())))

    def __missing__(self, word: int) -> int:
        first, end = self.where.get(word, (0, 0))
        if end - first < 8:
            bits = sum(1 << j for j in self.order[first:end].tolist())
        else:
            held = np.zeros(self.length, np.uint8)
            held[self.order[first:end]] = 1
            bits = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        self[word] = bits
        return bits


def _same_blocks(rows: list, length: int, need: int) -> int:
    """The words in the matching blocks of a segment and a passage of so many words, 0 where they are surely below `need`.

    rows: for every word of the segment the places in the passage, as bits. Blocks are those of difflib: the longest run (of equally
    long ones the first in the segment, then in the passage), then the same before and behind it.
    """
    found = [r for r in rows if r]
    if len(found) < need:
        return 0
    full = state = (1 << length) - 1
    for n, r in enumerate(found, 1):  # a zero in state for every word of the longest common subsequence so far
        here = state & r
        state = (state + here) | (state - here)
        if not n & 7 and length - (state & full).bit_count() + len(found) - n < need:
            return 0
    if length - (state & full).bit_count() < need:
        return 0
    same, open_most, todo = 0, len(found), [(rows, length, len(found))]
    while todo:
        rows, length, most = todo.pop()
        size, end, j = _longest(rows)
        same += size
        open_most += size - most
        at, to = end - size + 1, j - size + 1
        low = (1 << to) - 1
        for part, long in (([r & low for r in rows[:at]], to), ([r >> (j + 1) for r in rows[end + 1 :]], length - j - 1)):
            if most := min(sum(map(bool, part)), long):
                todo.append((part, long, most))
                open_most += most
        if open_most < need:
            return 0
    return same


def _longest(rows: list) -> tuple[int, int, int]:
    """Length of the longest run (of several words one after another in both) and its last place in the segment and in the passage."""
    powers, size = [rows], 1
    while any(more := [0] * size + [b & (a << size) for a, b in zip(powers[-1], powers[-1][size:])]):
        powers.append(more)
        size *= 2
    best = powers.pop()
    step = size
    while powers:
        step //= 2
        if any(more := [0] * size + [b & (a << size) for a, b in zip(powers.pop(), best[size:])]):
            best, size = more, size + step
    end = next(i for i, r in enumerate(best) if r)
    return size, end, (best[end] & -best[end]).bit_length() - 1


def quotes_found(evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """evidence(question_id, chunk_id, quote) with `status`: ok, unknown passage, blank quote or absent quote; white space does not count."""
    known = passages.select("chunk_id", T.collapsed(F.col("text")).alias("body"), F.lit(True).alias("known"))
    joined = evidence.join(known, "chunk_id", "left")
    quote = T.collapsed(F.coalesce("quote", F.lit("")))
    status = F.when(F.col("known").isNull(), "unknown passage").when(quote == "", "blank quote").when(~F.contains(F.coalesce("body", F.lit("")), quote), "absent quote").otherwise("ok")
    return joined.select(*evidence.columns, status.alias("status"))
