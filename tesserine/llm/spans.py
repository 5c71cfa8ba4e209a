"""Long exact spans shared between records.

Sliding sentence spans: from every cut of a text the run of RUN characters over the sentences that follow is hashed, runs
are joined globally, and what repeats is extended to the whole shared span. Texts are cut at ends of sentences and, where
a stretch of `least - RUN + 1` characters holds none, where the hash of the run is the least. Such a cut depends on the
run's own text only, so any two copies of a span of `least` characters, wherever they begin, hold an equal run.

Three ways lead from equal runs to exact spans, none of which looks at all pairs of a group:

* a run of exactly two records: both texts meet once and the match is extended to its ends;
* a run of more records: every record meets the one with the smallest key. Two others can share more with each other
  only where both leave that record's text at the same distance from the run and with the same character; windows of
  `least` characters are hashed (128 bits) around such places only;
* a run that some record holds more than once: windows of `least` characters around it are hashed in all its records.

Records with equal texts are one class from the start; only the first of them is looked at. Texts are moved for records
with a repeated run alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.runtime import small, stage

RUN = 104  # characters of a run
SEGMENT = 1 << 20  # characters whose runs are hashed at once
FEW = 1_000_000  # keys or hashes that are broadcast at most; more are joined by shuffle
ENDS = re.compile(r"[.!?][ \t\r\f\v\n]+|\n+")
_MARKS = np.array([ord(c) for c in ".!?。！？"], np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_TOP = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """Hashes of arbitrary ranges of one text (code points), from prefix sums modulo 2^64."""

    _powers: dict = {}

    def __init__(self, codes: np.ndarray, base: np.uint64 = _BASES[0]):
        n = len(codes)
        up, self.down = self.powers(base, n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(_mix(codes.astype(np.uint64) * _ODD + base) * up[:n], dtype=np.uint64)]

    @classmethod
    def powers(cls, base, n):
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                inverse = np.uint64(pow(int(base), -1, 1 << 64))
                have = tuple(np.r_[np.uint64(1), np.multiply.accumulate(np.full(size - 1, b, np.uint64))] for b in (base, inverse))
            cls._powers[base] = have
        return have

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ranges of `size` code points from every start."""
        with np.errstate(over="ignore"):
            return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _extreme(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over x[i : i + width] for every i with a whole window, from running extremes of blocks."""
    n = len(x) - width + 1
    padded = np.zeros(-(-len(x) // width) * width, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def sentence_runs(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, hash) of the runs of all texts, ordered by text and start.

    In every stretch of least - RUN + 1 starts the run with the least rank is taken; runs that begin with the end of a
    sentence rank before all others. Texts are laid side by side and hashed together, long ones in overlapping segments.
    """
    pieces = [(i, at, t[at : at + SEGMENT + least - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - least + 1), SEGMENT) if len(t) >= least]
    found: list[tuple] = []
    held, size = [], 0
    for p in pieces:
        held.append(p)
        size += len(p[2])
        if size >= SEGMENT:
            found.append(_runs(held, least))
            held, size = [], 0
    if held:
        found.append(_runs(held, least))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, start, h = (np.concatenate(x) for x in zip(*found))
    first = np.r_[True, (np.diff(text) != 0) | (np.diff(start) != 0)]  # segments overlap
    return text[first], start[first], h[first]


def _runs(pieces: list[tuple[int, int, str]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = least - RUN + 1
    codes = _codes("".join(p[2] for p in pieces))
    sizes = np.array([len(p[2]) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    h = Rolling(codes).all(RUN)
    ahead = codes[1 : len(h) + 1]
    ends = (np.isin(codes[: len(h)], _MARKS) & ((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))) | (codes[: len(h)] == 10)
    rank = (h >> np.uint64(1)) | np.where(ends, np.uint64(0), _TOP)
    lowest = _extreme(rank, width, np.minimum)
    whole = np.zeros(len(lowest) + 1, np.int32)  # stretches that lie in one piece
    np.add.at(whole, begin, 1)
    np.add.at(whole, np.minimum(begin + sizes - least + 1, len(lowest)), -1)
    lowest = np.where(np.cumsum(whole)[:-1] > 0, lowest, np.uint64(0))
    taken = _extreme(np.r_[np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)], width, np.maximum)
    at = np.flatnonzero((taken == rank) & (taken > 0))
    piece = np.searchsorted(begin, at, side="right") - 1
    return np.array([p[0] for p in pieces])[piece], at - begin[piece] + np.array([p[1] for p in pieces])[piece], h[at]


def common_after(a: str, b: str, i: int, j: int) -> int:
    """Number of equal characters of a from i and b from j on."""
    n, done, step = min(len(a) - i, len(b) - j), 0, 64
    while done < n:
        step = min(step, n - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            n = min(n, done + 2 * step)
    return done


def common_before(a: str, b: str, i: int, j: int) -> int:
    """Number of equal characters of a and b before i and j."""
    n, done, step = min(i, j), 0, 64
    while done < n:
        step = min(step, n - done)
        if a[i - done - step : i - done] == b[j - done - step : j - done]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
            n = min(n, done + 2 * step)
    return done


def _placed(texts: list[str], wanted: list, least: int) -> list[dict]:
    """For each text the starts of the wanted runs: hash -> starts."""
    number, start, h = sentence_runs(texts, least)
    out: list[dict] = [{} for _ in texts]
    sets = [set(w) for w in wanted]
    for i, s, x in zip(number.tolist(), start.tolist(), h.view(np.int64).tolist()):
        if x in sets[i]:
            out[i].setdefault(x, []).append(s)
    return out


def _classes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, first, copied) of every record, first being the smallest id with the same text; and the ids that are not first."""
    same = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2")]
    each = base.select("id", F.length("text").cast("long").alias("n"), *same).distinct()
    classes = each.groupBy("t1", "t2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    known = stage(each.join(classes, ["t1", "t2"], "left").select("id", "n", F.coalesce("first", "id").alias("first"), F.col("first").isNotNull().alias("copied")), "texts")
    return known, known.where("first <> id").select("id")


def _spans(unique: DataFrame, kind: str, least: int) -> DataFrame:
    """(id, lo, hi, later): shared spans of records with different texts; later: a record with a smaller key has it."""

    def runs(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            number, _, h = sentence_runs(texts, least)
            order = np.lexsort((h, number))
            number, h = number[order], h[order]
            first = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(h)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number[first])), pa.array(h[first].view(np.int64)), pa.array(times > 1)], ["id", "h", "again"])

    found = unique.mapInArrow(runs, f"id {kind}, h long, again boolean")
    groups = found.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"), F.max("again").alias("again")).where("a <> b")
    groups = stage(groups, "repeated-runs")
    many = groups.where("n > 2 or again").select("h", "a", "again")
    members = found.drop("again").join(small(many, FEW), "h")
    members = stage(members, "members-of-runs")
    pairs = groups.where("n = 2 and not again").select("a", "b", "h", F.lit(False).alias("star"))
    pairs = pairs.unionByName(members.where("not again and id <> a").select("a", F.col("id").alias("b"), "h", F.lit(True).alias("star")))
    pairs = stage(pairs.groupBy("a", "b").agg(F.collect_set(F.struct("h", "star")).alias("runs")), "pairs")
    loops = members.where("again").select("id", "h").distinct()
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(loops.select("id")).distinct()
    ids = stage(ids, "records")
    texts = stage(unique.join(small(ids, FEW), "id", "left_semi").dropDuplicates(["id"]), "candidates")

    def extended(batches):
        for batch in batches:
            a, b, ta, tb, runs = (batch.column(i) for i in range(5))
            texts, wanted, at = [], [], {}
            rows = list(zip(a.to_pylist(), b.to_pylist(), ta.to_pylist(), tb.to_pylist(), runs.to_pylist()))
            for x, y, tx, ty, rs in rows:
                for key, text in ((x, tx), (y, ty)):
                    if key not in at:
                        at[key] = len(texts)
                        texts.append(text), wanted.append([])
                    wanted[at[key]].extend(r["h"] for r in rs)
            places = _placed(texts, wanted, least)
            out: list[list] = [[] for _ in range(8)]
            for n, (x, y, tx, ty, rs) in enumerate(rows):
                here, there, ends, matches = places[at[x]], places[at[y]], {}, []
                for i, j, h, star in sorted((here[r["h"]][0], there[r["h"]][0], r["h"], r["star"]) for r in rs):
                    s, e = ends.get(i - j, (0, 0))
                    if not s <= i < e:
                        s, e = i - common_before(tx, ty, i, j), i + common_after(tx, ty, i, j)
                        ends[i - j] = (s, e)  # the last match of this shift; runs come in order
                        matches.append((i - j, s, e))
                    if star:
                        _borders(out, n, ty, h, j, s - i + j, e - i + j, least)
                for shift, s, e in matches:
                    if e - s >= least:
                        for row in ((n, 0, s, e, False, None, None, None), (n, 1, s - shift, e - shift, True, None, None, None)):
                            for column, v in zip(out, row):
                                column.append(v)
            row, side = np.array(out[0], np.int64), np.array(out[1], np.int64)
            both = pa.concat_arrays([a, b]).take(pa.array(row + side * len(rows)))
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([both, *(pa.array(c, k) for c, k in zip(out[2:], kinds))], ["id", "lo", "hi", "later", "h", "off", "char"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb", "runs")
    met = stage(met.mapInArrow(extended, f"id {kind}, lo int, hi int, later boolean, h long, off int, char int"), "extended")
    borders = met.where("h is not null")
    shared = borders.groupBy("h", "off", "char").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("h", "off", "char")
    near = borders.join(shared, ["h", "off", "char"], "left_semi").groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    work = near.join(loops.groupBy("id").agg(F.collect_set("h").alias("runs")), "id", "full_outer")

    def windows(batches):
        for batch in batches:
            texts, ranges, runs = (batch.column(i).to_pylist() for i in (1, 2, 3))
            places = _placed(texts, [r or [] for r in runs], least)
            number, at, one, two = [], [], [], []
            for n, (t, rs) in enumerate(zip(texts, ranges)):
                spots = [(r["lo"], r["hi"]) for r in rs or []] + [(max(0, s + RUN - least), min(s, len(t) - least)) for ss in places[n].values() for s in ss]
                mark = np.zeros(len(t) + 2, np.int32)
                for lo, hi in spots:
                    if lo <= hi:
                        mark[lo] += 1
                        mark[hi + 1] -= 1
                p = np.flatnonzero(np.cumsum(mark) > 0)
                codes = _codes(t)
                number.append(np.full(len(p), n)), at.append(p)
                for hashes, base in ((one, _BASES[0]), (two, _BASES[1])):
                    hashes.append(Rolling(codes, base).of(p, least).view(np.int64))
            number, at, one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (number, at, one, two))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number)), pa.array(at.astype(np.int32)), pa.array(one), pa.array(two)], ["id", "lo", "h1", "h2"])

    hashed = stage(work.join(texts, "id").select("id", "text", "ranges", "runs").mapInArrow(windows, f"id {kind}, lo int, h1 long, h2 long"), "windows")
    again = hashed.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("h1", "h2", "a")
    hits = hashed.join(again, ["h1", "h2"]).select("id", "lo", (F.col("lo") + least).alias("hi"), (F.col("id") != F.col("a")).alias("later"))
    return met.where("h is null").select("id", "lo", "hi", "later").unionByName(hits)


def _borders(out: list[list], n: int, text: str, h: int, run: int, s: int, e: int, least: int) -> None:
    """Where text leaves the text it was compared with, near the run: the windows that reach beyond, and what others must have there too."""
    low, high = max(0, run + RUN - least), min(run, len(text) - least)
    found = []
    if e < len(text) and max(low, e - least + 1) <= high:
        found.append((max(low, e - least + 1), high, e - run, ord(text[e])))
    if s > 0 and low <= min(high, s - 1):
        found.append((low, min(high, s - 1), s - run - 1, ord(text[s - 1])))
    for lo, hi, off, char in found:
        for column, v in zip(out, (n, 1, lo, hi, None, h, off, char)):
            column.append(v)


def repeated_spans(docs: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """(key, start, end, later): the parts of every text that lie in spans of at least `least` characters (code points,
    unchanged) which occur in the text of another record, once for all such spans (later false) and once for those that a
    record with a smaller key has (later true). The parts of one key and kind do not overlap.

    Null texts count as empty. Spans repeated within one record only are not shared. Equal rows of one key are one record;
    rows with a null key take no part. Other columns are ignored. `least` must be at least 160.
    """
    known, spans = _found(docs, key, text, least)
    return spans.select(F.col("id").alias(key), F.col("lo").alias("start"), F.col("hi").alias("end"), "later")


def _found(docs: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    if least < RUN + 56:
        raise ValueError(f"least must be at least {RUN + 56}")
    kind = dict(docs.dtypes)[key]
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known, copies = _classes(base)
    unique = base.where(F.length("text") >= least).join(small(copies, FEW), "id", "left_anti")
    spans = _spans(unique, kind, least)
    whole = known.where((F.col("n") >= least) & F.col("copied")).select("id", F.lit(0).alias("lo"), F.col("n").cast("int").alias("hi"), (F.col("id") != F.col("first")).alias("later"))
    every = spans.unionByName(whole)
    both = every.withColumn("later", F.lit(False)).unionByName(every.where("later"))
    # parts that overlap become one: a part begins where none of those before it reaches
    order = Window.partitionBy("id", "later").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(order)
    merged = both.withColumn("reach", reach).withColumn("part", part).groupBy("id", "later", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return known, merged.drop("part")


def shared_spans(docs: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """(key, n_chars, shared_chars, first_chars, share): how much of every text lies in spans of at least `least` characters
    (code points, unchanged) that occur in the text of another record.

    first_chars: the part of shared_chars whose spans occur in no record with a smaller key; removing the other
    shared_chars (those covered by a non-first repeated span) leaves every span once. share: shared_chars / n_chars, 0 for
    empty texts. Nulls, repeated rows and other columns as in repeated_spans.
    """
    known, spans = _found(docs, key, text, least)
    size = F.col("hi") - F.col("lo")
    sums = spans.groupBy("id").agg(F.sum(F.when(~F.col("later"), size)).alias("shared"), F.sum(F.when(F.col("later"), size)).alias("later"))
    out = known.select("id", F.col("n").alias("n_chars")).join(sums, "id", "left")
    chars = F.coalesce("shared", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(key),
        "n_chars",
        chars.alias("shared_chars"),
        (chars - F.coalesce("later", F.lit(0))).alias("first_chars"),
        F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("share"),
    )


def without_repeats(docs: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """(key, text, sentences, removed): every text without the sentences that lie wholly in a non-first repeated span.

    Sentences end behind `.`, `!` or `?` and white space, or at line ends, and keep what follows them up to the next one.
    A null text stays null and has no sentences; equal rows of one key come out once.
    """
    kind = dict(docs.dtypes)[key]
    later = repeated_spans(docs, key, text, least).where("later").groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).join(later, "id", "left").dropDuplicates(["id"])

    def run(batches):
        for batch in batches:
            kept, counts, gone = [], [], []
            for t, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                cut = [0, *(m.end() for m in ENDS.finditer(t or "")), len(t or "")]
                sentences = [(a, b) for a, b in zip(cut, cut[1:]) if a < b]
                spans = [(p["start"], p["end"]) for p in parts or []]
                left = [(a, b) for a, b in sentences if not any(s <= a and b <= e for s, e in spans)]
                kept.append(None if t is None else "".join(t[a:b] for a, b in left)), counts.append(len(sentences)), gone.append(len(sentences) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["id", "text", "sentences", "removed"])

    return rows.mapInArrow(run, f"id {kind}, text string, sentences long, removed long").withColumnRenamed("id", key)
