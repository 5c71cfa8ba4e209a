"""Filling fixed-capacity containers with documents of varying length, by non-negative least squares on the histogram.

Lengths fall into UNITS classes of equal width, rounded up. All shallow combinations of classes that fill a container
exactly (at most DEPTH of them) are the columns of a matrix; non-negative least squares finds how often each is repeated
so that the histogram of lengths is used up. The counts are rounded down and carried out; as lengths were rounded up,
containers keep a little room, which the shortest documents (held back from the histogram) and whatever rounding left
over fill greedily: the longest first, each into the container with the least room that takes it.

Documents are spread over shards of about SHARD_ROWS by a hash of their key; every shard is packed by itself in one task,
from keys and lengths only. A shard leaves less than one container's worth of room unused that another could have filled,
so the loss by sharding is below one container in several thousand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tokens import TOKENIZER, counted
from tesserine.runtime import stage

UNITS = 64
DEPTH = 6
HELD_BACK = 2  # classes of the shortest documents, which fill what is left
SHARD_ROWS = 50_000
_combinations: dict = {}


def combinations(units: int, depth: int, least: int) -> np.ndarray:
    """Matrix (units + 1) x combinations: how often each class occurs in each way to fill `units` with at most `depth` classes."""
    key = (units, depth, least)
    if key not in _combinations:
        columns = []

        def grow(left, top, parts):
            if left == 0:
                columns.append(np.bincount(parts, minlength=units + 1))
            elif len(parts) < depth:
                for part in range(min(top, left), least - 1, -1):
                    if part * (depth - len(parts)) < left:
                        break
                    grow(left - part, part, [*parts, part])

        grow(units, units, [])
        _combinations[key] = np.array(columns, np.float64).T
    return _combinations[key]


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (active set method: one more column at a time, columns that turn negative leave)."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    scale = np.abs(b).max() or 1.0
    for _ in range(rounds or 3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-7 * scale:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            bad = best <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - best[bad], 1e-12))
            x[at] += step * (best - x[at])
            used[at[x[at] <= 1e-9 * scale]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container of every item (lengths from 1 to capacity)."""
    width = -(-capacity // UNITS)
    units = capacity // width
    kind = -(-lengths // width)
    place = np.full(len(lengths), -1, np.int64)
    room: list[int] = []
    waiting: list[list[int]] = [[] for _ in range(units + 2)]
    for i in np.argsort(lengths, kind="stable").tolist():
        waiting[min(int(kind[i]), units + 1)].append(i)  # the longest of a class come off first
    ways = combinations(units, DEPTH, HELD_BACK + 1)
    have = np.array([len(w) for w in waiting[: units + 1]], np.float64)
    have[: HELD_BACK + 1] = 0
    counts = np.floor(non_negative_least_squares(ways, have) + 1e-6).astype(np.int64)
    for j in np.flatnonzero(counts):
        parts = np.repeat(np.arange(units + 1), ways[:, j].astype(np.int64))
        need = np.bincount(parts, minlength=units + 1)
        for _ in range(min(counts[j], *(len(waiting[p]) // need[p] for p in set(parts.tolist())))):
            free = capacity
            for p in parts:
                i = waiting[p].pop()
                place[i] = len(room)
                free -= int(lengths[i])
            room.append(free)
    # what is left, the longest first, each where the least room is left that takes it
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for c, free in enumerate(room):
        by_room[free].append(c)
        mask |= 1 << free
    rest = np.flatnonzero(place < 0)
    for i in rest[np.argsort(-lengths[rest], kind="stable")].tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            c = by_room[free].pop()
            if not by_room[free]:
                mask ^= 1 << free
        else:
            c, free = len(room), capacity
            room.append(0)
        place[i] = c
        by_room[free - size].append(c)
        mask |= 1 << (free - size)
    return place


def containers(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(container, slot, key, first_token, last_token, tokens): the members of every container.

    first_token and last_token are the range of the document's tokens (from 0, the end excluded). A document longer than
    the capacity gives full containers of its own and one remainder, which is packed like a document. Documents without
    tokens (null or empty text) fill nothing and come out with a null container. Repeated rows of one key count once, rows
    with a null key not at all. Numbers of containers are unique, not consecutive. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    sizes = counted(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")), "text", tokenizer_path)
    sizes = stage(sizes.dropDuplicates(["id"]), "sizes")
    shards = max(1, -(-sizes.count() // SHARD_ROWS))
    schema = f"container long, slot int, id {kind}, first_token long, last_token long, tokens long"

    def run(group, table):
        shard, ids, n = group[0].as_py(), table.column("id").combine_chunks(), table.column("tokens").to_numpy()
        order = np.lexsort((np.arange(len(n)), -n))
        full = n // capacity
        left = n - full * capacity
        items = order[left[order] > 0]
        place = pack(left[items], capacity)
        whole = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        first = np.r_[nth * capacity, full[items] * capacity]
        row = np.r_[whole, items]
        size = np.r_[np.full(len(whole), capacity), left[items]]
        box = np.r_[np.arange(len(whole)) + (place.max() + 1 if len(place) else 0), place]
        by = np.lexsort((np.arange(len(box)), box))
        starts = np.r_[True, np.diff(box[by]) > 0]
        slot = np.arange(len(by)) - np.maximum.accumulate(np.where(starts, np.arange(len(by)), 0))
        columns = [pa.array(box[by] + (shard << 32)), pa.array(slot.astype(np.int32)), ids.take(pa.array(row[by])), pa.array(first[by]), pa.array((first + size)[by]), pa.array(size[by])]
        return pa.table(columns, names=["container", "slot", "id", "first_token", "last_token", "tokens"])

    some = sizes.where("tokens > 0").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long"))
    packed = some.groupBy("shard").applyInArrow(run, schema)
    none = sizes.where("tokens = 0").select(F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("slot"), "id", *[F.lit(0).cast("long").alias(c) for c in ("first_token", "last_token", "tokens")])
    return packed.unionByName(none).withColumnRenamed("id", key)


def use_of_space(members: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, used): how full the containers are on the whole."""
    each = members.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("used", F.col("tokens") / (F.col("containers") * capacity))
