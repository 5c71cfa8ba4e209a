"""Mixing sources to target weights with capped repetition, by a min-cost flow.

Equal texts are one document that belongs to every source it occurs in. Documents are aggregated by membership pattern
(the set of their sources): a few rows whatever the size of the corpus. Their token capacity flows to the quotas of the
sources; a pattern's second, third ... use costs more than its first (convex costs), so nothing is repeated that need
not be. The size of the mixture is the largest for which all quotas can be met, unless it is given. Then documents are
selected in a seeded order: prefix sums of tokens over that order, computed in buckets, cut at the flows of the pattern.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.tokens import TOKENIZER, counted
from tesserine.runtime import stage

BUCKET_ROWS = 20_000  # documents in a bucket of the prefix sums
MAX_PATTERNS = 20_000  # patterns and flows are held on the driver; refused beyond, never cut


class Flow:
    """Largest flow by blocking flows on shortest paths; capacities are integers and can be raised between runs."""

    def __init__(self, n: int):
        self.to, self.cap, self.out = [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int = 0) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y), self.cap.append(c)
        return len(self.to) - 2

    def _depths(self, s: int, t: int) -> list[int] | None:
        depth = [-1] * len(self.out)
        depth[s], line = 0, [s]
        for a in line:
            for e in self.out[a]:
                b = self.to[e]
                if self.cap[e] > 0 and depth[b] < 0:
                    depth[b] = depth[a] + 1
                    line.append(b)
        return depth if depth[t] >= 0 else None

    def run(self, s: int, t: int) -> int:
        """Adds what still can flow from s to t."""
        total = 0
        while (depth := self._depths(s, t)) is not None:
            at, path = [0] * len(self.out), []
            node = s
            while True:
                if node == t:
                    push = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    total += push
                    full = next(i for i, e in enumerate(path) if not self.cap[e])
                    node = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                edges = self.out[node]
                while at[node] < len(edges) and not (self.cap[edges[at[node]]] > 0 and depth[self.to[edges[at[node]]]] == depth[node] + 1):
                    at[node] += 1
                if at[node] < len(edges):
                    path.append(edges[at[node]])
                    node = self.to[path[-1]]
                elif path:
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break
        return total


def route(patterns: dict[tuple, int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple, dict[str, int]]]:
    """(tokens routed, flows): for every pattern how many tokens it gives to each of its sources, for a mixture of `total` tokens.

    A pattern is used in all at most as often as the strictest of its sources allows. Costs are convex: the n-th use of a
    pattern costs n - 1 a token. A path's cost is that of the use it starts with, so the cheapest flow is found by letting
    all first uses flow as far as they can, then all second uses, and so on, whatever flowed before staying in the network.
    """
    names, keys = list(targets), list(patterns)
    place = {s: 2 + len(keys) + j for j, s in enumerate(names)}
    f = Flow(2 + len(keys) + len(names))
    into = [f.edge(0, 2 + i) for i in range(len(keys))]
    flows = {(p, s): f.edge(2 + i, place[s], 1 << 62) for i, p in enumerate(keys) for s in p}
    for s in names:
        f.edge(place[s], 1, round(total * targets[s][0]))
    most = [min(targets[s][1] for s in p) for p in keys]
    got = 0
    for use in range(max(most, default=0)):
        for i, p in enumerate(keys):
            f.cap[into[i]] += patterns[p] if use < most[i] else 0
        got += f.run(0, 1)
    out: dict[tuple, dict[str, int]] = {}
    for (p, s), e in flows.items():
        if f.cap[e ^ 1]:
            out.setdefault(p, {})[s] = f.cap[e ^ 1]
    return got, out


def reachable(patterns: dict[tuple, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """The targets of the sources that have any text, their shares scaled up to 1."""
    have = {s for p in patterns for s in p}
    rest = sum(share for s, (share, _) in targets.items() if s in have)
    return {s: (share / rest, cap) for s, (share, cap) in targets.items() if s in have}


CLOSED = 18  # sources up to which the size of the mixture is computed from all sets of sources


def largest_total(patterns: dict[tuple, int], targets: dict[str, tuple[float, int]]) -> int:
    """The most tokens a mixture can have with every source at its target share; 0 where a wanted source has no text.

    All quotas can be met if and only if no set of sources asks for more than the patterns that touch it can give, so the
    size is the least of what they give over what they ask for. With many sources it is searched for by flows instead.
    """
    enough = lambda n: route(patterns, targets, n)[0] >= sum(round(n * share) for share, _ in targets.values())
    names = list(targets)
    given = {p: n * min(targets[s][1] for s in p) for p, n in patterns.items()}
    low, high = 0, sum(given.values()) + 1
    if len(names) <= CLOSED and names:
        inside, asked = np.zeros(1 << len(names)), np.zeros(1 << len(names))
        for p, n in given.items():
            inside[sum(1 << names.index(s) for s in p)] += n
        for j, s in enumerate(names):
            view = inside.reshape(-1, 2, 1 << j)
            view[:, 1] += view[:, 0]  # inside[set]: what the patterns give all of whose sources are in the set
            asked.reshape(-1, 2, 1 << j)[:, 1] += targets[s][0]
        touching = inside[-1] - inside[::-1]  # patterns that touch a set are those not inside the rest
        near = int(np.min(touching[1:] / asked[1:]))
        low, high = max(0, near - 2 * len(names)), min(high, near + 2 * len(names))  # quotas are rounded
        if low and not enough(low):
            low = 0
    while high - low > max(1, low // 1_000_000):
        middle = (low + high) // 2
        low, high = (middle, high) if enough(middle) else (low, middle)
    return low


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total: int | None = None,
    seed: int = 17,
    tokenizer_path: str = TOKENIZER,
) -> DataFrame:
    """(key, source, uses, tokens): the selected documents, the source they are counted for, how often they are used for it
    and the tokens of one use.

    targets: (source, target_share, max_repeats); shares must add up to 1. A source without any text cannot have its share;
    the other shares are scaled up and shares() reports 0 for it. Documents with no source of targets, or without
    tokens, are not used. Of equal texts the smallest key stands for all, within the strictest of their sources' caps.
    Sources meet their quotas to within the tokens of one document a pattern. Null keys take no part, an empty table gives
    an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    wanted = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()}
    if not wanted or abs(sum(s for s, _ in wanted.values()) - 1) > 1e-6:
        raise ValueError("target shares must add up to 1")
    wanted = {s: w for s, w in wanted.items() if w[0] > 0 and w[1] > 0}
    rows = docs.where(F.col(key).isNotNull() & F.col(source).isin(*wanted)).select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), F.md5(F.col(text)).alias("same"))
    sized = counted(rows, "text", tokenizer_path).where("tokens > 0")
    one = sized.groupBy("same").agg(F.min("id").alias("id"), F.min("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))
    one = stage(one.select("id", "tokens", "pattern", F.xxhash64(F.lit(seed), "same").alias("at")), "distinct-texts")
    summed = one.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(summed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    empty = spark.createDataFrame([], f"`{key}` {kind}, source string, uses int, tokens long")
    patterns = {tuple(r.pattern): r.tokens for r in summed}
    if not patterns:
        return empty
    wanted = reachable(patterns, wanted)
    size = largest_total(patterns, wanted) if total is None else total
    flows = route(patterns, wanted, size)[1]
    # every pattern's uses lie on a line, its first uses before its second; its sources take consecutive stretches
    stretches = []
    for p, given in flows.items():
        start = 0
        for s, n in sorted(given.items()):
            stretches.append((list(p), s, start, start + n, patterns[p], max(0, -(-(start + n) // patterns[p]))))
            start += n
    if not stretches:
        return empty
    plan = spark.createDataFrame(stretches, "pattern array<string>, source string, first long, last long, all long, rounds int")
    buckets = max(1, sum(r.n for r in summed) // BUCKET_ROWS)
    spread = one.withColumn("bucket", F.floor((F.col("at").cast("double") / 2.0**64 + 0.5) * buckets).cast("long"))
    before = spread.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("sum"))
    line = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("pattern", "bucket", F.coalesce(F.sum("sum").over(line), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["pattern", "bucket"])
    placed = placed.withColumn("middle", F.col("offset") + F.col("within") + F.col("tokens") / 2)
    used = placed.join(F.broadcast(plan), "pattern")  # at most MAX_PATTERNS patterns
    # uses whose middle lies on the stretch: rounds k with first <= k * all + middle < last
    upto = lambda end: F.greatest(F.lit(0), F.ceil((F.col(end) - F.col("middle")) / F.col("all")))
    used = used.withColumn("uses", (upto("last") - upto("first")).cast("int")).where("uses > 0")
    return used.select(F.col("id").alias(key), "source", "uses", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, documents, tokens, most_uses): what each source contributes to the mixture."""
    each = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    out = targets.select("source", "target_share").distinct().join(each, "source", "left").fillna(0, ["documents", "tokens", "most_uses"])
    everything = out.agg(F.sum("tokens").alias("everything"))
    share = F.when(F.col("everything") > 0, F.col("tokens") / F.col("everything")).otherwise(0.0)
    return out.join(F.broadcast(everything)).select("source", "target_share", share.alias("actual_share"), "documents", "tokens", "most_uses")
