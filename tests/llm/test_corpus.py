"""Packing into containers and mixing sources."""

import os
import random
from itertools import pairwise

import numpy as np
import pytest

from tesserine.llm import mixing, packing
from tesserine.llm.tokens import TOKENIZER, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int, container string, uses int")


def length(t):
    return len(tokenizer(TOKENIZER).encode(t or "", add_special_tokens=False).ids)


def test_containers_hold_every_token_once(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["water", "grid", "carbon"], k=rng.choice([1, 5, 40, 100, 300]))), "s", 1, "c", 1) for i in range(300)]
    docs += [(900, "water " * 5000, "s", 1, "c", 1), (901, None, None, 1, "c", 1), (902, "", "s", 1, "c", 1), (903, "x<|endoftext|>y", "s", 1, "c", 1)]
    rows = packing.containers(texts(spark, docs + docs[:3] + [(None, "x", "s", 1, "c", 1)]), capacity=1024).collect()
    ranges: dict = {}
    room: dict = {}
    for r in rows:
        assert r.tokens == r.last_token - r.first_token
        ranges.setdefault(r.doc_id, []).append((r.first_token, r.last_token))
        if r.container is not None:
            room.setdefault(r.container, []).append(r)
    assert set(ranges) == {d[0] for d in docs}
    for i, t, *_ in docs:
        own = sorted(ranges[i])
        assert own[0][0] == 0 and own[-1][1] == length(t) and all(a[1] == b[0] for a, b in pairwise(own))
        assert len(own) == max(1, -(-length(t) // 1024))  # only what is over the capacity is split
    assert all(sum(r.tokens for r in c) <= 1024 and sorted(r.slot for r in c) == list(range(len(c))) for c in room.values())
    total = sum(length(t) for _, t, *_ in docs)
    assert len(room) <= -(-total // 1024) + 1
    assert packing.containers(texts(spark, [])).count() == 0


def test_packing_uses_nearly_all_space():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 2049, 5000), np.minimum(2048, 1 + rng.exponential(250, 20000).astype(int)), np.full(100, 1025), np.full(1000, 1)):
        place = packing.pack(lengths, 2048)
        used = np.bincount(place, weights=lengths)
        assert used.max() <= 2048 and (place >= 0).all()
        if len(lengths) >= 5000:
            assert lengths.sum() / (len(used) * 2048) > 0.97
    assert len(packing.pack(np.array([], np.int64), 2048)) == 0 and packing.pack(np.array([7]), 10).tolist() == [0]


def test_least_squares():
    rng = np.random.default_rng(3)
    a = rng.uniform(size=(20, 60))
    x = np.maximum(rng.normal(size=60), 0)
    b = a @ x
    got = packing.non_negative_least_squares(a, b)
    assert (got >= 0).all() and np.allclose(a @ got, b, atol=1e-4)
    assert packing.non_negative_least_squares(a, -b).sum() == 0


def test_flow_is_cheapest():
    patterns = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    targets = {"a": (0.5, 2), "b": (0.5, 3)}
    got, flows = mixing.route(patterns, targets, 160)
    assert got == 160 and flows[("a",)] == {"a": 80} and sum(flows[("a", "b")].values()) + flows[("b",)]["b"] == 80
    assert abs(mixing.largest_total(patterns, targets) - 260) <= 1  # b: 10 * 3 + 50 * 2 (the strictest cap of a shared text)
    assert mixing.largest_total({("a",): 5}, targets) <= 1 and set(mixing.reachable({("a",): 5}, targets)) == {"a"}


def test_flow_against_brute_force(monkeypatch):
    import itertools

    rng = random.Random(5)
    for _ in range(60):
        names = "abc"[: rng.randint(1, 3)]
        sets = [c for k in (1, 2, 3) for c in itertools.combinations(names, k)]
        patterns = {p: rng.randint(1, 4) for p in rng.sample(sets, rng.randint(1, len(sets)))}
        weights = [rng.randint(1, 4) for _ in names]
        targets = {n: (w / sum(weights), rng.randint(1, 3)) for n, w in zip(names, weights)}
        uses = {p: min(targets[s][1] for s in p) for p in patterns}

        def best(total):
            """Least cost of a flow of all quotas, by trying how much every pattern gives to every source."""
            quota = {s: round(total * targets[s][0]) for s in names}
            states = {tuple(quota[s] for s in names): 0}
            for p, n in patterns.items():
                nxt = {}
                for left, cost in states.items():
                    for give in itertools.product(*[range(left[names.index(s)] + 1) for s in p]):
                        used = sum(give)
                        if used <= n * uses[p]:
                            after = list(left)
                            for s, g in zip(p, give):
                                after[names.index(s)] -= g
                            c = cost + sum(i // n for i in range(used))
                            key = tuple(after)
                            nxt[key] = min(c, nxt.get(key, c))
                states = nxt
            return states.get((0,) * len(names))

        for total in (2, 5, 9):
            got, flows = mixing.route(patterns, targets, total)
            want = best(total)
            assert (got == sum(round(total * s) for s, _ in targets.values())) == (want is not None)
            if want is not None:
                assert sum(sum(i // patterns[p] for i in range(sum(f.values()))) for p, f in flows.items()) == want
        quick = mixing.largest_total(patterns, targets)
        with monkeypatch.context() as m:
            m.setattr(mixing, "CLOSED", 0)
            assert abs(quick - mixing.largest_total(patterns, targets)) <= 2 * len(names)


def test_flow_of_many_patterns():
    import time

    rng = random.Random(6)
    names = [f"s{i}" for i in range(40)]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 6)))): rng.randint(1, 10**6) for _ in range(20_000)}
    targets = {n: (1 / 40, rng.randint(1, 4)) for n in names}
    began = time.time()
    got, _ = mixing.route(patterns, targets, sum(patterns.values()))
    assert got > 0 and time.time() - began < 60


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, f"{i} " + " ".join(rng.choices(["water", "grid"], k=rng.randint(5, 60))), s, 1, "c", 1) for i, s in enumerate(["big"] * 2000 + ["mid"] * 300 + ["small"] * 60)]
    docs += [(5000, docs[0][1], "small", 1, "c", 1), (5001, "unwanted", "other", 1, "c", 1), (5002, "x", None, 1, "c", 1), (5003, None, "big", 1, "c", 1), (5004, "", "big", 1, "c", 1)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 3), ("small", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(texts(spark, docs + docs[:2]), targets)
    rows = mixed.collect()
    caps = {"big": 1, "mid": 3, "small": 4}
    assert all(1 <= r.uses <= caps[r.source] for r in rows) and not {r.doc_id for r in rows} & {5000, 5001, 5002, 5003, 5004}
    for s in mixing.shares(mixed, targets).collect():
        assert abs(s.actual_share - s.target_share) < 0.01
    assert sorted(map(tuple, mixing.mixture(texts(spark, docs), targets).collect())) == sorted(map(tuple, rows))  # seeded
    small = mixing.mixture(texts(spark, docs), targets, total=3000).collect()
    assert abs(sum(r.uses * r.tokens for r in small) - 3000) < 200 and all(r.uses == 1 for r in small)
    assert mixing.mixture(texts(spark, []), targets).count() == 0
    assert mixing.shares(mixing.mixture(texts(spark, []), targets), targets).count() == 3
    with pytest.raises(ValueError):
        mixing.mixture(texts(spark, docs), targets.where("source = 'big'"))
