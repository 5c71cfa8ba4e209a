import numpy as np
import pytest

from tesserine.llm import neighbours as n

SCHEMA = "vec_id long, chunk_id string, model string, embedding array<float>, h string, unit int"


def clustered(rng, clusters, each, dim, spread=0.35):
    centres = rng.normal(size=(clusters, dim))
    return np.concatenate([c + spread * rng.normal(size=(each, dim)) for c in centres]).astype(np.float32)


def frame(spark, x, model="m", start=0):
    return [(start + i, f"c{i}", model, None if v is None else [float(y) for y in v], "h", 1) for i, v in enumerate(x)]


def brute(x, ids, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[i, j]) for j in order]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = clustered(rng, 40, 60, 32) * rng.uniform(0.1, 9, size=(2400, 1)).astype(np.float32)
    got = n.most_similar(spark.createDataFrame(frame(spark, x), SCHEMA), k=10, dim=32, probes=12).toPandas()
    want = brute(x, list(range(len(x))), 10)
    pairs = set(zip(got.vec_id, got.neighbour))
    hits = sum((q, y) in pairs for q, ys in want.items() for y, _ in ys)
    assert hits / (10 * len(x)) >= 0.9
    assert got.groupby("vec_id").size().eq(10).all()
    sample = got.sample(200, random_state=1)
    a, b = x[sample.vec_id].astype(np.float64), x[sample.neighbour].astype(np.float64)
    assert np.allclose(sample.score, (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1), atol=1e-6)


def test_second_level_and_blocks(spark, monkeypatch):
    """More cells than the sample can tell apart, and guests in several blocks."""
    monkeypatch.setattr(n, "SAMPLE_ROWS", 120)
    monkeypatch.setattr(n, "CELL_ROWS", 16)
    monkeypatch.setattr(n, "GUESTS", 100)
    rng = np.random.default_rng(7)
    x = clustered(rng, 40, 60, 32)
    df = spark.createDataFrame(frame(spark, x), SCHEMA)
    assert len(n.fit_models(n.usable(df, 32), 0.2, 7)["m"]["centres"]) > 25
    got = n.most_similar(df, k=10, dim=32, probes=10).toPandas()
    pairs = set(zip(got.vec_id, got.neighbour))
    want = brute(x, list(range(len(x))), 10)
    assert sum((q, y) in pairs for q, ys in want.items() for y, _ in ys) / (10 * len(x)) >= 0.9


def test_least_score_keeps_all_above_it(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    x = np.concatenate([base, base[:60] + 0.15 * rng.normal(size=(60, 32)), base[:60] + 0.25 * rng.normal(size=(60, 32))]).astype(np.float32)
    got = n.most_similar(spark.createDataFrame(frame(spark, x), SCHEMA), k=10, dim=32, probes=8, min_score=0.85)
    want = {(min(q, y), max(q, y)) for q, ys in brute(x, list(range(len(x))), 10).items() for y, s in ys if s >= 0.85}
    assert {tuple(r) for r in n.similar_pairs(got).collect()} == want


def test_copies_models_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 5, 12, 16)
    rows = frame(spark, [*([x[0]] * 40), *x]) + frame(spark, x[:3], "other", 1000)  # forty copies of one vector; another model
    rows += frame(spark, [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 4], start=2000) + rows[:5]
    got = n.most_similar(spark.createDataFrame(rows, SCHEMA), k=10, dim=16, probes=50).toPandas()
    assert not got.duplicated(["vec_id", "neighbour"]).any() and (got.vec_id != got.neighbour).all() and got.vec_id.max() < 2000
    ids = list(range(100))
    want = brute(np.array([r[3] for r in rows[:100]], np.float32), ids, 10)
    for q in (0, 5, 39, 40, 41, 60):
        mine = got[got.vec_id == q].sort_values("hit_rank")
        assert np.allclose(mine.score, [s for _, s in want[q]], atol=1e-5)
        if q <= 40:
            assert list(mine.neighbour) == [i for i in range(41) if i != q][:10]  # ties: the smaller ids
    assert set(got[got.vec_id >= 1000].neighbour) == {1000, 1001, 1002}


def test_empty_table(spark):
    assert n.most_similar(spark.createDataFrame([], SCHEMA), dim=16).count() == 0


def test_anisotropic_codes_keep_inner_products():
    rng = np.random.default_rng(4)
    x = n._unit(clustered(rng, 10, 200, 32))
    fitted = n._fit(x, len(x), 0.2, 1)
    cell = n._nearest(x, fitted["centres"])
    r = x - fitted["centres"][cell]
    errors = []
    for eta in (fitted["eta"], 1.0):
        codes = n._assign_codes(x, r, fitted["books"], eta)
        assert (n._pack(codes).shape[1], codes.max() < 16) == (8, True)
        near = n._decode(n._pack(codes), fitted["books"]) + fitted["centres"][cell]
        errors.append(np.abs(((x - near) * x).sum(1)).mean())
    assert fitted["eta"] > 1 and errors[0] < errors[1]


def test_best_of_blocks():
    s = np.random.default_rng(5).normal(size=(7, 5003)).astype(np.float32)
    cols, part = n._best(s, 20)
    assert np.allclose(np.sort(part, 1), np.sort(s, 1)[:, -20:]) and np.allclose(np.take_along_axis(s, cols, 1), part)


@pytest.mark.parametrize("rows", [1, 2, 5])
def test_tiny_tables(spark, rows):
    x = np.random.default_rng(6).normal(size=(rows, 16)).astype(np.float32)
    assert n.most_similar(spark.createDataFrame(frame(spark, x), SCHEMA), dim=16).count() == rows * (rows - 1)
