"""Most similar vectors for every vector.

Inverted cells plus four-bit codes trained with the score-aware (anisotropic) loss: the part of the quantisation error
that is parallel to the vector weighs `eta` times as much as the orthogonal part, because only the parallel part moves
the inner product with a close query. Steps:

1. fit: coarse centres and code books, per model, on a bounded sample (`SAMPLE_ROWS` rows per model, by hash order); where
   the table needs more cells than such a sample can tell apart, every coarse cell is divided once more by centres of its
   own, fitted in parallel on about `CELL_ROWS` sampled rows a final cell (a cell holds about 1.4 sqrt(rows) rows);
2. encode: every distinct vector gets a cell and 24 bytes of codes (48 tables of 16 entries over two dimensions each);
3. scan: the codes of a vector travel to the `probes` cells nearest to it; there each vector looks the codes up in its tables.
   The look-up sums of a whole cell are evaluated as one matrix product with the looked-up entries, which gives the
   same sums as reading the tables code by code, but in one BLAS call; guests are taken in blocks of `GUESTS`, with the
   best candidates so far carried along, so what a task holds at once does not grow with the number of guests;
4. rerank: candidates travel to the cell of their target and get exact cosines; the best k per vector stay.

Exact copies of a vector are one class in steps 2-4 and are expanded at the end, so a class of any size costs one row.
Cells are split until none holds more than about twice its share of the sample, so no cell gathers an unbounded group.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.runtime import stage

SAMPLE_ROWS = 32_768  # rows per model that centres are fitted on
CELL_ROWS = 64  # sampled rows a cell of the second level
GUESTS = 65_536  # codes that are looked up at once
CODEBOOK_ROWS = 4_096  # of those, rows that the code books are fitted on
LEVELS = 16  # four bits
WIDTH = 2  # dimensions per table


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = np.argmax(x[i : i + 8192] @ centres.T, axis=1)
    return out


def _nearest_cells(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` cells nearest to every vector, in no order."""
    score = x @ centres.T
    if probes >= len(centres):
        return np.broadcast_to(np.arange(len(centres)), score.shape)
    return np.argpartition(score, -probes, axis=1)[:, -probes:]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(x[order], starts, axis=0)
        centres[own[order][starts]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _centres(x: np.ndarray, k: int, rng) -> np.ndarray:
    centres = _kmeans(x, k, 8, rng)
    for _ in range(3):  # split cells that hold far more than their share
        own = _nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        share = max(8, 2 * len(x) // k)
        big = [c for c in np.flatnonzero(size > share) if len(np.unique(x[own == c], axis=0)) > 1]
        if not big:
            break
        parts = [_kmeans(x[own == c], -(-size[c] * 2 // share), 4, rng) for c in big]
        centres = np.concatenate([np.delete(centres, big, axis=0), *parts])
    return np.unique(centres, axis=0)


def _assign_codes(x, r, books, eta, rounds=2):
    """Codes by coordinate descent on |e|^2 + (eta - 1) (x.e)^2, e the error of the residual r of x."""
    n, m = len(x), books.shape[0]
    xs, rs = x.reshape(n, m, WIDTH), r.reshape(n, m, WIDTH)
    codes = np.zeros((n, m), np.uint8)
    par = np.zeros((n, m), np.float32)
    for j in range(m):
        e = rs[:, j, None, :] - books[j][None]
        codes[:, j] = np.argmin((e * e).sum(2), axis=1)
        par[:, j] = (xs[:, j] * (rs[:, j] - books[j][codes[:, j]])).sum(1)
    total = par.sum(1)
    for _ in range(rounds):
        for j in range(m):
            e0, e1 = (rs[:, j, d, None] - books[j][None, :, d] for d in range(WIDTH))
            p = xs[:, j, 0, None] * e0 + xs[:, j, 1, None] * e1
            rest = (total - par[:, j])[:, None]
            best = np.argmin(e0 * e0 + e1 * e1 + (eta - 1) * (rest + p) ** 2, axis=1)
            codes[:, j] = best
            par[:, j] = p[np.arange(n), best]
            total = rest[:, 0] + par[:, j]
    return codes


def _fit_books(x, r, eta, rng, rounds=3):
    n, d = x.shape
    m = d // WIDTH
    books = np.stack([r.reshape(n, m, WIDTH)[rng.choice(n, LEVELS, replace=n < LEVELS), j] for j in range(m)])
    for step in range(rounds):
        codes = _assign_codes(x, r, books, eta, rounds=1 if step else 0)
        spot = (np.arange(m)[None, :] * LEVELS + codes)[:, :, None] * WIDTH + np.arange(WIDTH)[None, None, :]
        w = np.zeros((n, m * LEVELS * WIDTH), np.float32)
        np.put_along_axis(w, spot.reshape(n, -1), x, axis=1)
        hits = np.zeros_like(w)
        np.put_along_axis(hits, spot.reshape(n, -1), np.ones_like(x), axis=1)
        want = np.zeros_like(w)
        np.put_along_axis(want, spot.reshape(n, -1), r, axis=1)
        left = (eta - 1) * (w.T @ w).astype(np.float64)
        left[np.diag_indices_from(left)] += hits.sum(0) + 1e-3
        right = want.sum(0) + (eta - 1) * (w.T @ (x * r).sum(1)) + 1e-3 * books.reshape(-1)
        books = np.linalg.solve(left, right.astype(np.float64)).astype(np.float32).reshape(m, LEVELS, WIDTH)
    return books


def _cells(rows: int) -> int:
    return max(1, round(0.7 * math.sqrt(rows)))


def _fit(x: np.ndarray, rows: int, threshold: float, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    x = _unit(x)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]  # of copies the first
    d = x.shape[1]
    centres = _centres(x, min(_cells(rows), max(1, len(x) // 8)), rng)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    some = x[rng.choice(len(x), min(CODEBOOK_ROWS, len(x)), replace=False)]
    fitted = {"centres": centres, "books": _books(some, centres, eta, rng), "eta": eta, "rows": rows}
    return fitted | ({"some": some} if _too_few(fitted) else {})


def _too_few(fitted: dict) -> bool:
    """The table asks for more cells than the sample could tell apart."""
    return _cells(fitted["rows"]) > 1.5 * len(fitted["centres"])


def _books(x: np.ndarray, centres: np.ndarray, eta: float, rng) -> np.ndarray:
    return _fit_books(x, x - centres[_nearest(x, centres)], eta, rng)


def _pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def _decode(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    codes = np.empty((len(packed), books.shape[0]), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
    return books[np.arange(books.shape[0])[None, :], codes].reshape(len(packed), -1)


def _best(score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the `keep` best of every row (all that are above -inf among them)."""
    n, width = score.shape
    block = 16
    if width > block * keep * 2:  # the best lie in the `keep` blocks with the best maxima
        cut = width // block * block
        tops = score[:, :cut].reshape(n, -1, block).max(2)
        pick = np.argpartition(tops, -keep, axis=1)[:, -keep:]
        cols = (pick[:, :, None] * block + np.arange(block)).reshape(n, -1)
        if cut < width:
            cols = np.concatenate([cols, np.broadcast_to(np.arange(cut, width), (n, width - cut))], axis=1)
    else:
        cols = np.broadcast_to(np.arange(width), (n, width))
    part = np.take_along_axis(score, cols, axis=1)
    if part.shape[1] > keep:
        top = np.argpartition(part, -keep, axis=1)[:, -keep:]
        return np.take_along_axis(cols, top, axis=1), np.take_along_axis(part, top, axis=1)
    return cols, part


def _blob(column, width: int, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(model, vec_id, embedding, h): rows with `dim` finite elements that are not all zero; h names the class of equal vectors."""
    e = F.col("embedding")
    good = (F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return (
        vectors.select("model", "vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & e.isNotNull() & good)
        .withColumn("model", F.coalesce("model", F.lit("")))
        .withColumn("h", F.xxhash64("embedding"))
    )


def fit_models(rows: DataFrame, threshold: float, seed: int) -> dict[str, dict]:
    """Centres and code books of each model, fitted in one task a model on at most SAMPLE_ROWS rows of it, and divided in
    one task a coarse cell where that makes too few cells."""
    counts = rows.groupBy("model").agg(F.count("*").alias("n"))
    place = F.xxhash64(F.lit(seed), "vec_id")
    # a hash threshold first, so that little more than the sample is moved whatever the number of rows
    spot = place.cast("double") / 2.0**64 + 0.5
    order = Window.partitionBy("model").orderBy(place, "vec_id")
    near = rows.join(F.broadcast(counts), "model").where(spot * F.col("n") <= 1.04 * SAMPLE_ROWS + 400)  # one row a model
    sample = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE_ROWS)

    def fit(key, table):
        x = np.stack([np.asarray(v, np.float32) for v in table.column("embedding").to_numpy(zero_copy_only=False)])
        fitted = _fit(x, table.column("n")[0].as_py(), threshold, seed)
        return pa.table({"model": [key[0].as_py()], "fitted": [pickle.dumps(fitted)]})

    fitted = {r.model: pickle.loads(r.fitted) for r in sample.select("model", "embedding", "n").groupBy("model").applyInArrow(fit, "model string, fitted binary").collect()}
    coarse = {m: f["centres"] for m, f in fitted.items() if _too_few(f)}
    if coarse:
        for m, centres in _divided(rows.where(F.col("model").isin(*coarse)), coarse, {m: fitted[m]["rows"] for m in coarse}, spot, seed).items():
            f = fitted[m]
            f |= {"centres": centres, "books": _books(f["some"], centres, f["eta"], np.random.default_rng(seed))}
    return {m: {k: f[k] for k in ("centres", "books", "eta")} for m, f in fitted.items()}


def _divided(rows: DataFrame, coarse: dict[str, np.ndarray], counts: dict[str, int], spot, seed: int) -> dict[str, np.ndarray]:
    """Centres of the second level: every coarse cell gets as many as its share of the rows asks for."""
    share = F.create_map(*[x for m, n in counts.items() for x in (F.lit(m), F.lit(min(1.0, CELL_ROWS * _cells(n) / n)))])
    known = rows.sparkSession.sparkContext.broadcast(coarse)

    def placed(batches):
        for batch in batches:
            models = np.array(batch.column(0).to_pylist(), object)
            x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 1))
            cell = np.zeros(batch.num_rows, np.int32)
            for m in set(models.tolist()):
                cell[models == m] = _nearest(x[models == m], known.value[m])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array([v.tobytes() for v in x], pa.binary())], ["model", "cell", "unit"])

    def divide(key, table):
        x = np.unique(_blob(table.column("unit"), known.value[key[0].as_py()].shape[1] * 4, np.uint8).view(np.float32), axis=0)
        centres = _centres(x, max(1, min(len(x), round(table.num_rows / CELL_ROWS))), np.random.default_rng(seed))
        return pa.table({"model": [key[0].as_py()] * len(centres), "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary())})

    some = rows.where(spot <= share[F.col("model")]).select("model", "embedding").mapInArrow(placed, "model string, cell int, unit binary")
    found: dict[str, list] = {}
    for r in some.groupBy("model", "cell").applyInArrow(divide, "model string, centre binary").collect():  # about 0.7 sqrt(rows) centres a model
        found.setdefault(r.model, []).append(np.frombuffer(r.centre, np.float32))
    return {m: np.unique(np.stack(c), axis=0) for m, c in found.items()}


def most_similar(
    vectors: DataFrame,
    k: int = 10,
    dim: int = 96,
    probes: int = 64,
    min_score: float | None = None,
    margin: float = 0.1,
    candidates: int = 80,
    threshold: float = 0.2,
    seed: int = 7,
) -> DataFrame:
    """(model, vec_id, neighbour, score, hit_rank): the k most similar (cosine) other vectors of the same model.

    min_score: neighbours below it are not wanted; it is pushed into the scan (codes scoring below min_score - margin
    never become candidates). Ties: the smaller vec_id first. Rows whose vector is null, of another length, not finite
    or all zero take no part. Repeated rows count once. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    out = "model string, vec_id long, neighbour long, score double, hit_rank int"
    rows = usable(vectors, dim)
    fitted = fit_models(rows, threshold, seed)
    if not fitted:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(fitted)

    def encoded(batches):
        """Distinct vectors of this partition as (model, h, unit, cell, packed codes)."""
        seen: set = set()
        for batch in batches:
            models = batch.column("model").to_pylist()
            hs = batch.column("h").to_numpy(zero_copy_only=False)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            by_model: dict[str, list[int]] = {}
            for i, (m, h) in enumerate(zip(models, hs.tolist())):
                if (m, h) not in seen:
                    seen.add((m, h))
                    by_model.setdefault(m, []).append(i)
            for m, at in by_model.items():
                f = shared.value[m]
                x = _unit(flat[at])
                cell = _nearest(x, f["centres"])
                yield m, hs[at], x, cell, lambda x=x, cell=cell, f=f: _pack(_assign_codes(x, x - f["centres"][cell], f["books"], f["eta"]))

    def own(batches):
        for m, h, x, cell, _ in encoded(batches):
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(h)), pa.array(cell), pa.array(h), pa.array([v.tobytes() for v in x], pa.binary())], ["model", "cell", "h", "unit"])

    def guests(batches):
        for m, h, x, cell, codes in encoded(batches):
            packed, centres = codes(), shared.value[m]["centres"]
            near = [_nearest_cells(x[i : i + 4096], centres, probes) for i in range(0, len(x), 4096)]
            to = np.concatenate(near)
            row = np.repeat(np.arange(len(x)), to.shape[1])
            order = np.argsort(to.ravel(), kind="stable")
            to, row = to.ravel()[order], row[order]
            targets, first = np.unique(to, return_index=True)
            parts = [(h[r].tobytes(), packed[r].tobytes(), cell[r].tobytes()) for r in np.split(row, first[1:])]
            blobs = [pa.array(list(p), pa.binary()) for p in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(targets)), pa.array(targets.astype(np.int32)), *blobs], ["model", "cell", "ids", "codes", "sources"])

    slim = rows.select("model", "h", "embedding")
    homes = slim.mapInArrow(own, "model string, cell int, h long, unit binary")
    visits = slim.mapInArrow(guests, "model string, cell int, ids binary, codes binary, sources binary")
    floor = -np.inf if min_score is None else min_score - margin

    def scan(left, right):
        empty = {"model": pa.array([], pa.string()), "cell": pa.array([], pa.int32()), "q": pa.array([], pa.int64()), "unit": pa.array([], pa.binary()), "x": pa.array([], pa.list_(pa.int64()))}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        m = left.column("model")[0].as_py()
        f = shared.value[m]
        hq, first = np.unique(left.column("h").to_numpy(), return_index=True)
        units = _blob(left.column("unit"), dim * 4, np.uint8).view(np.float32)[first]
        sources = np.frombuffer(b"".join(right.column("sources").to_pylist()), np.int32)
        ids = np.frombuffer(b"".join(right.column("ids").to_pylist()), np.int64)
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        ids, at = np.unique(ids, return_index=True)
        sources, codes = sources[at], codes[at]
        spot = np.searchsorted(ids, hq)
        own = np.where((spot < len(ids)) & (ids[np.minimum(spot, len(ids) - 1)] == hq), spot, -1)
        best, top = np.zeros((len(hq), 0), np.int64), np.zeros((len(hq), 0), np.float32)
        for g in range(0, len(ids), GUESTS):
            looked_up = _decode(codes[g : g + GUESTS], f["books"]) + f["centres"][sources[g : g + GUESTS]]
            width = min(candidates, len(looked_up))
            here, there = np.zeros((len(hq), width), np.int64), np.full((len(hq), width), -np.inf, np.float32)
            for i in range(0, len(hq), 512):
                score = units[i : i + 512] @ looked_up.T
                mine = own[i : i + 512] - g
                inside = np.flatnonzero((mine >= 0) & (mine < len(looked_up)))
                score[inside, mine[inside]] = -np.inf
                some = np.flatnonzero((score >= floor).any(1)) if min_score is not None else np.arange(len(score))
                if len(some):
                    cols, part = _best(score[some], candidates)
                    here[i + some, : cols.shape[1]], there[i + some, : cols.shape[1]] = cols + g, part
            best, top = np.concatenate([best, here], axis=1), np.concatenate([top, there], axis=1)
            if best.shape[1] > candidates:
                pick = np.argpartition(top, -candidates, axis=1)[:, -candidates:]
                best, top = np.take_along_axis(best, pick, axis=1), np.take_along_axis(top, pick, axis=1)
        cells, qs, us, xs = [], [], [], []
        for r in np.flatnonzero((top > -np.inf).any(1)) if top.shape[1] else ():
            c = best[r][(top[r] >= floor) & (top[r] > -np.inf)]
            c = c[np.argsort(sources[c], kind="stable")]
            for piece in np.split(c, np.flatnonzero(np.diff(sources[c])) + 1):
                if len(piece):
                    cells.append(int(sources[piece[0]])), qs.append(int(hq[r])), us.append(units[r].tobytes()), xs.append(ids[piece])
        return pa.table({"model": pa.array([m] * len(cells), pa.string()), "cell": pa.array(cells, pa.int32()), "q": pa.array(qs, pa.int64()), "unit": pa.array(us, pa.binary()), "x": pa.array(xs, pa.list_(pa.int64()))})

    def exact(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"model": pa.array([], pa.string()), "q": pa.array([], pa.int64()), "x": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        hx, first = np.unique(right.column("h").to_numpy(), return_index=True)
        units = _blob(right.column("unit"), dim * 4, np.uint8).view(np.float32)[first]
        mine = _blob(left.column("unit"), dim * 4, np.uint8).view(np.float32)
        lists = left.column("x").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        sizes = np.diff(lists.offsets.to_numpy())
        x = lists.flatten().to_numpy()
        row, at = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(hx, x)
        score = np.concatenate([np.einsum("ij,ij->i", mine[row[i : i + 65536]].astype(np.float64), units[at[i : i + 65536]].astype(np.float64)) for i in range(0, len(x), 65536)])
        q = left.column("q").to_numpy()[row]
        keep = np.ones(len(x), bool) if min_score is None else score >= min_score
        return pa.table({"model": pa.array([left.column("model")[0].as_py()] * int(keep.sum()), pa.string()), "q": q[keep], "x": x[keep], "score": np.minimum(score[keep], 1.0)})

    wanted = homes.groupBy("model", "cell").cogroup(visits.groupBy("model", "cell")).applyInArrow(scan, "model string, cell int, q long, unit binary, x array<long>")
    pairs = wanted.groupBy("model", "cell").cogroup(homes.groupBy("model", "cell")).applyInArrow(exact, "model string, q long, x long, score double")
    best = Window.partitionBy("model", "q").orderBy(F.desc("score"), "x")
    # one class more than k: a class of copies may hide none, and ties are settled by vec_id below
    pairs = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    return _expanded(stage(rows.select("model", "h", "vec_id").distinct(), "vector-classes"), pairs, k)


def _expanded(members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """From classes of equal vectors to vectors; of a class of copies only the k + 1 smallest ids can be neighbours of anything."""
    first = Window.partitionBy("model", "h").orderBy("vec_id")
    heads = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    heads = heads.select("model", F.col("h").alias("x"), F.col("vec_id").alias("neighbour"), "r")
    copies = heads.where("r = 2").select("model", "x")
    across = pairs.join(heads.drop("r"), ["model", "x"]).withColumnRenamed("q", "h").join(members, ["model", "h"]).select("model", "vec_id", "neighbour", "score")
    inside = (
        heads.drop("r").join(copies, ["model", "x"], "left_semi").withColumnRenamed("x", "h")
        .join(members, ["model", "h"]).where("vec_id <> neighbour").select("model", "vec_id", "neighbour", F.lit(1.0).alias("score"))
    )
    rank = Window.partitionBy("model", "vec_id").orderBy(F.desc("score"), "neighbour")
    return across.unionByName(inside).withColumn("hit_rank", F.row_number().over(rank)).where(F.col("hit_rank") <= k)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(vec_lo, vec_hi): each pair of which one is a neighbour of the other, once."""
    return neighbours.select(F.least("vec_id", "neighbour").alias("vec_lo"), F.greatest("vec_id", "neighbour").alias("vec_hi")).distinct()
