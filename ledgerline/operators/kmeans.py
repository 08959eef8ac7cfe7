"""Many K-Means models at once, with the same answer for every layout of the rows.

Points are numbers in fixed point (integers of at most ``EXACT_BITS`` bits once squared and summed over the features), so distances are
exact in double precision and all sums are integers: the order of rows, the number of partitions and retried tasks can't
change a bit. A model is a pair (k, start); all of them share every pass over the data:

* ``seeded_centres``: k-means++ as a race. Every point draws ``-ln(u) / weight`` with u from a hash of its key, the start and the
  step, and the least draw wins, which is a weighted draw that any partitioning answers alike. A start's first k centres
  are the same for every k, so the largest k's passes serve all models.
* ``lloyd``: one aggregate per iteration gives counts and sums per (model, cluster) for all models that still move.
* ``silhouettes``: squared-Euclidean silhouette of several models from their cluster sums, one pass.

Points travel in blocks (one binary row per Arrow batch), written once as a table in the shared folder and kept in memory while passes run; a pass
sends one row per model and cluster and partition. Those of few partitions go to the driver as they are (at most ``DRIVER_MERGE`` times the number of
centres), those of many are merged by Spark first; sums are integers, so both ways agree. The driver holds centres, never points.

Rows with a null feature or a null key are an error. Repeated rows count each. Fewer distinct points than k leave
clusters empty; an empty table has no centres and is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import scratch_path

EXACT_BITS = 50  # a squared distance fits a double's 53 bits with room for the expanded form
MAX_SHIFT = 20  # binary places of a feature at most
SILHOUETTE_SHIFT = 30
ROWS_PER_PARTITION = 250_000
DRIVER_MERGE = 32  # partitions whose rows the driver merges itself
MAX_ITER = 300
TOL = 1e-4


@dataclass(frozen=True)
class Points:
    """Blocks of points: ``keys`` (8 bytes each) and ``values`` (8 bytes per feature), ``dims`` features with ``shift`` binary places."""
    blocks: DataFrame
    dims: int
    shift: int
    rows: int
    parts: int = 1 << 30

    @property
    def one(self) -> int:
        return 1 << self.shift


@dataclass(eq=False)
class Model:
    """Centres in fixed point; after a fit also the rows per cluster, the inertia and the passes it took."""
    k: int
    start: int
    centres: np.ndarray
    sizes: np.ndarray | None = None
    inertia: float = math.nan
    passes: int = 0


def fixed(feature: Column, shift: int) -> Column:
    """A number with ``shift`` binary places as an integer."""
    return F.round(feature * float(1 << shift)).cast("long")


def shift_for(largest: float, dims: int) -> int:
    """Binary places for features up to ``largest`` so that squared distances are exact."""
    room = EXACT_BITS - 2 - math.ceil(math.log2(max(dims, 1)))  # distances between points at both ends: twice the value, squared
    return min(MAX_SHIFT, room // 2 - max(0, math.ceil(math.log2(largest)) if largest > 0 else 0))


def fixed_points(df: DataFrame, key: str, features: Sequence[Column]) -> Points:
    """Pack ``df`` into blocks. ``key`` names the rows for the seeding draws; values may repeat."""
    named = [f.cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    plain = df.select(F.xxhash64(key).alias("key"), F.col(key).isNull().alias("missing"), *named)
    largest = F.greatest(F.lit(0.0), *[F.max(F.abs(f"f{i}")) for i in range(len(named))])
    bad = F.col("missing")
    for i in range(len(named)):
        bad = bad | F.col(f"f{i}").isNull() | F.isnan(f"f{i}") | (F.abs(f"f{i}") == float("inf"))
    rows, top, unusable = plain.agg(F.count("*"), largest, F.count_if(bad)).first()
    if unusable:
        raise ValueError(f"{unusable} rows have a null key or a feature that is no finite number")
    if not rows:
        raise ValueError("K-Means needs at least one row")
    dims, shift = len(named), shift_for(top, len(named))
    if shift < 0:
        raise ValueError(f"features up to {top} are too large: standardise them first")
    whole = plain.select("key", *[fixed(F.col(f"f{i}"), shift).alias(f"f{i}") for i in range(dims)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(dims)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())],
                                                 names=["keys", "values"])

    parts = max(1, -(-rows // ROWS_PER_PARTITION))
    path = scratch_path(df.sparkSession, "points")
    whole.repartition(parts).mapInArrow(pack, "keys binary, values binary").write.parquet(path)
    return Points(df.sparkSession.read.schema("keys binary, values binary").parquet(path), dims, shift, rows, parts)


@contextmanager
def in_memory(points: Points):
    """The blocks stay in memory for the passes of the block."""
    points.blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield points
    finally:
        points.blocks.unpersist()


def _unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for keys, values in zip(batch.column(0), batch.column(1)):
        yield np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(values.as_buffer(), np.float64).reshape(-1, dims)


def uniform(keys: np.ndarray, start: int, step: int) -> np.ndarray:
    """Numbers in (0, 1] from a hash of (key, start, step)."""
    x = keys + np.uint64((start * 1_000_003 + step * 7_919 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def seeded_centres(points: Points, starts: Sequence[int], k: int) -> dict[int, np.ndarray]:
    """k centres per start by k-means++; the first j of them are the seeding for j clusters. With fewer distinct
    points than k the last centres repeat a point."""
    dims = points.dims
    chosen: dict[int, list[tuple]] = {s: [] for s in starts}
    names = [f"f{i}" for i in range(dims)]
    ddl = "start long, race double, key long, " + ", ".join(f"{n} double" for n in names)

    for step in range(k):
        held = {s: np.array(c, np.float64).reshape(-1, dims) for s, c in chosen.items()}

        def draw(batches: Iterator[pa.RecordBatch], held=held, step=step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                for keys, x in _unpacked(batch, dims):
                    for s, centres in held.items():
                        weight = np.ones(len(keys))
                        if len(centres):
                            weight = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
                        with np.errstate(divide="ignore"):
                            race = np.where(weight > 0, -np.log(uniform(keys, s, step)) / weight, np.inf)
                        for i in np.flatnonzero(race == race.min()):
                            mine = (float(race[i]), int(keys[i].astype(np.int64)), *map(float, x[i]))
                            best[s] = min(best.get(s, mine), mine)
            rows = [(s, *b) for s, b in best.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["start", "race", "key", *names])

        found = points.blocks.mapInArrow(draw, ddl)
        if points.parts > DRIVER_MERGE:
            found = found.groupBy("start").agg(F.min(F.struct("race", "key", *names)).alias("w")).select("start", "w.*")
        won: dict[int, tuple] = {}
        for start, *draw_row in found.collect():
            won[start] = min(won.get(start, tuple(draw_row)), tuple(draw_row))
        for start, draw_row in won.items():
            chosen[start].append(draw_row[2:])
    return {s: np.array(c, np.float64) for s, c in chosen.items()}


def cluster_sums(points: Points, models: Sequence[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """One pass: per model and cluster the rows (n), the sum of squared distances (cost, with ``shift`` places), the sums of the features
    and of the squared norms (norm, with ``shift`` places). A row is in the cluster of its nearest centre, the first of equal ones."""
    dims, shift = points.dims, points.shift
    flat = np.concatenate(models)
    edges = np.cumsum([0, *(len(m) for m in models)])
    norms, names = (flat ** 2).sum(axis=1), [f"s{i}" for i in range(dims)]
    ddl = "cluster long, n long, cost long, norm long, " + ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3 + dims, len(flat)), np.int64)
        for batch in batches:
            for _, x in _unpacked(batch, dims):
                square = (x ** 2).sum(axis=1)
                gaps = norms[None, :] - 2 * (x @ flat.T)  # integers below 2^53: exact whatever the order of operations
                size = np.rint(np.ldexp(square, -shift)).astype(np.int64)
                for a, b in zip(edges, edges[1:]):
                    own = gaps[:, a:b].argmin(axis=1)
                    cost = np.rint(np.ldexp(square + gaps[np.arange(len(x)), a + own], -shift)).astype(np.int64)
                    at = a + own
                    np.add.at(totals[0], at, 1)
                    np.add.at(totals[1], at, cost)
                    np.add.at(totals[2], at, size)
                    for d in range(dims):
                        np.add.at(totals[3 + d], at, x[:, d].astype(np.int64))
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), *(pa.array(t[used]) for t in totals)], names=["cluster", "n", "cost", "norm", *names])

    merged = points.blocks.mapInArrow(run, ddl)
    if points.parts > DRIVER_MERGE:
        merged = merged.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", "norm", *names)])
    found = np.zeros((3 + dims, len(flat)), object)
    found[:] = 0
    for cluster, *sums in merged.collect():
        found[:, cluster] += sums
    return [{"n": found[0, a:b], "cost": found[1, a:b], "norm": found[2, a:b], "sums": found[3:, a:b].T} for a, b in zip(edges, edges[1:])]


def lloyd(points: Points, models: list[Model], max_iter: int = MAX_ITER, tol: float = TOL) -> list[Model]:
    """Move all models' centres until the squared moves of a model's centres sum to ``tol`` at most (in squared units of the features).
    An empty cluster keeps its centre. Sizes and inertia belong to the final centres."""
    moving = list(models)
    still = tol * points.one ** 2
    while moving:
        done = []
        for model, sums in zip(moving, cluster_sums(points, [m.centres for m in moving])):
            fresh = model.centres.copy()
            for c, n in enumerate(sums["n"]):
                if n:
                    fresh[c] = [(2 * int(s) + n) // (2 * n) for s in sums["sums"][c]]  # rounded mean, in integers
            moved = float(((fresh - model.centres) ** 2).sum())
            model.centres, model.passes = fresh, model.passes + 1
            if moved <= still or model.passes >= max_iter:
                done.append(model)
        moving = [m for m in moving if m not in done]
    for model, sums in zip(models, cluster_sums(points, [m.centres for m in models])):
        model.sizes = sums["n"].astype(np.int64)
        model.inertia = float(sum(sums["cost"])) / points.one
    return models


def fit_all(points: Points, ks: Sequence[int], starts: Sequence[int], max_iter: int = MAX_ITER, tol: float = TOL) -> list[Model]:
    """Every (k, start), fitted together."""
    seeds = seeded_centres(points, starts, max(ks))
    return lloyd(points, [Model(k, s, seeds[s][:k].copy()) for k in ks for s in starts], max_iter, tol)


def best_of(models: Sequence[Model]) -> Model:
    """The least inertia; of equal ones the earlier start. Its clusters are put in the order of their centres."""
    best = min(models, key=lambda m: (m.inertia, m.start))
    order = sorted(range(best.k), key=lambda c: tuple(best.centres[c]))
    return Model(best.k, best.start, best.centres[order], best.sizes[order], best.inertia, best.passes)


def silhouettes(points: Points, models: Sequence[Model]) -> list[float]:
    """Mean squared-Euclidean silhouette per model (null-free points; a point alone in its cluster has 0). The mean squared distance of a point to
    a cluster follows from the cluster's size, sum and sum of squared norms."""
    sums = cluster_sums(points, [m.centres for m in models])
    dims, centres = points.dims, [m.centres for m in models]
    sizes = [s["n"].astype(np.float64) for s in sums]
    means = [np.array([[float(v) / max(n, 1) for v in row] for row, n in zip(s["sums"], s["n"])]) for s in sums]
    norms = [np.array([float(v) * points.one / max(n, 1) for v, n in zip(s["norm"], s["n"])]) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * len(centres)
        for batch in batches:
            for _, x in _unpacked(batch, dims):
                square = (x ** 2).sum(axis=1)
                rows = np.arange(len(x))
                for m, c in enumerate(centres):
                    own = ((c ** 2).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
                    # mean squared distances, elementwise so that a point's value doesn't depend on its block
                    gaps = square[:, None] + norms[m][None, :]
                    for d in range(dims):
                        gaps = gaps - 2 * x[:, d][:, None] * means[m][:, d][None, :]
                    n = sizes[m][own]
                    inside = gaps[rows, own] * n / np.maximum(n - 1, 1)
                    gaps[rows, own] = np.inf
                    gaps[:, sizes[m] == 0] = np.inf
                    outside = gaps.min(axis=1)
                    scale = np.maximum(inside, outside)
                    with np.errstate(invalid="ignore"):
                        value = np.where((n > 1) & (scale > 0) & np.isfinite(outside), (outside - inside) / scale, 0.0)
                    totals[m] += int(np.rint(np.ldexp(value, SILHOUETTE_SHIFT)).astype(np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int64()), pa.array(totals, pa.int64())], names=["model", "total"])

    found = points.blocks.mapInArrow(run, "model long, total long").groupBy("model").agg(F.sum("total").alias("total")).collect()
    return [t / (1 << SILHOUETTE_SHIFT) / points.rows for _, t in sorted((r["model"], r["total"]) for r in found)]


def nearest(features: Sequence[Column], model: Model, shift: int) -> Column:
    """The number of the nearest centre, as a JVM expression on the same fixed-point values."""
    whole = [fixed(f.cast("double"), shift).cast("double") for f in features]
    gaps = F.array(*[sum(((w - float(v)) * (w - float(v)) for w, v in zip(whole[1:], centre[1:])),
                         (whole[0] - float(centre[0])) * (whole[0] - float(centre[0]))) for centre in model.centres])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
