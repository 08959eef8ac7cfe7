"""Mixing sources to target weights by Cube-method balanced sampling.

Each source gets a target number of words: its weight's share of all words, at most ``max_repeats`` times what it
has, the excess shared again by weight. Its rate r = target / size says how often each document
is taken on average: floor(r) times for sure, once more with probability frac(r). Those fractional
probabilities go through the Cube method's flight: they move along directions that change neither the expected number of documents nor
of words, until they are 0 or 1, so both totals are met but for a small landing problem.

Distribution: a source's documents are dealt by hash into blocks of about ``block`` documents; each block flies on its own
and leaves at most two documents undecided (one per balancing equation). Those go on to the next level's blocks,
fewer by a factor of block / 2 each time, until a source has one block; its last undecided documents land: of the
outcomes that keep their probabilities the pair closest to the word total is drawn. A source with a third of all rows is
many blocks; no task holds more than a few times ``block`` documents.

Random numbers come from hashes of the seed, source, level and block, blocks and order from the documents' own hashes: reruns agree,
also with other partitions.

Nulls and odd rows: null text has size 0 and is taken 0 words; a null source is a source, last in order; null or repeated
ids stay separate rows (equal rows are interchangeable); a source without words gets target 0;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import table, words, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
BLOCK = 2000
SEED = 42
EPS = 1e-9
GIANT = 2.0


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, n_docs, source_size, target) from the documents' (source, size). Sources are few next to documents: the
    windows below run over one row per source.

    Water level: target = min(cap, level * weight). Sources reach their cap in the order of cap / weight, so the level is that
    of the first source, in this order, that stays below its cap.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", max_repeats * F.col("source_size"))
    whole = Window.partitionBy(F.lit(1))
    ratio_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    by_ratio = ratio_order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("place", F.row_number().over(ratio_order))
    per = per.withColumn("before_cap", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
    per = per.withColumn("before_weight", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    level = (F.sum("source_size").over(whole) - F.col("before_cap")) / (F.sum("weight").over(whole) - F.col("before_weight"))
    per = per.withColumn("level", level)
    open_level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(open_level["level"] * F.col("weight"), F.col("cap")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def settle_giants(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> None:
    """Decide, in place, documents over ``GIANT`` times the mean size of the smaller ones: each moves against all
    of those along the shortest direction that keeps both totals. Documents come by falling size."""
    undecided = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    for at, k in enumerate(undecided):
        rest = undecided[at + 1:]
        while EPS < p[k] < 1 - EPS:
            rest = rest[(p[rest] > EPS) & (p[rest] < 1 - EPS)]
            mean = size[rest].mean() if len(rest) > 2 else size[k]
            off = size[rest] - mean
            spread = (off * off).sum()
            if size[k] <= GIANT * mean or not spread:
                return
            move = -(1 / len(rest) + (size[k] - mean) * off / spread)
            room = np.where(move > 0, 1 - p[rest], p[rest]) / np.maximum(np.abs(move), 1e-300)
            back = np.where(move > 0, p[rest], 1 - p[rest]) / np.maximum(np.abs(move), 1e-300)
            up, down = min(1 - p[k], room.min()), min(p[k], back.min())
            step = up if draw.random() * (up + down) < down else -down
            p[k] += step
            p[rest] += step * move


def fly(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> None:
    """Cube flight in place for the equations sum(p) and sum(p * size): three undecided documents at
    a time move along the direction that keeps both, until one is decided. At most two stay undecided.

    Documents come by falling size; giants go first. A document much larger than the others of its three would
    hardly move and stay to the landing; it moves against the smallest one, which keeps the words and lets
    the number of documents drift by a fraction. Every move has mean zero, so all probabilities hold.
    """
    settle_giants(p, size, draw)
    probs, sizes = p.tolist(), size.tolist()
    uniform = iter(draw.random(2 * len(probs) + 2).tolist())
    active: list[int] = []
    for k in range(len(probs)):
        if not EPS < probs[k] < 1 - EPS:
            probs[k] = float(round(probs[k]))
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active  # sizes fall from a to c
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if sizes[a] == sizes[c]:
                u = (1.0, -1.0, 0.0)  # equal sizes: any move that keeps the count
            elif 4 * (sizes[b] - sizes[c]) < sizes[a] - sizes[c]:
                u = (sizes[c], 0.0, -sizes[a])
            up = min((1 - probs[i]) / d if d > 0 else probs[i] / -d for i, d in zip(active, u) if d)
            down = min(probs[i] / d if d > 0 else (1 - probs[i]) / -d for i, d in zip(active, u) if d)
            step = up if next(uniform) * (up + down) < down else -down
            for i, d in zip(active, u):
                probs[i] += step * d
                if probs[i] < EPS or probs[i] > 1 - EPS:
                    probs[i] = float(round(probs[i]))
            active = [i for i in active if 0 < probs[i] < 1]
    p[:] = probs


def land(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> None:
    """Decide the last (at most two) documents in place, with their probabilities kept: of all ways to draw both together
    the one with the least expected distance to the word total. Linear, so an extreme one."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left) == 1:
        p[left[0]] = float(draw.random() < p[left[0]])
    elif len(left) == 2:
        a, b = left
        total = p[a] * size[a] + p[b] * size[b]
        best = None
        for both in (max(0.0, p[a] + p[b] - 1), min(p[a], p[b])):
            cases = ((1, 1, both), (1, 0, p[a] - both), (0, 1, p[b] - both), (0, 0, 1 - p[a] - p[b] + both))
            cost = sum(w * abs(x * size[a] + y * size[b] - total) for x, y, w in cases)
            if best is None or cost < best[0]:
                best = (cost, cases)
        at = draw.random()
        for x, y, w in best[1]:
            at -= w
            if at <= 0:
                break
        p[a], p[b] = x, y


FLOWN = "rid bigint, h bigint, sid string, size bigint, p double, left int"


def flight_level(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level: (rid, h, sid, size, p, blocks) -> (rid, h, sid, size, p, left); left is how many blocks the source had,
    0 for a decided document. A source with one block lands as well. Blocks and order follow the document's
    own hash ``h``, not its place in a file."""
    placed = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "h"), F.col("blocks")))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("h", "ascending")])
        sid, blocks, block = (rows[name][0].as_py() for name in ("sid", "blocks", "block"))
        draw = np.random.Generator(np.random.PCG64(_seed(seed, level, sid, block)))
        p, size = rows["p"].to_numpy().copy(), rows["size"].to_numpy().astype(float)
        fly(p, size, draw)
        if blocks == 1:
            land(p, size, draw)
        left = np.where((p > 0) & (p < 1), blocks, 0).astype(np.int32)
        return pa.table({"rid": rows["rid"], "h": rows["h"], "sid": rows["sid"], "size": rows["size"], "p": p, "left": left})

    return placed.groupBy("sid", "block").applyInArrow(run, FLOWN)


def _seed(*parts) -> int:
    import hashlib
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big")


def with_spread_hashes(rows: DataFrame, block: int) -> DataFrame:
    """Rows (rid, h, ...) whose hash ``h`` is shared by more than ``block`` rows (a document repeated with its id) get one of their own, so
    that they spread over blocks like others. Equal rows are interchangeable."""
    crowds = rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(F.col("h").alias("crowd"))
    joined = rows.join(written(crowds, "crowds"), rows["h"] == F.col("crowd"), "left")
    own = F.when(F.col("crowd").isNull(), F.col("h")).otherwise(F.xxhash64("h", "rid"))
    return joined.withColumn("h", own).drop("crowd")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS, block: int = BLOCK,
                seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    size: Column = F.size(words(F.col(text))).cast("bigint")
    own = F.xxhash64(F.col(doc_id), F.col(text), F.col(source))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), own.alias("h"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    rows = with_spread_hashes(rows, block)
    targets = written(source_targets(rows, weights, max_repeats), "targets")
    sid = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null has a name of its own
    rates = targets.withColumn("sid", sid).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = rates.withColumn("blocks", F.greatest(F.ceil(F.col("n_docs") / block), F.lit(1)).cast("int"))
    # one row per source; Spark broadcasts it or splits a hot source's rows
    rated = rows.withColumn("sid", sid).join(rates.select("sid", "source_size", "target", "rate", "blocks"), "sid")
    rated = written(rated.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")), "rated")
    current = rated.filter((F.col("p") > EPS) & (F.col("p") < 1 - EPS) & (F.col("size") > 0)).select("rid", "h", "sid", "size", "p", "blocks")
    drawn, level = [], 0
    while True:
        flown = written(flight_level(current, level, seed), f"flight{level}")
        drawn.append(flown.filter("left = 0 and p > 0.5").select("rid"))
        most = flown.agg(F.max("left")).first()[0] or 0
        if most <= 1:
            break
        fewer = F.greatest(F.ceil(2 * F.col("left") / block), F.lit(1)).cast("int")
        current = flown.filter("left > 0").select("rid", "h", "sid", "size", "p", fewer.alias("blocks"))
        level += 1
    extra = drawn[0]
    for more in drawn[1:]:
        extra = extra.unionByName(more)
    extra = written(extra.withColumn("more", F.lit(1)), "drawn")
    sure = F.when(F.col("p") >= 1 - EPS, 1).otherwise(0)
    copies = (F.col("whole") + F.coalesce("more", sure)).cast("bigint")
    return rated.join(extra, "rid", "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the registered weights."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
