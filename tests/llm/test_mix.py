"""Cube mixing: targets, balance, probabilities, reruns."""

import numpy as np
import pytest

from ledgerline.llm import cube_mix
from tests.llm.samples import edge_docs, empty_docs


def water_level(sizes, weights, cap):
    left, target, total = set(range(len(sizes))), [0.0] * len(sizes), sum(sizes)
    while left:
        level = (total - sum(target[k] for k in range(len(sizes)) if k not in left)) / sum(weights[k] for k in left)
        over = {k for k in left if level * weights[k] > cap * sizes[k] + 1e-9}
        if not over:
            for k in left:
                target[k] = level * weights[k]
            return target
        for k in over:
            target[k] = cap * sizes[k]
        left -= over
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 2, 1000, 5, 0], [7], [0, 0], [3, 300, 30, 3000, 1, 1, 1, 90]])
def test_targets(spark, sizes):
    names = [None if k == len(sizes) - 1 else f"s{k:02}" for k in range(len(sizes))]
    df = spark.createDataFrame([(n, s) for n, s in zip(names, sizes)], "source string, size long")
    got = {r["source"]: r["target"] for r in cube_mix.source_targets(df).collect()}
    want = water_level(sizes, [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))], 3.0)
    assert [got[n] for n in names] == pytest.approx(want)


def corpus(spark, n=3000):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(k, "w " * int(s), "big" if k % 3 else f"s{k % 4}") for k, s in enumerate(rng.lognormal(3, 1.2, n) + 1)],
                                 "doc_id long, text string, source string").repartition(4)


def test_balance_and_reruns(spark):
    df = corpus(spark)
    out = cube_mix.mix_sources(df, block=200).toPandas()
    again = cube_mix.mix_sources(df.repartition(7), block=200).toPandas()
    order = lambda x: x.sort_values("doc_id").reset_index(drop=True)
    by = out.groupby("source").agg(n=("size", "size"), has=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), copies=("copies", "sum"))
    assert len(out) == 3000 and (out.taken <= 3 * out["size"]).all()
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 60).all()
    assert (abs(by.copies - by.n * by.target / by.has) <= 0.03 * by.copies + 5).all()
    assert order(out).equals(order(again))  # other partitions, same answer


def test_probabilities_hold():
    size = np.array([900.0, 400, 60, 50, 50, 40, 30, 20, 10, 5, 5, 1])
    start = np.array([0.2, 0.7, 0.5, 0.5, 0.4, 0.3, 0.9, 0.1, 0.5, 0.6, 0.2, 0.5])
    total = np.zeros(len(size))
    for k in range(4000):
        p, draw = start.copy(), np.random.Generator(np.random.PCG64(k))
        cube_mix.fly(p, size, draw)
        cube_mix.land(p, size, draw)
        assert set(np.unique(p)) <= {0.0, 1.0}
        total += p
    assert np.abs(total / 4000 - start).max() < 0.04


def test_edges(spark):
    df = edge_docs(spark)
    out = cube_mix.mix_sources(df)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    assert out.count() == df.count() and out.filter("size = 0 and taken <> 0").count() == 0
    assert cube_mix.mix_sources(empty_docs(spark)).count() == 0


def test_repeated_rows_spread_over_blocks(spark, monkeypatch):
    """A third of all rows are one document repeated with its id: no block holds many more than ``block`` rows."""
    from pyspark.sql import functions as F
    rows = [(k, "w " * (1 + k % 40), f"s{k % 3}") for k in range(2000)] + [(7, "same text of five words", "s0")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    largest, plain = [], cube_mix.flight_level

    def level(units, n, seed):
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "h"), F.col("blocks"))
        largest.append(units.groupBy("sid", block).count().agg(F.max("count")).first()[0] or 0)
        return plain(units, n, seed)

    monkeypatch.setattr(cube_mix, "flight_level", level)
    out = cube_mix.mix_sources(df, block=100).toPandas()
    assert len(out) == 3000 and max(largest) <= 3 * 100
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 60).all() and (out.taken <= 3 * out["size"]).all()
