"""Batched K-Means: planted blobs, equal answers for every layout, plain Lloyd and silhouette by hand, MLlib's inertia."""

import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerline.operators import kmeans
from ledgerline.plans import clusters

NAMES = ("x", "y", "z")


def blobs(spark, n=90, seed=1):
    rnd = random.Random(seed)
    centres = [(-4, 0, 1), (4, 4, -4), (0, -5, 5), (6, -3, 0), (-5, 6, -2)]
    rows = [(f"p{c}-{i}", c, *(rnd.gauss(v, .6) for v in centre)) for c, centre in enumerate(centres) for i in range(n)]
    return spark.createDataFrame(rows, "id string, truth int, x double, y double, z double")


def points_of(df):
    return kmeans.fixed_points(df, "id", [F.col(c) for c in NAMES])


def test_blobs_are_found_whatever_the_layout(spark):
    df, seen = blobs(spark), []
    for parts in (1, 7, 40):
        points = points_of(df.repartition(parts, F.xxhash64("id", F.lit(parts))))
        if parts > 1:  # the passes themselves over several partitions and small blocks
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
            points = points_of(df.orderBy(F.xxhash64("id")))
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            points = kmeans.Points(points.blocks.repartition(parts), points.dims, points.shift, points.rows, parts)
        fits = kmeans.fit_all(points, [2, 5, 6], range(4))
        best = [kmeans.best_of([m for m in fits if m.k == k]) for k in (2, 5, 6)]
        seen.append([(m.k, m.start, m.inertia, m.centres.tolist(), m.sizes.tolist(), m.passes) for m in fits] + [kmeans.silhouettes(points, best)])
        got = df.withColumn("c", kmeans.nearest([F.col(c) for c in NAMES], best[1], points.shift)).select("truth", "c").distinct().collect()
        assert len(got) == 5 == len({r.c for r in got})
    assert seen[0] == seen[1] == seen[2]


def test_lloyd_against_plain_numpy(spark):
    df = blobs(spark, 40, 2)
    points = points_of(df)
    one = points.one
    x = np.rint(np.array([[r[c] for c in NAMES] for r in df.collect()]) * one)
    seeds = kmeans.seeded_centres(points, [5], 4)[5]
    assert all((x == s).all(axis=1).any() for s in seeds) and len({tuple(s) for s in seeds}) == 4
    model = kmeans.lloyd(points, [kmeans.Model(4, 5, seeds.copy())])[0]
    c = seeds.copy()
    for _ in range(model.passes):
        own = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(4)])
    own = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.abs(c - model.centres).max() <= model.passes  # centres are rounded once per pass
    assert model.sizes.tolist() == np.bincount(own, minlength=4).tolist()
    assert abs(model.inertia - ((x - c[own]) ** 2).sum() / one ** 2) < 1e-3


def test_seeding_draws_by_squared_distance(spark):
    """The second centre: far points win in proportion to their squared distance."""
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0)], "id string, x double")
    points = kmeans.fixed_points(df, "id", [F.col("x")])
    one = points.one
    seeds = kmeans.seeded_centres(points, range(3000), 2)
    first = [s[0, 0] / one for s in seeds.values()]
    assert all(abs(first.count(v) / 3000 - 1 / 3) < 0.04 for v in (0, 1, 2))
    after_a = [s[1, 0] / one for s in seeds.values() if s[0, 0] == 0]
    assert abs(after_a.count(2.0) / len(after_a) - 0.8) < 0.05 and 0.0 not in after_a


def test_silhouette_matches_mllib(spark):
    df = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(blobs(spark, 50, 3))
    points = points_of(df)
    best = kmeans.best_of(kmeans.fit_all(points, [4], range(2)))
    data = df.withColumn("prediction", kmeans.nearest([F.col(c) for c in NAMES], best, points.shift).cast("double"))
    want = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(data)
    assert abs(kmeans.silhouettes(points, [best])[0] - want) < 1e-4


def test_inertia_is_no_worse_than_mllib(spark, model_check):
    data = clusters.feature_vectors(model_check)
    points = kmeans.fixed_points(data, "customer_id", clusters._features())
    for k in (3, 4, 6):
        best = kmeans.best_of(kmeans.fit_all(points, [k], range(42, 52)))
        theirs = min(KMeans(k=k, seed=s, maxIter=300).fit(data).summary.trainingCost for s in range(42, 45))
        assert best.inertia <= theirs * 1.002


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("c", 5.0)], "id string, x double")
    fit = kmeans.best_of(kmeans.fit_all(kmeans.fixed_points(df, "id", [F.col("x")]), [3], range(3)))
    assert sorted(fit.sizes.tolist()) == [0, 1, 3] and fit.inertia == 0.0  # fewer distinct points than clusters
    one = kmeans.fixed_points(df.filter("id = 'c'"), "id", [F.col("x")])
    assert kmeans.silhouettes(one, kmeans.fit_all(one, [2], [1])) == [0.0]
    for bad in (df.withColumn("x", F.lit(None).cast("double")), df.withColumn("id", F.lit(None).cast("string")), df.limit(0),
                df.withColumn("x", F.lit(float("nan"))), df.withColumn("x", F.lit(float("inf"))), df.withColumn("x", F.lit(1e12))):
        with pytest.raises(ValueError):
            kmeans.fixed_points(bad, "id", [F.col("x")])
    big = kmeans.fixed_points(df.withColumn("x", F.col("x") * 1e5), "id", [F.col("x")])
    assert big.shift < kmeans.MAX_SHIFT and kmeans.fit_all(big, [2], [0])[0].inertia == 0.0


def test_fitted_clusters_are_shared(spark, model_small):
    fitted = clusters.with_fitted_clusters(model_small, n_init=2)
    fresh = sorted(map(tuple, clusters.cluster_customers(model_small, n_init=2).collect()))
    assert sorted(map(tuple, clusters.cluster_customers(fitted, n_init=2).collect())) == fresh
    assert "mapInArrow" not in clusters.cluster_profiles(fitted, n_init=2)._jdf.queryExecution().toString()
    assert clusters.cluster_totals(fitted, n_init=2).first().customers == len(fresh)
    pcs = clusters.cluster_pca(fitted, n_init=2)
    variance = {r.component: r.ratio for r in clusters.feature_variance(model_small).collect()}
    row = pcs.first()
    assert abs(row.pc1_variance_ratio - variance[1]) < 1e-5 and abs(row.pc2_variance_ratio - variance[2]) < 1e-5
    assert not model_small.with_tables(orders=model_small.orders).extras and fitted.with_tables(orders=model_small.orders).extras == {}
