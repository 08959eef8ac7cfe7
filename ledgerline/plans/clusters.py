"""Customer clustering on standardised RFM features (K-Means, principal components, silhouette).

Features: raw recency, log1p(frequency), log1p(monetary), each standardised with the population
standard deviation (a constant column keeps scale 1). For the clustering, mean and deviation come from exact integer sums,
so a feature's value doesn't depend on the order of the rows.

K-Means is :mod:`ledgerline.operators.kmeans`: all starts (and, in the sweep, all k) share every pass, and sums are integers, so the answer
is the same for any layout. The lowest within-cluster sum of squares wins. Cluster ids are numbered by the centres'
standardised recency (then frequency, monetary). Silhouette is the squared-Euclidean form, which is linear in the data (the exact
Euclidean silhouette needs all pairs of customers).

``with_fitted_clusters(model)`` fits once: every panel of that model then reads the written assignment.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import round_ratio
from ledgerline.model import SalesModel
from ledgerline.operators import kmeans
from ledgerline.plans.rfm import positive_base
from ledgerline.session import cut_lineage

FEATURES = ("z_recency", "z_frequency", "z_monetary")
SEED = 42
N_INIT = 10
FITTED = "fitted_clusters"
RAW_SHIFT = 20  # binary places of a raw feature in the exact sums


def standardise(df: DataFrame, raw: dict[str, Column]) -> DataFrame:
    """Add ``z_<name>`` columns. All means and population standard deviations come from one
    aggregation, used as a single struct-valued scalar subquery."""
    stats = df.select(*[expr.alias(name) for name, expr in raw.items()]).agg(F.struct(
        *[F.avg(n).alias("mean_" + n) for n in raw],
        *[F.stddev_pop(n).alias("std_" + n) for n in raw])).scalar()
    out = df
    for name, expr in raw.items():
        scale = F.coalesce(F.nullif(stats["std_" + name], F.lit(0.0)), F.lit(1.0))
        out = out.withColumn("z_" + name, (expr - stats["mean_" + name]) / scale)
    return out


def rfm_feature_frame(model: SalesModel, base: DataFrame | None = None) -> DataFrame:
    """Standardised features over the positive-spend customer base (``base``: a materialised
    :func:`~ledgerline.plans.rfm.positive_base`, shared when the caller also scores it)."""
    # Materialise the customer base once: the statistics and the features both read it.
    base = base if base is not None else cut_lineage(positive_base(model), "rfm-base")
    base = base.withColumn("monetary", F.col("monetary").cast("double"))
    feats = standardise(base, {
        "recency": F.col("recency").cast("double"),
        "frequency": F.log1p(F.col("frequency").cast("double")),
        "monetary": F.log1p(F.col("monetary")),
    })
    return feats


def rfm_features(model: SalesModel) -> DataFrame:
    """customer_id, raw RFM and the three standardised features (rounded to 9 places)."""
    f = rfm_feature_frame(model)
    return f.select("customer_id", "recency", "frequency", "monetary",
                    *[(F.round(F.col(c) * 1e9, 0) / 1e9).alias(c) for c in FEATURES])


def exact_moments(df: DataFrame, raw: list[Column], pairs: bool = False) -> tuple[int, list[Fraction], list[list[Fraction]]]:
    """Rows, means and population covariances (only variances unless ``pairs``) of numbers taken with ``RAW_SHIFT`` binary places, from
    integer sums: equal for every order of the rows."""
    n = len(raw)
    whole = df.select(*[kmeans.fixed(c.cast("double"), RAW_SHIFT).cast("decimal(19,0)").alias(f"r{i}") for i, c in enumerate(raw)])
    wanted = [(i, j) for i in range(n) for j in range(i, n) if pairs or i == j]
    row = whole.agg(F.count("*").alias("n"), *[F.sum(f"r{i}").alias(f"s{i}") for i in range(n)],
                    *[F.sum((F.col(f"r{i}") * F.col(f"r{j}")).cast("decimal(38,0)")).alias(f"q{i}_{j}") for i, j in wanted]).first()
    rows, one = row["n"], 1 << RAW_SHIFT
    if not rows:
        raise ValueError("no rows to standardise")
    means = [Fraction(int(row[f"s{i}"]), rows * one) for i in range(n)]
    cov = [[Fraction(0)] * n for _ in range(n)]
    for i, j in wanted:
        cov[i][j] = cov[j][i] = Fraction(int(row[f"q{i}_{j}"]), rows * one * one) - means[i] * means[j]
    return rows, means, cov


def feature_vectors(model: SalesModel, base: DataFrame | None = None) -> DataFrame:
    """customer_id, recency, frequency, monetary and the standardised features as a vector, checkpointed. ``base``: a materialised
    :func:`~ledgerline.plans.rfm.positive_base`, shared when the caller also scores it."""
    base = base if base is not None else cut_lineage(positive_base(model), "rfm-base")
    base = base.withColumn("monetary", F.col("monetary").cast("double"))
    raw = [F.col("recency").cast("double"), F.log1p(F.col("frequency").cast("double")), F.log1p(F.col("monetary"))]
    _, means, cov = exact_moments(base, raw)
    scales = [math.sqrt(cov[i][i]) or 1.0 for i in range(len(raw))]
    scaled = base.select("*", *[((x - float(m)) / s).alias(z) for z, x, m, s in zip(FEATURES, raw, means, scales)])
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scaled)
    return cut_lineage(assembled.select("customer_id", "recency", "frequency", "monetary", "features"))


def _features() -> list[Column]:
    values = vector_to_array(F.col("features"))
    return [values[i] for i in range(len(FEATURES))]


def assign_clusters(data: DataFrame, k: int = 4, n_init: int = N_INIT, seed: int = SEED) -> DataFrame:
    """``data`` (customer_id, features) with the ``cluster`` of the best of ``n_init`` starts."""
    with kmeans.in_memory(kmeans.fixed_points(data, "customer_id", _features())) as points:
        best = kmeans.best_of(kmeans.fit_all(points, [k], range(seed, seed + n_init)))
        return data.withColumn("cluster", kmeans.nearest(_features(), best, points.shift))


def clustered(model: SalesModel, k: int = 4, n_init: int = N_INIT, base: DataFrame | None = None) -> DataFrame:
    """Customers with features and cluster: the model's fitted ones if it has them for this k and number of starts, else a new fit."""
    fitted = model.extras.get((FITTED, k, n_init))
    return fitted if fitted is not None else assign_clusters(feature_vectors(model, base), k, n_init)


def with_fitted_clusters(model: SalesModel, k: int = 4, n_init: int = N_INIT) -> SalesModel:
    """The model with one fit, written to the shared folder; ``cluster_customers``, ``cluster_pca``, ``cluster_profiles``, ``cluster_totals``
    and ``save_rfm_segments`` with this k and number of starts read it instead of fitting again."""
    return model.replace(extras={**model.extras, (FITTED, k, n_init): cut_lineage(clustered(model, k, n_init))})


def cluster_customers(model: SalesModel, k: int = 4, n_init: int = N_INIT) -> DataFrame:
    return clustered(model, k, n_init).select("customer_id", "recency", "frequency", "monetary", "cluster")


def cluster_sweep(model: SalesModel, ks=range(2, 9), n_init: int = N_INIT) -> DataFrame:
    """Elbow data: for each k, the best start's inertia and its (squared-Euclidean) silhouette. All fits share every pass."""
    data = feature_vectors(model)
    with kmeans.in_memory(kmeans.fixed_points(data, "customer_id", _features())) as points:
        fits = kmeans.fit_all(points, list(ks), range(SEED, SEED + n_init))
        best = [kmeans.best_of([m for m in fits if m.k == k]) for k in ks]
        values = kmeans.silhouettes(points, best)
    rows = [(int(k), m.inertia, v) for k, m, v in zip(ks, best, values)]
    return model.spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def cluster_pca(model: SalesModel, k: int = 4, n_init: int = N_INIT) -> DataFrame:
    """Two principal components of the standardised features per customer, with the explained
    variance ratios. The loadings come from the exact covariance; each component's sign is fixed so its largest loading is positive."""
    data = clustered(model, k, n_init)
    _, _, cov = exact_moments(data, _features(), pairs=True)
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign([v[abs(v).argmax()] for v in vectors.T])
    total = float(values.sum()) or 1.0
    score = lambda j: sum((f * float(w) for f, w in zip(_features()[1:], vectors[1:, j])), _features()[0] * float(vectors[0, j]))
    return data.select("customer_id", "cluster", score(0).alias("pc1"), score(1).alias("pc2"),
                       F.lit(float(values[0]) / total).alias("pc1_variance_ratio"),
                       F.lit(float(values[1]) / total).alias("pc2_variance_ratio"))


def profiles_of(clustered: DataFrame) -> DataFrame:
    g = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("recency").alias("_r"), F.count("recency").alias("_rn"),
        F.sum("frequency").alias("_f"), F.count("frequency").alias("_fn"),
        F.sum(F.col("monetary").cast("decimal(38,2)")).alias("_m"), F.count("monetary").alias("_mn"),
    )
    return g.select("cluster", "count",
                    round_ratio("_r", "_rn", 2).alias("avg_recency"),
                    round_ratio("_f", "_fn", 2).alias("avg_frequency"),
                    round_ratio("_m", "_mn", 2).alias("avg_monetary")).orderBy("cluster")


def cluster_totals(model: SalesModel, k: int = 4, n_init: int = 1) -> DataFrame:
    """Customers and money over all clusters, and how many clusters there are: must equal the positive base."""
    data = cluster_customers(model, k, n_init)
    return data.agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("cluster").alias("clusters"),
                    F.sum(F.col("monetary").cast("decimal(38,2)")).cast("double").alias("monetary"))


def feature_variance(model: SalesModel) -> DataFrame:
    """Explained variance ratios of the three principal components of the standardised features, largest first
    (six places)."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rfm_feature_frame(model))
    pca = PCA(k=3, inputCol="features", outputCol="pcs").fit(data)
    return model.spark.createDataFrame([(i + 1, round(float(v), 6)) for i, v in enumerate(pca.explainedVariance)], "component int, ratio double")


def cluster_profiles(model: SalesModel, k: int = 4, n_init: int = N_INIT) -> DataFrame:
    return profiles_of(cluster_customers(model, k, n_init))
