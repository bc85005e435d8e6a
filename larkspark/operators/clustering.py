"""Clustering on relations: k-means by aggregation steps, and a normal mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeds(df: DataFrame, columns: list[str], k: int) -> list[list[float]]:
    """k centroids, evenly spaced between the least and the largest value of each column."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends[0] is None:
        return []
    at = lambda c, i: float(ends[f"lo_{c}"]) + (float(ends[f"hi_{c}"]) - float(ends[f"lo_{c}"])) * (i + 0.5) / k
    return [[at(c, i) for c in columns] for i in range(k)]


def nearest_centroid(columns: list[str], centroids: list[list[float]]) -> Column:
    """The number of the nearest centroid by squared distance, the lower one on a tie: one expression, no join."""
    far = [sum(((F.col(c) - F.lit(x)) ** 2 for c, x in zip(columns, centroid, strict=True)), F.lit(0.0)) for centroid in centroids]
    least = F.least(*far) if len(far) > 1 else far[0]
    out = F.lit(len(far) - 1)
    for i in range(len(far) - 2, -1, -1):
        out = F.when(far[i] == least, F.lit(i)).otherwise(out)
    return out


def kmeans_step(df: DataFrame, columns: list[str], centroids: list[list[float]]) -> DataFrame:
    """Assigns and updates once: cluster, n, and each column's mean."""
    return df.withColumn("cluster", nearest_centroid(columns, centroids)).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def kmeans(df: DataFrame, columns: list[str], k: int, most: int = 20, tolerance: float = 1e-6) -> list[list[float]]:
    """Centroids after convergence. Only k rows go to the driver each round; an empty cluster keeps its centroid."""
    centroids = seeds(df, columns, k)
    for _ in range(most if centroids else 0):
        new = [list(c) for c in centroids]
        for r in kmeans_step(df, columns, centroids).collect():
            new[r["cluster"]] = [r[c] for c in columns]
        moved = max(abs(a - b) for x, y in zip(new, centroids, strict=True) for a, b in zip(x, y, strict=True))
        centroids = new
        if moved <= tolerance:
            break
    return centroids


def mixture_step(df: DataFrame, columns: list[str], parts: list[tuple[float, list[float], list[float]]]) -> DataFrame:
    """One step of expectation maximisation for a mixture of normals with independent columns.

    parts: (weight, means, variances). Returns part, weight, and each column's mean and variance. Responsibilities
    are one expression, their sums partial aggregates; nothing but a row for each part leaves the tasks.
    """
    dense = []
    for weight, means, variances in parts:
        logs = [-((F.col(c) - F.lit(m)) ** 2) / F.lit(2 * v) - F.log(F.lit(v)) / 2 for c, m, v in zip(columns, means, variances, strict=True)]
        dense.append(F.lit(weight) * F.exp(sum(logs[1:], logs[0])))
    total = sum(dense[1:], dense[0])
    own = df.select(*columns, F.posexplode(F.array(*[x / total for x in dense])).alias("part", "r"))
    sums = own.groupBy("part").agg(F.sum("r").alias("n"), F.count("*").alias("rows"), *[F.sum(F.col("r") * F.col(c)).alias(f"s_{c}") for c in columns], *[F.sum(F.col("r") * F.col(c) ** 2).alias(f"q_{c}") for c in columns])
    mean = {c: F.col(f"s_{c}") / F.col("n") for c in columns}
    return sums.select("part", (F.col("n") / F.col("rows")).alias("weight"), *[mean[c].alias(f"mean_{c}") for c in columns], *[(F.col(f"q_{c}") / F.col("n") - mean[c] ** 2).alias(f"var_{c}") for c in columns])


def normal_mixture(df: DataFrame, columns: list[str], k: int, seed: int = 1):
    """A normal mixture by expectation maximisation; returns the fitted model."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    return GaussianMixture(k=k, seed=seed, tol=1e-6, maxIter=200).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(df))
