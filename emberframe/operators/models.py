"""Covariance and principal components, clusters and probes over vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov) of an ARRAY column, population covariance: each partition sends one matrix of sums, which add up.

    Vectors that are null or hold a null are left out; all others must have one length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, 0.0, 0.0
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), dtype=float)
            if len(x):
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        if n:
            d = len(s)
            i, j = np.indices((d, d)).reshape(2, -1)
            yield pd.DataFrame({"i": i, "j": j, "n": n, "si": s[i], "sj": s[j], "q": q.ravel()})

    ok = df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(vector)
    g = ok.mapInPandas(run, "i int, j int, n long, si double, sj double, q double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "q")])
    return g.select("i", "j", (F.col("q") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("cov"))


def moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of an ARRAY column; only these d + d x d numbers come to the driver."""
    ok = df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    means = ok.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
    mean = np.array([r["m"] for r in sorted(means, key=lambda r: r["i"])])
    c = np.zeros((len(mean), len(mean)))
    for r in covariance(df, vector).collect():
        c[r["i"], r["j"]] = r["cov"]
    return mean, c


@dataclass(frozen=True)
class CalibratedProjection:
    """Standardised vectors on the directions of probes and on the components of what these leave: (x - mean) / std times basis."""

    mean: np.ndarray
    std: np.ndarray
    basis: np.ndarray
    names: tuple[str, ...]

    def project(self, df: DataFrame, vector: str, name: str = "coords") -> DataFrame:
        """df with the coordinates as an array, by built-in expressions."""
        weights = self.basis / self.std[:, None]
        offset = self.mean @ weights
        dots = [
            F.aggregate(F.zip_with(vector, F.lit([float(x) for x in w]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) - float(o)
            for w, o in zip(weights.T, offset)
        ]
        return df.withColumn(name, F.array(*dots))


def calibrated_projection(df: DataFrame, vector: str, targets: list[str], label: str | None, k: int, ridge: float = 1e-3) -> CalibratedProjection:
    """Directions that tell each numeric target (ridge) and the 0/1 label (logistic), made orthonormal in this order, then the k
    largest principal components of the vectors without them.

    The ridge weights come from the joint covariance of vectors and targets, one pass over all rows whose parts are all there; the
    label's come from a logistic regression. Directions that those before explain wholly are dropped.
    """
    both = df.withColumn("__v", F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(*[F.col(t).cast("double") for t in targets])))
    mean, c = moments(both, "__v")
    d = len(mean) - len(targets)
    std = np.sqrt(np.maximum(np.diag(c)[:d], 1e-12))
    z = c[:d, :d] / std[:, None] / std[None, :]
    found = [(t, np.linalg.solve(z + ridge * np.eye(d), c[:d, d + i] / std)) for i, t in enumerate(targets)]
    if label is not None:
        x = df.filter(F.col(label).isNotNull()).withColumn("__x", array_to_vector(vector)).withColumn("__y", F.col(label).cast("double"))
        fit = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=0.01, maxIter=30).fit(x.select("__x", "__y"))
        found.append((label, np.array(fit.coefficients.toArray()) * std))
    basis, names = np.zeros((d, 0)), []
    for name, w in found:
        size = np.linalg.norm(w)
        w = w - basis @ (basis.T @ w)
        if np.linalg.norm(w) > 1e-6 * max(size, 1e-12):
            basis, names = np.column_stack([basis, w / np.linalg.norm(w)]), [*names, name]
    rest = np.eye(d) - basis @ basis.T
    values, vectors = np.linalg.eigh(rest @ z @ rest)
    top = vectors[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), range(top.shape[1])])
    return CalibratedProjection(mean[:d], std, np.column_stack([basis, top]), (*names, *[f"rest{i}" for i in range(top.shape[1])]))


def region_clusters(df: DataFrame, coords: str, region: str, key: str, k: int, per_region: int = 5000, seed: int = 1) -> DataFrame:
    """df with `cluster`: k-means is fitted on the per_region rows of each region that come first by hash (all of smaller ones), and every row gets its nearest centre.

    The fitted sample is the documented bound; assignment is one expression over all rows, the smaller number on ties. Rows without
    coordinates get null.
    """
    w = Window.partitionBy(region).orderBy(F.xxhash64(F.lit(seed), key), key)
    sample = df.filter(F.col(coords).isNotNull()).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= per_region)
    model = KMeans(k=k, seed=seed, featuresCol="__x", maxIter=20).fit(sample.select(array_to_vector(coords).alias("__x")))
    far = lambda c: F.aggregate(F.zip_with(coords, F.lit([float(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(model.clusterCenters())]))
    return df.withColumn("cluster", F.when(F.col(coords).isNotNull(), nearest["i"]))


def principal_components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest variances and their directions as columns, the largest entry of each being positive.

    Only the covariance matrix, d x d numbers, comes to the driver.
    """
    rows = covariance(df, vector).collect()
    d = int(np.sqrt(len(rows)))
    c = np.zeros((d, d))
    for r in rows:
        c[r["i"], r["j"]] = r["cov"]
    w, v = np.linalg.eigh(c)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    return w, v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])


def project_components(df: DataFrame, vector: str, directions: np.ndarray, name: str = "components") -> DataFrame:
    """df with the coordinates of a vector on the directions, as an array of dot products."""
    dots = [
        F.aggregate(F.zip_with(vector, F.lit([float(x) for x in col]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        for col in directions.T
    ]
    return df.withColumn(name, F.array(*dots))


def clusters(df: DataFrame, vector: str, k: int, seed: int = 1) -> DataFrame:
    """df with `cluster` by k-means on all rows."""
    x = df.withColumn("__x", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster", maxIter=20).fit(x)
    return model.transform(x).drop("__x")


def probes(df: DataFrame, vector: str, target: str, label: str) -> dict[str, float]:
    """How well a standardised vector tells a number (ridge, R2) and a class (logistic, accuracy)."""
    x = df.withColumn("__x", array_to_vector(vector))
    x = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(x).transform(x).cache()
    r2 = LinearRegression(featuresCol="__z", labelCol=target, regParam=0.1).fit(x).summary.r2
    acc = LogisticRegression(featuresCol="__z", labelCol=label, regParam=0.01, maxIter=30).fit(x).summary.accuracy
    x.unpersist()
    return {"r2": r2, "accuracy": acc}


__all__ = ["CalibratedProjection", "calibrated_projection", "clusters", "covariance", "moments", "region_clusters", "principal_components", "probes", "project_components", "vector_to_array"]
