"""Classification of pixel or feature vectors.

Defined cases: rows with a null vector, or a null in it, are not classified; samples without a label do not train; without
samples nothing is classified.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from .graph import stored
from .stats import normalize_bands
from .texture import edge_strength, median_labels


def kmeans_labels(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """Labels 1..k of standardized vectors; these are stored, since scaling, clustering and labelling all read them."""
    return _clusters(stored(df.select("row", "col", *columns), "kmeans"), columns, k, seed)


def _clusters(x: DataFrame, columns: list[str], k: int, seed: int) -> DataFrame:
    """kmeans_labels of vectors that are stored already."""
    x = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip").transform(x)
    if x.isEmpty():
        return x.select("row", "col", F.lit(None).cast("int").alias("label")).limit(0)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    model = KMeans(k=k, seed=seed, maxIter=50).fit(x)
    return model.transform(x).select("row", "col", (F.col("prediction") + 1).alias("label"))


def segment_features(df: DataFrame, bands: list[str], height: int, width: int, compactness: float = 0.15) -> DataFrame:
    """(row, col, bands, y, x, edge) of every valid pixel, stored once: bands cut to their 2nd and 98th percentiles and scaled to 0..1, places
    scaled to 0..compactness, and the gradient's length of the bands' mean as a share of its largest at a valid pixel; missing
    pixels count as zeros in it."""
    pixels, zero = normalize_bands(df, bands)
    x = edge_strength(pixels.withColumn("mean", sum(F.col(b) for b in bands) / len(bands)), "mean", height, width, zero)
    x = stored(x.select("row", "col", *bands, "edge"), "segments")
    top = x.agg(F.max("edge")).first()[0] or 1.0
    place = lambda at, size: F.col(at) / max(size - 1, 1) * compactness
    return x.select("row", "col", *bands, place("row", height).alias("y"), place("col", width).alias("x"), (F.col("edge") / top).alias("edge"))


def spectral_spatial(df: DataFrame, bands: list[str], height: int, width: int, k: int, compactness: float = 0.15, smoothing: int = 1, seed: int = 42) -> DataFrame:
    """Labels 1..k by k-means of segment_features, smoothed by the median of windows of 2 * smoothing + 1 (0 where most of a window is missing)."""
    labels = _clusters(segment_features(df, bands, height, width, compactness), [*bands, "y", "x", "edge"], k, seed)
    return median_labels(labels, "label", height, width, smoothing) if smoothing > 0 else labels


def nearest_centroid(samples: DataFrame, rows: DataFrame, key: str, columns: list[str], label: str) -> DataFrame:
    """The label whose mean vector is nearest (squared distance, ties to the smaller label). One row per label is broadcast."""
    centers = samples.groupBy(F.col(label).alias("center")).agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    distance = sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in columns)
    return rows.crossJoin(F.broadcast(centers)).groupBy(key).agg(F.min_by("center", F.struct(F.round(distance, 9).alias("d"), "center")).alias("predicted"))


def random_forest(samples: DataFrame, rows: DataFrame, vector: str, label: str, trees: int = 20, seed: int = 42) -> DataFrame:
    """Class-balanced random forest on an array column; training rows are stored, since every level of the trees reads them."""
    samples = samples.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.filter(F.col(vector).isNotNull())
    n = samples.count()
    if not n:
        return rows.limit(0).withColumn("prediction", F.lit(None).cast("double"))
    weights = samples.groupBy(label).agg((F.lit(float(n)) / F.count("*")).alias("weight"))
    train = stored(samples.join(F.broadcast(weights), label).select(F.col(vector).alias("features"), label, "weight"), "forest")
    model = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, seed=seed).fit(train.withColumn("features", array_to_vector(F.col("features"))))
    found = model.transform(rows.withColumn("features", array_to_vector(F.col(vector))))
    return found.drop("features", "rawPrediction", "probability")


def scores_to_labels(scores: DataFrame) -> DataFrame:
    """Argmax over channels (row, col, channel, score), ties to the smaller channel; labels from 1."""
    return scores.groupBy("row", "col").agg((F.max_by("channel", F.struct("score", -F.col("channel"))) + 1).alias("label"))


def kernel_svm(rows: DataFrame, vector: str, label: str, features: int = 64, gamma: float = 0.5, seed: int = 42, samples: DataFrame | None = None) -> DataFrame:
    """Predictions of one linear machine for each label on random Fourier features of an RBF kernel (an approximation).

    Trained on samples, or on the rows themselves where there are none.
    """
    sound = lambda df: df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    rows = sound(rows)
    samples = sound(rows if samples is None else samples).filter(F.col(label).isNotNull())
    dim = samples.select(F.size(vector).alias("n")).first()
    if dim is None:
        return rows.limit(0).withColumn("prediction", F.lit(None).cast("double"))
    rng = np.random.default_rng(seed)
    weights, shift = rng.normal(0, (2 * gamma) ** 0.5, (features, dim[0])), rng.uniform(0, 2 * np.pi, features)
    mapped = F.transform(
        F.array(*(F.struct(F.array(*(F.lit(float(x)) for x in w)).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, shift, strict=True))),
        lambda t: F.cos(F.aggregate(F.zip_with(t["w"], F.col(vector), lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x) + t["b"]),
    )
    of = lambda df: stored(df.withColumn("mapped", mapped), "svm").withColumn("features", array_to_vector(F.col("mapped")))
    model = OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01), labelCol=label, parallelism=4).fit(of(samples))
    return model.transform(of(rows)).drop("features", "mapped", "rawPrediction")
