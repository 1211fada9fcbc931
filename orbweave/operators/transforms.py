"""Global transforms: Haar wavelet, principal components, two-dimensional Fourier transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def haar(df: DataFrame, value: str = "value") -> DataFrame:
    """One level: averages and differences of each 2 x 2 cell. A cell at an odd edge repeats its last row or column."""
    at = lambda r, c: F.max(F.when((F.col("row") % 2 == r) & (F.col("col") % 2 == c), F.col(value)))
    g = df.groupBy(F.expr("row div 2").alias("row"), F.expr("col div 2").alias("col")).agg(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d"))
    a = F.col("a")
    b, c = F.coalesce("b", "a"), F.coalesce("c", "a")
    d = F.coalesce(F.col("d"), F.when(F.col("b").isNull(), c).otherwise(b))
    return g.select("row", "col", ((a + b + c + d) / 4).alias("ll"), ((a - b + c - d) / 4).alias("lh"), ((a + b - c - d) / 4).alias("hl"), ((a - b - c + d) / 4).alias("hh"))


def pca(df: DataFrame, bands: list[str], k: int) -> tuple[DataFrame, np.ndarray]:
    """Projections on the k largest components and the explained ratios. Only the covariance matrix reaches the driver."""
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    row = df.agg(*(F.covar_samp(bands[i], bands[j]) for i, j in pairs), *(F.avg(b) for b in bands)).first()
    cov = np.zeros((len(bands), len(bands)))
    for (i, j), v in zip(pairs, row, strict=False):
        cov[i, j] = cov[j, i] = v or 0.0
    mean = [row[len(pairs) + i] or 0.0 for i in range(len(bands))]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    vectors = vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    project = [sum((F.col(b) - float(mean[i])) * float(vectors[i, c]) for i, b in enumerate(bands)).alias(f"pc{c + 1}") for c in range(vectors.shape[1])]
    return df.select("row", "col", *project), np.maximum(values[order], 0) / max(values.sum(), 1e-300)


def fourier(df: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """log(1 + magnitude) of the centered transform: rows are transformed, then columns; missing pixels take the mean."""
    mean = df.agg(F.avg(value).alias("mean")).first()[0] or 0.0

    def line(key: str, other: str, size: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.full(size, complex(mean) if key == "row" else 0j)
            x[pdf[other].to_numpy()] = pdf["re"].fillna(mean).to_numpy() + 1j * pdf["im"].to_numpy()
            y = np.fft.fft(x)
            return pd.DataFrame({key: np.full(size, pdf[key].iloc[0]), other: np.arange(size), "re": y.real, "im": y.imag})

        return run

    # A row without any valid pixel is a row of means.
    rows = df.sparkSession.range(height).select(F.col("id").alias("row"))
    data = rows.join(df.select("row", "col", F.col(value).alias("re")), "row", "left").select("row", F.coalesce("col", F.lit(0)).alias("col"), "re", F.lit(0.0).alias("im"))
    schema = "row long, col long, re double, im double"
    first = data.groupBy("row").applyInPandas(line("row", "col", width), schema)
    both = first.groupBy("col").applyInPandas(line("col", "row", height), "col long, row long, re double, im double")
    return both.select(((F.col("row") + height // 2) % height).alias("row"), ((F.col("col") + width // 2) % width).alias("col"), F.log1p(F.hypot("re", "im")).alias("value"))


def map_chunks(df: DataFrame, fn, schema: str, size: int = 256) -> DataFrame:
    """User code over blocks of size x size pixels: fn gets and returns a pandas frame; a block is bounded by its size."""
    keyed = df.withColumns({"crow": F.expr(f"row div {size}"), "ccol": F.expr(f"col div {size}")})
    return keyed.groupBy("crow", "ccol").applyInPandas(fn, schema)


def predict_chunks(df: DataFrame, model, columns: list[str]) -> DataFrame:
    """A caller's model over Arrow batches: model(matrix of columns) gives one score per row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "score": np.asarray(model(pdf[columns].to_numpy()), float)})

    return df.mapInPandas(run, "row long, col long, score double")
