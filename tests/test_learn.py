"""Classifiers must be right about rows that they were not trained on."""

import numpy as np
from pyspark.sql import functions as F

from orbweave.operators import learn
from orbweave.plans import registry, views


def blobs(spark, n=360):
    rng = np.random.default_rng(4)
    centers = np.array([[0, 0, 0], [4, 4, 0], [0, 4, 4]], float)
    rows = [(i, i // 20, i % 20, i % 3, (centers[i % 3] + rng.normal(0, 0.6, 3)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, row long, col long, label int, v array<double>")


def right(found, truth, guess="prediction"):
    return found.join(truth.select("id", F.col("label").alias("true")), "id").select(F.avg((F.col(guess).cast("int") == F.col("true")).cast("double"))).first()[0]


def test_held_out_accuracy(spark):
    df = blobs(spark)
    train, held = df.filter("id < 240"), df.filter("id >= 240")
    assert right(learn.random_forest(train, held.drop("label"), "v", "label"), held) > 0.95
    assert right(learn.kernel_svm(held.drop("label"), "v", "label", gamma=0.1, samples=train), held) > 0.95
    wide = lambda d: d.select("id", "label", *(F.col("v")[i].alias(f"x{i}") for i in range(3)))
    assert right(learn.nearest_centroid(wide(train), wide(held), "id", ["x0", "x1", "x2"], "label"), held, "predicted") > 0.95


def test_clusters_follow_the_blobs(spark):
    df = blobs(spark)
    found = learn.kmeans_labels(df.select("row", "col", *(F.col("v")[i].alias(f"x{i}") for i in range(3))), ["x0", "x1", "x2"], 3).withColumnRenamed("label", "cluster")
    met = found.join(df, ["row", "col"]).groupBy("cluster", "label").count().collect()
    assert {r.cluster for r in met} == {1, 2, 3}
    assert sum(max(r["count"] for r in met if r.cluster == c) for c in (1, 2, 3)) > 0.95 * 360


def test_clustering_reads_its_input_once(spark):
    """Whatever a vector costs to make, scaling, clustering and labelling work on what was stored."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = blobs(spark).select("row", "col", *(F.col("v")[i].alias(f"x{i}") for i in range(3)))
    assert learn.kmeans_labels(df.mapInArrow(count, df.schema), ["x0", "x1", "x2"], 3).count() == 360 and made.value == 360


def scene(height=40, width=128):
    """Two halves, one saturated pixel, a pixel with a gap in one band, an infinite one, and missing pixels."""
    rng = np.random.default_rng(7)
    a = np.where(np.arange(width) < width // 2, 0.2, 0.6)[None, None] + rng.normal(0, 0.02, (6, height, width))
    a[:, 20, 10] = 1e6
    a[2, 5, 5], a[3, 30, 100] = np.nan, np.inf
    a[:, 8:11, 40:44] = a[:, 0, 0] = a[:, height - 1, 90] = np.nan
    return a


def as_pixels(spark, a):
    here = [(r, c, *(None if np.isnan(v) else float(v) for v in a[:, r, c])) for r in range(a.shape[1]) for c in range(a.shape[2]) if not np.isnan(a[:, r, c]).all()]
    return spark.createDataFrame([*here, (None, 3, *[0.5] * 6)], "row long, col long, " + ", ".join(f"{b} double" for b in views.BANDS))


def test_segment_features_equal_plain_ones(spark):
    a = scene()
    valid = np.isfinite(a).all(axis=0)
    filled = np.where(np.isnan(a), 0, a)
    bands = []
    for band in filled:
        low, high = np.percentile(band[valid], [2, 98])
        bands.append(np.clip((np.where(valid, band, 0) - low) / (high - low), 0, 1))
    edge = np.hypot(*np.gradient(np.mean(bands, axis=0)))
    rows, cols = np.indices(valid.shape)
    want = np.stack([*bands, rows / 39 * 0.15, cols / 127 * 0.15, edge / edge[valid].max()])
    got = learn.segment_features(as_pixels(spark, a), list(views.BANDS), 40, 128).collect()
    assert {(r.row, r.col) for r in got} == set(zip(*np.nonzero(valid), strict=True))
    for r in got:
        np.testing.assert_allclose([r[b] for b in (*views.BANDS, "y", "x", "edge")], want[:, r.row, r.col], atol=1e-12)


def test_a_saturated_pixel_is_no_segment(spark, monkeypatch):
    """Without the cut at the percentiles one extreme value moves all others together, and is a label of its own."""
    a = scene()
    a[np.isinf(a)] = np.nan
    monkeypatch.setattr(views, "grid_bands", lambda s, d: as_pixels(spark, a))
    monkeypatch.setattr(views, "scene_height", lambda s, d: 40, raising=False)
    monkeypatch.setattr(views, "dem", lambda s, d: spark.range(40 * 128).selectExpr("id div 128 as row", "id % 128 as col", "1D as z"))
    found = registry.queries()["segment_spectral_spatial"](spark, "").collect()
    count = {}
    for r in found:
        count[r.label] = count.get(r.label, 0) + 1
    label = {(r.row, r.col): r.label for r in found}
    assert len(found) == 40 * 128 - 16 and min(n for x, n in count.items() if x) > 20
    assert not {label[r, c] for r in range(12, 28) for c in range(20, 40)} & {label[r, c] for r in range(12, 28) for c in range(80, 110)}


def test_segments_of_nothing(spark):
    empty = as_pixels(spark, scene()[:, :1, :1])
    assert learn.spectral_spatial(empty, list(views.BANDS), 1, 1, 5).count() == 0


def test_nothing_to_learn_from(spark):
    df = blobs(spark, 30)
    odd = df.unionByName(spark.createDataFrame([(99, 9, 9, None, None), (98, 9, 8, 1, [None, 1.0, 2.0])], df.schema))
    assert learn.kernel_svm(odd, "v", "label").count() == 30
    assert learn.random_forest(df.limit(0), df, "v", "label").count() == 0 and learn.kernel_svm(df.limit(0), "v", "label").count() == 0
