"""Numeric anchors on tiny grids."""

import pytest
from pyspark.sql import functions as F

from orbweave.operators import algebra, catalog, change, focal, gridgraph, learn, stats, timeseries, transforms, vector
from orbweave.plans import registry


def grid(spark, lines, name="z"):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, line in enumerate(lines) for j, v in enumerate(line)], f"row long, col long, {name} double")


def as_grid(df, name):
    return {(r["row"], r["col"]): r[name] for r in df.collect()}


def test_ndvi_and_degenerate_indices(spark):
    df = spark.createDataFrame([(0.2, 0.6), (0.4, 0.2), (0.0, 0.0), (float("nan"), 1.0), (float("inf"), float("inf"))], "red double, nir double")
    got = [r[0] for r in df.select(algebra.ndvi(F.col("red"), F.col("nir"))).collect()]
    assert got == [pytest.approx(0.5), pytest.approx(-1 / 3), 0.0, 0.0, 0.0]


def test_calculator_repeats_one_band_operands(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 2.0, 10.0)], "row long, col long, a double, b double, c double")
    out = algebra.calculator(df, "A + B_1", {"A": ["a", "b"], "B": ["c"]}).first()
    assert (out.r1, out.r2) == (11.0, 12.0)
    with pytest.raises(ValueError):
        algebra.calculator(df, "E + A", {"A": ["a"]})


def test_series_anchors(spark):
    days = [f"2024-01-0{i}" for i in range(1, 6)]
    s = lambda v: spark.createDataFrame([(0, 0, d, x) for d, x in zip(days, v)], "row long, col long, day string, value double").withColumn("day", F.to_date("day"))
    assert [r.value for r in timeseries.moving_window(s([1.0, 3.0, 5.0]), 3).orderBy("day").collect()] == [2, 3, 4]
    t = timeseries.trend(s([1.0, 3.0, 5.0])).first()
    assert (t.slope, t.intercept, t.r2) == (pytest.approx(2), pytest.approx(1), pytest.approx(1))
    e = timeseries.seasonality(s([1.0, 2.0, 5.0, 3.0, 1.0])).first()
    assert (e["mean"], e.amplitude, e.peak, e.trough) == (pytest.approx(2.4), 4, 3, 1)
    p = timeseries.phenology(s([1.0, 2.0, 5.0, 3.0, 1.0])).first()
    assert (p.peak, p.amplitude) == (3, 4)
    assert [r.value for r in timeseries.gap_fill(s([1.0, None, 3.0])).orderBy("day").collect()] == [1, 2, 3]
    assert [round(r.value, 6) for r in timeseries.savgol(s([1.0, 2.0, 3.0, 4.0, 5.0])).orderBy("day").collect()] == [1, 2, 3, 4, 5]


def test_slope_and_aspect_of_an_east_rising_plane(spark):
    g = focal.gradient(grid(spark, [[c for c in range(5)] for _ in range(5)]), "z", 5, 5)
    out = g.select("row", "col", focal.slope(g).alias("s"), focal.aspect(g).alias("a")).filter("row = 2 and col = 2").first()
    assert (out.s, out.a) == (pytest.approx(45), pytest.approx(270))


def test_flow_into_a_sink(spark):
    flow = gridgraph.d8_flow(grid(spark, [[5, 4, 5], [4, 0, 4], [5, 4, 5]]))
    assert as_grid(flow, "code") == {(0, 0): 2, (0, 1): 4, (0, 2): 8, (1, 0): 1, (1, 1): 0, (1, 2): 16, (2, 0): 128, (2, 1): 64, (2, 2): 32}
    assert as_grid(gridgraph.flow_accumulation(flow), "accumulation")[1, 1] == 9
    assert {r.basin for r in gridgraph.watershed(flow).collect()} == {1}


def test_components_holes_and_small_ones(spark):
    mask = grid(spark, [[1, 1, 1, 0, 1], [1, 0, 1, 0, 0], [1, 1, 1, 0, 1]], "m").select("row", "col", F.col("m").cast("int").alias("mask"))
    c = gridgraph.components(mask.filter("mask = 1").select("row", "col"))
    assert c.select("label_row", "label_col").distinct().count() == 3
    assert as_grid(gridgraph.fill_holes(mask, 3, 5), "mask")[1, 1] == 1
    small = as_grid(gridgraph.remove_small(mask, 2), "mask")
    assert small[0, 4] == 0 and small[0, 0] == 1


def test_transforms(spark):
    h = transforms.haar(grid(spark, [[7] * 4] * 4), "z").collect()
    assert all((r.ll, r.lh, r.hl, r.hh) == (7, 0, 0, 0) for r in h)
    delta = [[1 if (i, j) == (1, 2) else 0 for j in range(4)] for i in range(4)]
    assert all(r.value == pytest.approx(0.693147, abs=1e-5) for r in transforms.fourier(grid(spark, delta), "z", 4, 4).collect())
    df = spark.createDataFrame([(0, i, float(x), 2.0 * x, -float(x)) for i, x in enumerate([1, 2, 3, 5])], "row long, col long, a double, b double, c double")
    assert transforms.pca(df, ["a", "b", "c"], 2)[1].tolist() == [pytest.approx(1), pytest.approx(0, abs=1e-12)]


def test_change_and_merge(spark):
    one, three = grid(spark, [[1, 1], [1, 1]], "b"), grid(spark, [[3, 3], [3, None]], "b")
    d = change.band_diff(one, three, "b", 1.0).filter("diff is not null")
    assert d.count() == 3 and d.filter("mask = 1 and diff = 2").count() == 3
    long = lambda g: g.select("row", "col", F.lit(1).alias("band"), F.col("b").alias("value"))
    assert change.merge([(long(one), 1), (long(three), 1)]).count() == 6


def test_names_dates_and_vectors(spark):
    df = spark.createDataFrame([(1, "S2A_MSIL2A_20240618T032141_N0510_R018_T49QGE_20240618T071212.tif", None, None), (2, "arbitrary.tif", None, None), (3, "x.tif", "2024-07-03", None)], "scene_id long, file_name string, tag_date string, stac string")
    rows = {r.scene_id: r for r in catalog.metadata(df).collect()}
    assert (str(rows[1].acquired_at), rows[1].source, rows[1].tile_id) == ("2024-06-18 03:21:41", "sentinel_filename", "T49QGE")
    assert (rows[2].source, rows[2].confidence, rows[3].source) == ("unknown", 0.0, "raster_tag")
    ring = vector.l_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(4))
    p = spark.createDataFrame([(3.0, 1.0), (1.0, 1.0), (3.0, 3.0)], "x double, y double")
    assert [r[0] for r in p.select(vector.point_in_ring(F.col("x"), F.col("y"), ring)).collect()] == [False, True, True]
    assert vector.split_view(170, 0, 200, 1) == [(170, 0, 180.0, 1), (-180.0, 0, -160, 1)]
    k = spark.createDataFrame([(0, 0.0, 1), (1, 10.0, 2)], "id long, v double, label int")
    assert {r.id: r.predicted for r in learn.nearest_centroid(k, k, "id", ["v"], "label").collect()} == {0: 1, 1: 2}
    assert stats.histogram(grid(spark, [[0, 1, 2, 4]]), "z", 4).orderBy("bin").first()["count"] == 1


def test_registered_queries_are_complete():
    assert len(registry.queries()) > 150
    assert set(registry.oracle_sql()) <= set(registry.queries())
