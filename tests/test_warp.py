"""Projections at known places, kernels against plain loops, control points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import warp as W


def test_utm_anchors_and_round_trips(spark):
    # On the central meridian the northing is 0.9996 of the meridian arc: 4429529.03 m to 40 degrees.
    rows = [("EPSG:32618", -75.0, 40.0, 500000.0, 4427757.22), ("EPSG:32631", 3.0, 0.0, 500000.0, 0.0), ("EPSG:32718", -75.0, -40.0, 500000.0, 10000000 - 4427757.22), ("EPSG:32617", -79.387139, 43.642567, 630084, 4833439)]
    for crs, lon, lat, east, north in rows:
        got = spark.range(1).select(*W.to_crs(crs, F.lit(lon), F.lit(lat))).first()
        assert (got[0], got[1]) == (pytest.approx(east, abs=2), pytest.approx(north, abs=2))
    for zone in (1, 17, 32, 60):
        for hemisphere in (32600, 32700):
            crs, center = f"EPSG:{hemisphere + zone}", zone * 6 - 183
            df = spark.range(41 * 17).select((center + (F.col("id") % 41 - 20) * 0.2).alias("lon"), ((F.floor(F.col("id") / 41)) * (5.0 if hemisphere == 32600 else -5.0)).alias("lat"))
            lon, lat = W.from_crs(crs, *W.to_crs(crs, F.col("lon"), F.col("lat")))
            off = df.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
            assert max(off) < 1e-8
    with pytest.raises(ValueError):
        W.to_crs("EPSG:32661", F.lit(0.0), F.lit(0.0))


def plain(source, fr, fc, method, scale):
    """One place among a dict of valid pixels."""
    near = source.get((math.floor(fr), math.floor(fc)))
    if near is None or method == "nearest":
        return near
    radius, kernel = W.KERNELS[method]
    total = weight = 0.0
    for (r, c), v in source.items():
        w = float(kernel(np.array([(r + 0.5 - fr) / scale[0]]))[0] * kernel(np.array([(c + 0.5 - fc) / scale[1]]))[0])
        total, weight = total + w * v, weight + w
    return total / weight if weight > 1e-6 else near


@pytest.mark.parametrize("method", list(W.KERNELS))
def test_kernels_on_masked_blocks(spark, method):
    rng = random.Random(1)
    source = {(r, c): rng.uniform(-5, 5) for r in range(13) for c in range(17) if rng.random() > 0.3}
    rows = [(r, c, v, 0) for (r, c), v in source.items()] + [(3, 40, None, 0), (4, 41, float("nan"), 0)]
    pixels = spark.createDataFrame(rows, "row long, col long, v double, br int")
    places = [(i, 0, rng.uniform(0, 13), rng.uniform(0, 17)) for i in range(120)]
    df = spark.createDataFrame([*places, (500, 0, None, 1.0), (501, 0, float("nan"), 1.0)], "row long, col long, fr double, fc double")
    for scale in ((1.0, 1.0), (2.0, 1.4)):
        got = {r.row: r.value for r in W.sample(df, pixels, "v", method, scale, block=7).collect()}
        want = {i: v for i, _, fr, fc in places if (v := plain(source, fr, fc, method, scale)) is not None}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    assert W.sample(df, pixels.limit(0), "v", method).count() == 0 and W.sample(df.limit(0), pixels, "v", method).count() == 0


def test_there_and_back_within_half_a_pixel(spark):
    """A smooth field from degrees to metres and back is the field again; the mask travels along."""
    source = W.Grid("EPSG:4326", 8.6, 47.2, 0.01, 0.01, 60, 50)
    field = lambda r, c: 3.0 * r + 2.0 * c
    pixels = spark.createDataFrame([(r, c, field(r, c)) for r in range(50) for c in range(60) if not (20 <= r < 25 and 30 <= c < 40)], "row long, col long, v double")
    utm = W.target_grid(spark, source, "EPSG:32632")
    there = W.reproject(pixels, "v", source, utm, "bilinear", block=16)
    back = {(r.row, r.col): r.value for r in W.reproject(there, "value", utm, source, "bilinear").collect()}
    off = [abs(v - field(*at)) for at, v in back.items() if 3 <= at[0] < 47 and 3 <= at[1] < 57]
    assert max(off) < 0.5 * 5 and sum(off) / len(off) < 0.2
    assert not any((22, c) in back for c in range(32, 38)) and len(back) > 0.9 * 2950
    near = {(r.row, r.col): r.value for r in W.reproject(W.reproject(pixels, "v", source, utm), "value", utm, source).collect()}
    assert all(abs(v - field(*at)) <= 5 + 1e-9 for at, v in near.items())


def test_resample_sizes_units_and_methods(spark):
    source = W.Grid("EPSG:4326", 10.0, 1.0, 0.1, 0.1, 7, 5)
    pixels = spark.createDataFrame([(r, c, float(r * 7 + c)) for r in range(5) for c in range(7)], "row long, col long, v double")
    coarse, grid = W.resample(pixels, "v", source, (0.3, 0.2), method="average")
    assert (grid.width, grid.height) == (3, 3) and {(r.row, r.col): r.value for r in coarse.collect()}[0, 0] == pytest.approx(np.mean([0, 1, 2, 7, 8, 9]))
    fine, grid = W.resample(pixels, "v", source, (0.05, 0.05), method="nearest")
    assert (grid.width, grid.height, fine.count()) == (14, 10, 140)
    assert W.unit_crs(spark, source, "metres") == "EPSG:32632" and W.unit_crs(spark, W.Grid("EPSG:3857", 0, 0, 1, 1, 2, 2), "metres") == "EPSG:3857"
    metres, grid = W.resample(pixels, "v", source, (5000.0, 5000.0), "metres")
    assert grid.crs == "EPSG:32632" and abs(grid.width - 78 / 5) < 2 and metres.count() > 0
    for wrong in (lambda: W.resample(pixels, "v", source, (0.0, 1.0)), lambda: W.resample(pixels, "v", source, (1.0, 1.0), "feet"), lambda: W.resample(pixels, "v", source, (1.0, 1.0), "source", "magic")):
        with pytest.raises(ValueError):
            wrong()


def test_control_points(spark):
    rng = random.Random(2)
    true = (30.0, 0.5, 100.0, 0.25, -30.0, 5000.0)
    at = lambda r, c: (true[0] * c + true[1] * r + true[2], true[3] * c + true[4] * r + true[5])
    places = [(rng.uniform(0, 99), rng.uniform(0, 99)) for _ in range(6)]
    rows = [(1, r, c, *at(r, c)) for r, c in places] + [(2, r, c, *at(r, c)) for r, c in places[:2]] + [(3, float(i), 2.0 * i, 1.0, 1.0) for i in range(5)] + [(4, 1.0, 1.0, None, 1.0)] + [(None, r, c, *at(r, c)) for r, c in places]
    points = spark.createDataFrame(rows, "scene long, row double, col double, x double, y double")
    fits = W.fit_control_points(points, "scene")
    got = {r.scene: r for r in fits.collect()}
    assert [got[1][c] for c in ("ax", "bx", "cx", "ay", "by", "cy")] == [pytest.approx(v, abs=1e-8) for v in true]
    assert (got[2].error, got[3].error, got[1].error) == ("fewer than three points", "points on one line", None) and got[3].ax is None and 4 not in got
    assert [(r.scene, round(r.rms, 8)) for r in W.residuals(points, fits, "scene").collect()] == [(1, 0.0)]
    pixels = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(4) for c in range(5)], "row long, col long, v double")
    turned, grid = W.correct(pixels, "v", (0.0, 1.0, 0.0, 1.0, 0.0, 0.0), 4, 5, "EPSG:3857", "nearest")  # rows become eastings
    assert (grid.width, grid.height) == (4, 5) and {(r.row, r.col): r.value for r in turned.collect()}[0, 0] == 4.0
    with pytest.raises(ValueError):
        W.correct(pixels, "v", (1.0, 1.0, 0.0, 1.0, 1.0, 0.0), 4, 5, "EPSG:3857")


def test_tiles(spark):
    from orbweave.operators import tiles as T

    source = W.Grid("EPSG:3857", 0.0, T.EDGE, T.EDGE / 256, T.EDGE / 256, 256, 512)  # the eastern half of the world, two tiles of zoom 1
    rows = [(r, c, float(r % 2), float(c), 0.5) for r in range(512) for c in range(0, 256, 2)]
    df = spark.createDataFrame(rows, "row long, col long, mask double, dn double, index double")
    got = {(r.x, r.y): r for r in T.render(df, ["mask"], source, 1).collect()}
    assert got.keys() == {(1, 0), (1, 1)}
    image = np.frombuffer(got[1, 0].rgba, np.uint8).reshape(256, 256, 4)
    assert got[1, 0].opaque == 256 * 128 and set(image[..., 3].ravel().tolist()) == {0, 255} and not image[image[..., 3] == 0].any()
    assert set(image[1, ::2, 0].tolist()) == {255} and set(image[0, ::2, 0].tolist()) == {0} and (image[..., 0] == image[..., 2]).all()
    stretched = np.frombuffer(T.render(df, ["dn", "mask", "index"], source, 1).filter("y = 0").first().rgba, np.uint8).reshape(256, 256, 4)
    low, high = np.quantile([float(c) for c in range(0, 256, 2)] * 512, [0.02, 0.98])
    assert stretched[0, 100, 0] == int((100 - low) / (high - low) * 255) and stretched[0, 0, 0] == 0 and stretched[0, 254, 0] == 255
    index = np.frombuffer(T.render(df, ["index"], source, 1).first().rgba, np.uint8).reshape(256, 256, 4)
    assert index[0, 0, 0] == int(0.75 * 255)
    assert T.render(df.limit(0), ["dn"], source, 1).count() == 0
    with pytest.raises(ValueError):
        T.render(df, [], source, 1)


def test_grids_that_run_on_beyond_a_pole(spark):
    grid = W.Grid("EPSG:4326", 8.4, 52.0, 0.01, 0.01, 128, 70313)
    left, bottom, right, top = W.bounds_in(spark, grid, "EPSG:3857")
    edge = math.pi * W.A
    assert bottom == pytest.approx(-edge, rel=1e-9) and top == pytest.approx(W.A * math.asinh(math.tan(math.radians(52))), rel=1e-9) and (left, right) == (pytest.approx(math.radians(8.4) * W.A), pytest.approx(math.radians(9.68) * W.A))
    assert W.unit_crs(spark, grid, "metres") == "EPSG:32632"  # its middle, 299.6 south, is 60.4 north
