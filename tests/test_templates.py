"""Ready-made raster jobs against numpy, on rasters with masked pixels and over block borders."""

import datetime
import math

import numpy as np
import pytest

from orbweave.operators import stats, templates as M, timeseries


def frame(spark, a, kind="double"):
    rows = [(i, j, None if np.isnan(v) else float(v)) for i, line in enumerate(a) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, f"row long, col long, value {kind}")


def grid(df):
    return {(r.row, r.col): r.value for r in df.collect()}


@pytest.mark.parametrize("shape,block", [((23, 31), 16), ((5, 3), 16), ((40, 9), 256)])
def test_smoothing_equals_a_mirrored_convolution(spark, shape, block):
    rng = np.random.default_rng(7)
    a = rng.normal(50, 20, shape)
    a[rng.random(shape) < 0.1] = np.nan
    line, filled = M.gaussian_line(2.0, 8), np.nan_to_num(a)
    padded = np.pad(filled, 8, "symmetric")
    want = sum(x * y * padded[i : i + shape[0], j : j + shape[1]] for i, x in enumerate(line) for j, y in enumerate(line))
    got = grid(M.smoothed(frame(spark, a), *shape, block=block))
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(~np.isnan(a)), strict=True)}
    assert all(math.isclose(v, want[k], rel_tol=1e-9) for k, v in got.items())


def test_index_masks_what_either_raster_masks(spark):
    red, nir = np.array([[1.0, np.nan, 0.0, 2.0]]), np.array([[3.0, 4.0, 0.0, np.nan]])
    got = grid(M.vegetation_raster(frame(spark, red), frame(spark, nir)))
    assert got == {(0, 0): 0.5, (0, 2): 0.0}
    assert tuple(M.raster_report(M.vegetation_raster(frame(spark, red), frame(spark, nir))).first()) == (2, 0.0, 0.5)
    assert tuple(M.raster_report(frame(spark, red).limit(0)).first()) == (0, None, None)


def test_zeros_are_background_only_where_nothing_is_masked(spark):
    rows = [(0, 0, 1, 0.0), (0, 1, 1, 2.0), (0, 2, 1, 4.0), (0, 0, 2, 5.0)]
    read = lambda rows, **o: {r.band: tuple(r)[1:] for r in M.band_report(spark.createDataFrame(rows, "row long, col long, band int, value double"), **o).collect()}
    assert read(rows) == {1: (2, 2.0, 4.0, 3.0, 1.0), 2: (1, 5.0, 5.0, 5.0, 0.0)}
    assert read([*rows, (0, 1, 2, None)])[1][:2] == (3, 0.0)
    assert read(rows, nodata=4.0)[1] == (2, 0.0, 2.0, 1.0, 1.0)
    assert read(rows[:1]) == {}


def test_binary_splits_two_heaps_and_leaves_masked_pixels(spark):
    a = np.array([[10.0, 11, 12, 13], [90, 91, 92, np.nan]])
    got = grid(M.binary(frame(spark, a)))
    assert {k for k, v in got.items() if v == 255} == {(1, 0), (1, 1), (1, 2)} and len(got) == 7
    assert set(grid(M.binary(frame(spark, np.full((2, 2), 3.0)))).values()) == {0}
    assert grid(M.binary(frame(spark, a).limit(0))) == {}


def test_quantiles_of_bands_at_once(spark):
    rng = np.random.default_rng(4)
    bands = {1: rng.normal(size=3000), 2: np.repeat([2.0, 7.0], [10, 990]), 3: np.array([5.0]), 4: np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]), 5: np.concatenate((rng.random(500), [-1.7e308, 1.7e308]))}
    rows = [(b, float(x)) for b, v in bands.items() for x in v] + [(6, None), (6, float("nan"))]
    shares = [0.02, 0.25, 0.5, 0.98]
    for small in (1 << 14, 1):
        got = stats.band_quantiles(spark.createDataFrame(rows, "band int, value double").repartition(4), shares, 16, small)
        assert set(got) == set(bands)
        for b in (1, 2, 3, 5):
            assert got[b] == pytest.approx(np.quantile(bands[b], shares).tolist(), rel=1e-9)
        assert got[4][1:3] == [1.0, 2.0]


def test_savgol_of_any_length_equals_fits(spark):
    rng = np.random.default_rng(5)
    for window in (5, 6, 7):
        series = {n: rng.normal(size=n).tolist() for n in (1, 2, 3, 4, 5, 6, 7, 8, 12)}
        rows = [(n, 0, datetime.date(2024, 1, 1 + i), v) for n, line in series.items() for i, v in enumerate(line)]
        got = {}
        for r in timeseries.savgol(spark.createDataFrame(rows, "row long, col long, day date, value double"), window).orderBy("day").collect():
            got.setdefault(r.row, []).append(r.value)
        assert set(got) == {n for n in series if n >= 3}
        for n, line in got.items():
            w = min(window + (window % 2 == 0), n - (n % 2 == 0))
            for i, v in enumerate(line):
                first = min(max(i - w // 2, 0), n - w)
                x = np.arange(first, first + w)
                assert v == pytest.approx(np.polyval(np.polyfit(x - i, series[n][first : first + w], min(2, w - 1)), 0), abs=1e-9)
