"""Blocks with halos, rings, and records on tiny inputs with missing values, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import algebra, records, shapes, texture

from .test_operators import as_grid, grid


def test_blocks_equal_whole_arrays(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 9, (23, 17)).astype(float)
    lines = [[None if (i * 17 + j) % 29 == 0 else v for j, v in enumerate(line)] for i, line in enumerate(a.tolist())]
    df = grid(spark, lines)
    whole = np.array([[np.nan if v is None else v for v in line] for line in lines])
    got = as_grid(texture.on_blocks(df, "z", 2, lambda x: x[2:-2, 2:-2] * 0 + np.nansum(np.lib.stride_tricks.sliding_window_view(x, (5, 5)), axis=(2, 3)), 23, 17, "edge", 8), "value")
    padded = np.pad(whole, 2, mode="edge")
    for (i, j), v in got.items():
        assert v == pytest.approx(np.nansum(padded[i : i + 5, j : j + 5]))
    assert len(got) == int((~np.isnan(whole)).sum())
    assert texture.on_blocks(df.limit(0), "z", 2, lambda x: x, 23, 17).count() == 0


def test_lbp_of_a_peak_and_of_ties(spark):
    flat = as_grid(texture.lbp(grid(spark, [[1] * 3] * 3), "z", 3, 3, 1.0, 8), "code")
    assert set(flat.values()) == {255}
    peak = as_grid(texture.lbp(grid(spark, [[0, 0, 0], [0, 5, 0], [0, 0, 0]]), "z", 3, 3, 1.0, 4), "code")
    assert peak[1, 1] == 0 and peak[0, 0] == 15
    hole = as_grid(texture.lbp(grid(spark, [[0, None, 0], [0, 5, 0], [0, 0, 0]]), "z", 3, 3, 1.0, 4), "code")
    assert hole[1, 1] is None and (0, 1) not in hole


def test_label_median_and_gabor_kernels(spark):
    got = as_grid(texture.median_labels(grid(spark, [[1, 1, 1], [1, 3, 1], [1, 1, None]]), "z", 3, 3), "label")
    assert got[1, 1] == 1 and (2, 2) not in got
    real, imaginary = texture.gabor_kernels(0.2, 30.0, 1.0)
    assert real.shape == (7, 7) and abs(real.sum()) < 1e-12 and np.abs(imaginary).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        texture.gabor_kernels(0, 0, 1)


def plain_clip(points, box):
    """A closed ring cut by a box point by point, the other way to shapes.clip_ring's result."""
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(points, points[1:]):
            ins = [(p[axis] - limit) * sign >= 0 for p in (a, b)]
            if ins[0] != ins[1]:
                at = a[1 - axis] + (b[1 - axis] - a[1 - axis]) * (limit - a[axis]) / (b[axis] - a[axis])
                out.append((limit, at) if axis == 0 else (at, limit))
            if ins[1]:
                out.append(b)
        points = [out[-1], *out] if out else []
    return points


def test_boxes_cut_rings_of_every_size(spark):
    """Stars from a thousandth of a unit to a continent, by boxes of as many sizes, against the plain way."""
    rng = np.random.default_rng(8)
    zones, boxes = {}, {}
    for i in range(60):
        size, x, y = float(10.0 ** rng.uniform(-3, 2)), *rng.uniform(-100, 100, 2).tolist()
        turn = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 12))))
        reach = size * rng.uniform(0.2, 1, len(turn))
        points = list(zip((x + reach * np.cos(turn)).tolist(), (y + reach * np.sin(turn)).tolist()))
        zones[i] = [*points, points[0]]
        w, h = (10.0 ** rng.uniform(-3, 2, 2)).tolist()
        middle = points[0] if i % 2 else (x, y)
        boxes[i] = (middle[0] - w / 2, middle[1] - h / 3, middle[0] + w / 2, middle[1] + h)
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    want = {(i, j): plain_clip(z, b) for i, z in zones.items() for j, b in boxes.items()}
    want = {k: v for k, v in want.items() if area(v) > 1e-10}
    rows = [(i, [{"x": x, "y": y} for x, y in z]) for i, z in zones.items()] + [(None, [{"x": 0.0, "y": 0.0}]), (98, None), (99, [])]
    got = shapes.clip_zones(
        spark.createDataFrame(rows, f"zone_id long, ring {shapes.RING}"),
        spark.createDataFrame([(j, *b) for j, b in boxes.items()] + [(99, None, 0.0, 1.0, 1.0), (98, 3.0, 3.0, 2.0, 2.0)], "box_id long, x0 double, y0 double, x1 double, y1 double"),
    ).collect()
    assert len(got) == len(want) and {(r.zone_id, r.box_id) for r in got} == set(want)
    for r in got:
        ring = want[r.zone_id, r.box_id]
        assert np.allclose([(p.x, p.y) for p in r.ring], ring, rtol=1e-12)
        assert r.area == pytest.approx(area(ring), rel=1e-6, abs=1e-9)


def test_copies_of_zones_are_cut_once(spark, monkeypatch):
    kinds, plain = [], shapes.spread
    monkeypatch.setattr(shapes, "spread", lambda df, *by: kinds.append(df.count()) or plain(df, *by))
    zones = spark.createDataFrame([(i, [{"x": x + 20.0 * (i % 4), "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))]) for i in range(20)], f"zone_id long, ring {shapes.RING}")
    boxes = spark.createDataFrame([(i, 20.0 * (i % 4) + 1, 1.0, 20.0 * (i % 4) + 9, 9.0) for i in range(20)], "box_id long, x0 double, y0 double, x1 double, y1 double")
    found = shapes.clip_zones(zones, boxes).collect()
    assert kinds[0] == 1 and sorted((r.zone_id, r.box_id) for r in found) == [(i, j) for i in range(20) for j in range(20) if i % 4 == j % 4]
    assert all(r.area == 9 and {p.x for p in r.ring} == {20.0 * (r.zone_id % 4) + 1, 20.0 * (r.zone_id % 4) + 4} for r in found)
    assert shapes.clip_zones(zones, boxes, whole=True).count() == 0
    assert shapes.clip_zones(zones, boxes.selectExpr("box_id", "x0 - 1 as x0", "y0 - 1 as y0", "x1", "y1"), whole=True).count() == 100


def test_rings(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))), (2, ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))), (3, ring((0, 0), (1, 0), (1, 1))), (4, [])]
    df = spark.createDataFrame(rows + [(5, None)], f"zone_id long, ring {shapes.RING}")
    assert {r.zone_id: r.v for r in df.select("zone_id", shapes.ring_is_valid(F.col("ring")).alias("v")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert plain_clip([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], (2, -1, 9, 9)) and not plain_clip([(0, 0), (1, 0), (1, 1), (0, 0)], (5, 5, 6, 6))
    boxes = spark.createDataFrame([(7, 2.0, -1.0, 40.0, 40.0), (8, 5.0, 5.0, 6.0, 6.0)], "box_id long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.zone_id, r.box_id, r.area) for r in shapes.clip_zones(df.filter("zone_id = 1"), boxes).collect()] == [(1, 7, 8.0)]
    thin = shapes.simplified(spark.createDataFrame([(1, ring((0, 0), (1, 0.001), (2, 0), (2, 2)))], f"k long, path {shapes.RING}"), "k", "path", 0.01).first()
    assert [(p.x, p.y) for p in thin.path] == [(0, 0), (2, 0), (2, 2)]
    cut = shapes.split_antimeridian(spark.createDataFrame([(1, 0, 170.0, 0.0), (1, 1, -170.0, 10.0)], "k long, i long, lon double, lat double"), "k").orderBy("part").collect()
    assert [(r.lon0, r.lat0, r.lon1, r.lat1) for r in cut] == [(170, 0, 180, 5), (-180, 5, -170, 10)]


def test_records(spark):
    assert records.short_names(["population total", "Population-Totals", "é"]) == {"population total": "POPULATION", "Population-Totals": "POPULATIO2", "é": "FIELD"}
    text = spark.createDataFrame([('A_B = "x"\nskip\nA_B = y z \nC=1', 'say "hi", you', '{"a":"1"}', None), (None, None, None, None)], "t string, c string, o string, n string")
    r = text.select(records.key_values(F.col("t")).alias("m"), records.csv_cell(F.col("c")).alias("c"), records.merged_properties(F.col("o"), F.col("n")).alias("p"), records.infer_type(F.lit("-1.5e3")).alias("k")).collect()
    assert (r[0].m, r[0].c, r[0].p, r[0].k) == ({"AB": "y z", "C": "1"}, '"say ""hi"", you"', {"a": "1"}, "number")
    assert (r[1].m, r[1].c, r[1].p) == (None, "", {})
    sensors = {x: (s, f) for x, s, f in spark.createDataFrame([("LC09_L2SP_x",), ("MOD09GA",), (None,), ("plain",)], "t string").select("t", *records.product(F.col("t"))).collect()}
    assert sensors["LC09_L2SP_x"] == ("landsat", True) and sensors["plain"] == ("generic", False) and sensors[None][0] == "generic"
    bands = algebra.valid_bands(spark.createDataFrame([(0.0, 1), (0.5, 1), (0.7, 1), (0.7, 0), (float("nan"), 1)], "b double, m int"), ["b"], F.col("m") == 1, 0.5, True)
    assert [x.b for x in bands.collect()] == [None, None, 0.7, None, None]
