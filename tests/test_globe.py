"""Rings on the globe: reflection, great circles, the antimeridian, the poles."""

import math

import pytest
from pyspark.sql import functions as F

from orbweave.operators import globe


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, rings array<array<struct<x:double,y:double>>>")


def planar(r):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:])) / 2


def test_positions_beyond_a_pole(spark):
    df = spark.createDataFrame([(10.0, 100.0), (10.0, -100.0), (190.0, 5.0), (-540.0, 0.0), (0.0, 270.0), (0.0, 90.0)], "x double, y double")
    got = [(round(r[0], 9), round(r[1], 9)) for r in df.select(*globe.normal_position(F.col("x"), F.col("y"))).collect()]
    assert got == [(-170.0, 80.0), (-170.0, -80.0), (-170.0, 5.0), (-180.0, 0.0), (0.0, -90.0), (0.0, 90.0)]


def test_great_circles(spark):
    df = spark.createDataFrame([(0.0, 0.0, 40.0, 0.0), (0.0, 60.0, 180.0, 60.0), (0.0, 0.0, 180.0, 0.0), (5.0, 5.0, 5.0, 5.0), (-100.0, 50.0, 20.0, 40.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(globe.great_circle(*(F.col(c) for c in "abcd"))).collect()]
    assert [len(g) for g in got] == [8, 12, 36, 1, math.ceil(79.7 / 5)]
    assert [p["x"] for p in got[0]] == [pytest.approx(5 * i) for i in range(8)] and all(abs(p["y"]) < 1e-9 for p in got[0])
    assert max(p["y"] for p in got[1]) == pytest.approx(90) and max(p["y"] for p in got[2]) == pytest.approx(90)
    unit = lambda p: (math.cos(math.radians(p["y"])) * math.cos(math.radians(p["x"])), math.cos(math.radians(p["y"])) * math.sin(math.radians(p["x"])), math.sin(math.radians(p["y"])))
    normal = [unit({"x": -100.0, "y": 50.0}), unit({"x": 20.0, "y": 40.0})]
    cross = [normal[0][(i + 1) % 3] * normal[1][(i + 2) % 3] - normal[0][(i + 2) % 3] * normal[1][(i + 1) % 3] for i in range(3)]
    assert all(abs(sum(a * b for a, b in zip(unit(p), cross))) < 1e-12 for p in got[4])


def test_polygons_across_the_antimeridian_and_around_poles(spark):
    rows = [
        (1, [ring((10, 0), (20, 0), (20, 10))]), (2, [ring((170, -10), (-170, -10), (-170, 10), (170, 10)), ring((175, -2), (-175, -2), (-175, 2), (175, 2))]),
        (3, [ring(*((x, 70) for x in range(-180, 180, 10)))]), (4, [ring(*((-x, -70) for x in range(-180, 180, 10)))]), (5, None), (6, [ring((0, 0), (1, 1))]), (7, [ring((100, 10), (190, 10), (190, 40), (100, 40))]),
    ]
    found = {}
    for r in globe.split_polygons(frame(spark, rows), "id").collect():
        found.setdefault(r.id, []).append(r)
        for k in r.rings:
            assert k[0] == k[-1] and all(-180 <= p["x"] <= 180 and -90 <= p["y"] <= 90 for p in k)
            assert all(abs(a["x"] - b["x"]) <= 10 + 1e-6 or abs(abs(a["y"]) - 90) < 1e-6 for a, b in zip(k, k[1:])) or r.id in (2, 7)
    assert found.keys() == {1, 2, 3, 4, 7}
    assert len(found[1]) == 1 and len(found[2]) == 2 and len(found[7]) == 2
    total = {i: sum(planar(k) for r in rs for k in r.rings) for i, rs in found.items()}
    assert total[2] == pytest.approx(400 - 40, rel=0.03)
    for pole in (3, 4):
        assert total[pole] == pytest.approx(360 * 20, rel=0.02)
        assert all(p["y"] > 69 if pole == 3 else p["y"] < -69 for r in found[pole] for k in r.rings for p in k)
    assert globe.split_polygons(frame(spark, rows).limit(0), "id").count() == 0


def test_angles_are_worked_out_once_a_side(spark):
    dense = globe.dense_rings(frame(spark, [(1, [ring((10, 0), (50, 0), (30, 15))])]), "id")
    assert dense._jdf.queryExecution().optimizedPlan().toString().lower().count("acos(") <= 2
    assert dense.count() == 8 + 2 * 5


def test_equal_polygons_are_worked_on_once_and_cut_only_across_the_antimeridian(spark, monkeypatch):
    seen = {}

    def counted(name, do):
        def run(df, *args):
            seen[name] = df.count()
            return do(df, *args)

        return run

    for name in ("dense_rings", "clip"):
        monkeypatch.setattr(globe, name, counted(name, getattr(globe, name)))
    across, inside, edge = [ring((170, 0), (-170, 0), (-175, 10))], [ring((10, 0), (20, 0), (20, 10))], [ring((170, 0), (180, 0), (175, 10))]
    rows = [(i, (across, inside, edge)[i % 3]) for i in range(30)]
    found = globe.split_polygons(frame(spark, [*rows, (0, inside)]), "id").collect()
    assert seen == {"dense_rings": 3, "clip": 1}
    many = {}
    for r in found:
        many.setdefault(r.id, []).append((r.world, r.parts, r.holes, min(p["x"] for k in r.rings for p in k), max(p["x"] for k in r.rings for p in k)))
    near = lambda got, want: sorted(got) == [pytest.approx(w) for w in want]
    assert near(many.pop(0), [(0, 1, 0, 10, 20), (0, 1, 0, 170, 180), (1, 1, 0, -180, -170)]) and len(many) == 29
    assert all(near(got, [[(0, 1, 0, 170, 180), (1, 1, 0, -180, -170)], [(0, 1, 0, 10, 20)], [(0, 1, 0, 170, 180)]][i % 3]) for i, got in many.items())
