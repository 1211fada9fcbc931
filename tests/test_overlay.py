"""Polygon intersections against even-odd tests of many points, and boxes against plain arithmetic."""

import math
import random

import pytest

from orbweave.operators import overlay

SCHEMA = "long, rings array<array<struct<x:double,y:double>>>"


def star(rng, cx, cy, r, n, holes=False):
    ring = lambda scale, turn: [(cx + scale * r * f * math.cos(turn * 2 * math.pi * i / n), cy + scale * r * f * math.sin(turn * 2 * math.pi * i / n)) for i, f in enumerate(factors)]
    factors = [rng.uniform(0.4, 1.0) for _ in range(n)]
    rings = [ring(1, 1)] + ([ring(0.4, rng.choice([1, -1]))] if holes else [])
    return [[{"x": x, "y": y} for x, y in [*r, r[0]]] for r in rings]


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for a, b in zip(ring, ring[1:]):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                n += 1
    return n % 2 == 1


def test_stars_with_holes_of_all_sizes(spark):
    rng = random.Random(6)
    a = [(i, star(rng, rng.uniform(0, 20), rng.uniform(0, 20), rng.choice([1.0, 3.0, 8.0]), rng.randint(5, 40), True)) for i in range(12)]
    b = [(i, star(rng, rng.uniform(0, 20), rng.uniform(0, 20), rng.choice([0.5, 4.0, 12.0]), rng.randint(5, 60), i % 2 == 0)) for i in range(8)]
    found = {(r.zone_id, r.clip_id): r for r in overlay.clip(spark.createDataFrame(a, "zone_id " + SCHEMA), spark.createDataFrame(b, "clip_id " + SCHEMA)).collect()}
    points = [(rng.uniform(-8, 28), rng.uniform(-8, 28)) for _ in range(6000)]
    for i, p in a:
        hit = [q for q in points if inside(*q, p)]
        for j, c in b:
            both = {q for q in hit if inside(*q, c)}
            r = found.get((i, j))
            assert r is not None or not both
            if r is not None:
                assert {q for q in hit if inside(*q, r.rings)} == both
                assert all(k[0] == k[-1] for k in r.rings) and r.parts >= 1 and len(r.rings) == r.parts + r.holes
                assert r.area == pytest.approx(sum(abs(s) * (1 if n < r.parts else -1) for n, s in enumerate(area(k) for k in r.rings)), rel=1e-9)


def area(ring):
    return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:])) / 2


def test_boxes_that_share_sides_and_corners(spark):
    frame = [box(0, 0, 10, 10), box(3, 3, 7, 7)]
    subjects = [(1, [box(0, 0, 10, 10)]), (2, [box(3, 3, 7, 7)]), (3, [box(5, 5, 12, 12)]), (4, [box(10, 0, 12, 5)]), (5, [box(1, 1, 2, 2)]), (6, [box(20, 20, 30, 30)]), (7, None), (8, []), (9, [box(0, 0, 1, 1)[:3]]), (10, [list(reversed(box(2, 2, 8, 8)))]), (11, [box(-5, 4, 15, 6)])]
    df = spark.createDataFrame(subjects, "zone_id " + SCHEMA)
    found = overlay.clip(df, spark.createDataFrame([(1, frame), (2, None)], "clip_id " + SCHEMA))
    got = {r.zone_id: (round(r.area, 5), r.parts, r.holes) for r in found.collect()}
    assert got == {1: (84.0, 1, 1), 3: (21.0, 1, 0), 5: (1.0, 1, 0), 10: (20.0, 1, 1), 11: (12.0, 2, 0)}
    assert tuple(overlay.clip_report(df, found).first()) == (11, 5, 6)
    assert overlay.clip(df.limit(0), spark.createDataFrame([(1, frame)], "clip_id " + SCHEMA)).count() == 0


def test_far_from_the_origin(spark):
    a = spark.createDataFrame([(1, [box(5e6, 4e6, 5e6 + 10, 4e6 + 10)])], "zone_id " + SCHEMA)
    b = spark.createDataFrame([(1, [box(5e6 + 2, 4e6 - 1e5, 5e6 + 4, 4e6 + 1e5)])], "clip_id " + SCHEMA)
    assert overlay.clip(a, b).first().area == pytest.approx(20, abs=1e-6)


def test_copies_are_cut_once_and_all_come_back(spark, monkeypatch):
    sizes, plain = {}, overlay.stored

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(overlay, "stored", counted)
    at = [(40 * (i % 5), 30 * (i % 3)) for i in range(30)]
    a = spark.createDataFrame([(i, [box(x, y, x + 10, y + 10)]) for i, (x, y) in enumerate(at)], "zone_id " + SCHEMA)
    b = spark.createDataFrame([(100 + i, [box(x + 5, y + 5, x + 15, y + 15)]) for i, (x, y) in enumerate(at)], "clip_id " + SCHEMA)
    found = overlay.clip(a, b).collect()
    assert sizes["pairs"] == 1  # all pairs are one shape and another, the same way apart
    assert sorted((r.zone_id, r.clip_id) for r in found) == [(i, 100 + j) for i in range(30) for j in range(30) if at[i] == at[j]]
    assert all(r.area == pytest.approx(25, abs=1e-6) and {(round(p["x"], 5), round(p["y"], 5)) for p in r.rings[0]} == {(at[r.zone_id][0] + u, at[r.zone_id][1] + v) for u in (5, 10) for v in (5, 10)} for r in found)


def test_full_cells_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(overlay, "CELL_ROWS", 3)
    rng = random.Random(9)
    sides = [(x := rng.uniform(0, 10), y := rng.uniform(0, 10), x + rng.uniform(0.1, 4), y + rng.uniform(0.1, 4)) for _ in range(60)]
    df = spark.createDataFrame([(i, *s, math.ceil(math.log2(max(s[2] - s[0], s[3] - s[1])))) for i, s in enumerate(sides)], "id long, x0 double, y0 double, x1 double, y1 double, level int")
    met = lambda s, t: s[0] < t[2] and t[0] < s[2] and s[1] < t[3] and t[1] < s[3]
    assert sorted((r.id, r.b_id) for r in overlay.candidates(df, df).collect()) == [(i, j) for i, s in enumerate(sides) for j, t in enumerate(sides) if met(s, t)]


def test_kept_subjects_without_pairs(spark):
    a = spark.createDataFrame([(1, [box(0, 0, 4, 4)]), (1, [box(0, 0, 4, 4)]), (2, [box(50, 50, 51, 51)]), (3, [box(1, 1, 2, 2)]), (4, None)], "zone_id " + SCHEMA)
    b = spark.createDataFrame([(i, [box(0, 0, 3, 3)]) for i in range(20)], "clip_id " + SCHEMA)
    left = overlay.kept(a, b)
    assert sorted(r[0] for r in left.collect()) == [1, 1, 3]
    assert tuple(overlay.clip_report(a, left).first()) == (5, 3, 2)


def test_uncut_polygons_are_what_a_clip_around_them_gives(spark):
    rows = [(1, [box(0, 0, 8, 8), box(1, 1, 3, 3), box(4, 4, 7, 7)]), (2, [box(0, 0, 8, 8)[::-1], box(1, 1, 3, 3)[::-1]]), (3, [box(5, 5, 6, 5)]), (4, None), (5, []), (6, [box(2, 2, 4, 4)[:3]])]
    subjects = spark.createDataFrame(rows, "zone_id " + SCHEMA)
    around = spark.createDataFrame([(0, [box(-100, -100, 100, 100)])], "clip_id " + SCHEMA)
    want = sorted(overlay.clip(subjects, around).drop("clip_id").collect())
    assert sorted(overlay.uncut(subjects, "zone_id").collect()) == want and [(r.zone_id, r.area, r.parts, r.holes) for r in want] == [(1, 51.0, 1, 2), (2, 60.0, 1, 1)]
