"""Labels and outlines of regions against flood fill and even-odd filling; graph rounds against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators import graph, gridgraph, regions


def flood(cells):
    label = {}
    for at in sorted(cells):
        if at in label:
            continue
        todo, label[at] = [at], at
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in cells and n not in label and cells[n] == cells[at]:
                    label[n] = at
                    todo.append(n)
    return label


def inside(x, y, ring):
    return sum((a["y"] > y) != (b["y"] > y) and x < a["x"] for a, b in zip(ring, ring[1:])) % 2 == 1


@pytest.mark.parametrize(("block", "seed", "share"), [(4, 1, 0.5), (3, 2, 0.62), (256, 3, 0.55)])
def test_regions_and_polygons(spark, block, seed, share):
    rng = random.Random(seed)
    cells = {(r, c): float(rng.choice([1, 2]) if seed == 1 else 1) for r in range(-3, 14) for c in range(17) if rng.random() < share}
    rows = [(r, c, v, 9) for (r, c), v in cells.items()] + [(20, 20, None, 9), (20, 21, float("nan"), 9)]
    df = spark.createDataFrame(rows, "row long, col long, v double, label int")
    label = flood(cells)
    got = {(r.row, r.col): (r.label >> 32, r.label & 0xFFFFFFFF) for r in regions.labelled(df, "v", block).collect()}
    assert got == label
    polygons = {(r.label_row, r.label_col): r for r in regions.polygons(df, "v", block=block).collect()}
    assert polygons.keys() == set(label.values())
    for first, p in polygons.items():
        own = {at for at, f in label.items() if f == first}
        assert (p.value, p.area) == (cells[first], len(own))
        rings = [p.outer, *p.holes]
        assert all(r[0] == r[-1] and len({(q["x"], q["y"]) for q in r}) == len(r) - 1 for r in rings)  # closed, and no corner twice
        assert all((a["x"] == b["x"]) != (b["x"] == c["x"]) for r in rings for a, b, c in zip(r, r[1:], [*r[2:], r[1]]))  # every point is a corner
        for r in range(-4, 15):
            for c in range(-1, 18):
                assert (sum(inside(c + 0.5, r + 0.5, ring) for ring in rings) % 2 == 1) == ((r, c) in own)


def test_long_ring_over_many_blocks(spark):
    """A spiral one pixel wide: one region, one outline, through every block many times."""
    n, cells, r, c, dr, dc = 21, set(), 0, 0, 0, 1
    free = lambda r, c: 0 <= r < n and 0 <= c < n and (r, c) not in cells
    while free(r, c):
        cells.add((r, c))
        ahead, two = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
        if not free(*ahead) or two in cells:
            dr, dc = dc, -dr
        r, c = r + dr, c + dc
    df = spark.createDataFrame(sorted(cells), "row long, col long")
    found = regions.footprint(df, block=2).collect()
    assert len(found) == len(set(flood(dict.fromkeys(cells, 1)).values()))
    assert sum(p.area for p in found) == len(cells)


def test_guards_and_empty_grids(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 2, 1.0), (0, 3, 0.0), (2, 0, 2.0)], "row long, col long, v double")
    assert regions.polygons(df, "v", max_features=3).count() == 3 and regions.polygons(df, "v", skip_zero=False).count() == 4
    with pytest.raises(ValueError):
        regions.polygons(df, "v", max_features=2)
    assert regions.polygons(df.limit(0), "v").count() == 0 and regions.footprint(df.limit(0)).count() == 0
    assert gridgraph.components(df.limit(0).select("row", "col")).count() == 0


def test_graph_rounds(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (900, 900), (1, None)] + [(700, 701 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.label for r in graph.lowest_label(df).collect()} == {x: find(x) for x in parent}
    assert graph.lowest_label(df.limit(0)).count() == 0
    cycles, at = [], 0
    for size in (1, 2, 3, 4, 7, 8, 33):
        ids = rng.sample(range(at, at + 100), size)
        at += 100
        cycles += list(zip(ids, ids[1:] + ids[:1]))
    found = {r.id: (r.ring, r.place) for r in graph.rings(spark.createDataFrame(cycles, "id long, next long")).collect()}
    onward = dict(cycles)
    for i, (ring, place) in found.items():
        assert found[onward[i]] == ((ring, place + 1) if onward[i] != ring else (ring, found[ring][1]))
        assert ring <= i and (i != ring or place == min(p for r, p in found.values() if r == ring))
    numbers = graph.numbered(df.select(F.col("a").alias("x")).distinct(), "x", "n").orderBy("x").collect()
    assert [r.n for r in numbers] == list(range(1, len(numbers) + 1))
