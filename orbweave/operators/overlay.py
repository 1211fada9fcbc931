"""Intersections of polygons with holes, as joins: candidate pairs by cells of their own size, crossings of sides, chained pieces.

A polygon is an array of closed rings of (x, y), the outer one first. Rings are turned so that a polygon lies to the left of
its sides. Where a side of one crosses into the other, a piece of its ring begins that runs to its next crossing, where a piece
of the other's ring goes on; chains of pieces close to the rings of the result by pointer jumping. Rings without crossings are
whole inside the other or not at all. The second polygon is moved by about 1e-9 of the first one's size in a direction of no
special slope, so sides never lie upon each other and corners never on sides: areas are right to about 1e-8 of that size, and what
is thinner counts as nothing.

Equal work is done once: polygons that differ by their place alone share a shape, and a pair is two shapes and the way from one to
the other. What a pair comes to is joined back to all polygons at the places it is met at, so copies cost their rows of the result only.

Defined cases: a null or empty polygon and rings of fewer than four points meet nothing; pairs that only touch give no row; repeated
ids are repeated polygons; slivers are left out and counted as dropped; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import rings as ring_order, stored
from .vector import point_in_ring

SHIFT = (6.1803398875e-10, 4.1421356237e-10)
POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"
#: Sides of a pair that meet in one cell of its own, about.
CELL_SIDES = 32
#: Polygons of one side in a part of a cell, about.
CELL_ROWS = 512


def signed_area(ring: Column) -> Column:
    """Area of a closed ring, positive if it turns left."""
    following = F.slice(ring, 2, F.size(ring) - 1)
    cross = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda t, v: t + v) / 2


def _prepared(polygons: DataFrame, key: str) -> DataFrame:
    """(key, rings, x0, y0, x1, y1, level): rings turned left around the polygon, bounds, and the power of two that holds them."""
    turned = F.transform("rings", lambda r, i: F.when((signed_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r)))
    p = polygons.select(key, F.filter("rings", lambda r: F.size(r) >= 4).cast(RINGS).alias("rings")).filter("size(rings) > 0").select(key, turned.alias("rings"))
    outer = F.get("rings", F.lit(0))
    xs, ys = F.transform(outer, lambda q: q["x"]), F.transform(outer, lambda q: q["y"])
    p = p.select(key, "rings", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return p.withColumn("level", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)))).cast("int"))


def _cells(p: DataFrame, levels: list[int]) -> DataFrame:
    """One row for each cell that the bounds touch, four at most, at the own level and at each coarser one of the other side."""
    own = F.array_distinct(F.concat(F.array("level"), F.filter(F.array(*(F.lit(x) for x in levels)), lambda x: x > F.col("level"))))
    p = p.withColumn("at", F.explode(own))
    size = F.pow(F.lit(2.0), F.col("at"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return p.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of prepared polygons whose bounds share area, each once, whatever their sizes: all columns of a, those of b with b_ before."""
    levels = lambda p: [r.level for r in p.select("level").distinct().collect()]  # noqa: E731  powers of two in use: a few dozen
    left = _cells(a, levels(b))
    right = _cells(b, levels(a))
    right = right.select("at", "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in b.columns))
    cell = ["at", "cx", "cy"]
    # A full cell is met in parts: its rows of one side are dealt, those of the other go to each part.
    many = left.groupBy(*cell).agg(F.ceil(F.count("*") / CELL_ROWS).alias("many"))
    left = left.join(many, cell).withColumn("part", F.pmod(F.xxhash64("x0", "y0", "x1", "y1"), F.col("many"))).drop("many")
    right = right.join(many, cell).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).drop("many")
    cell.append("part")
    met = spread(left, *cell).join(spread(right, *cell), cell).filter("at = greatest(level, b_level) and x0 < b_x1 and b_x0 < x1 and y0 < b_y1 and b_y0 < y1")
    size = F.pow(F.lit(2.0), F.col("at"))
    home = (F.floor(F.greatest("x0", "b_x0") / size) == F.col("cx")) & (F.floor(F.greatest("y0", "b_y0") / size) == F.col("cy"))
    return met.filter(home).drop("at", "cx", "cy", "part", "level", "b_level")


def _moved(rings: str, dx: Column, dy: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))


def shared_shapes(p: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Shapes (shape, rings from the corner of their bounds), and which polygon of (key, rings, bounds, level) has which where."""
    p = p.withColumn("rings", _moved("rings", -F.col("x0"), -F.col("y0")))
    shapes = stored(p.select("rings").distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    return shapes, stored(p.join(shapes, "rings").select(key, "shape", "x0", "y0", "x1", "y1", "level"), "members")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all tasks before each of them becomes many: their own size says nothing about what follows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _inside(point: Column, rings: str) -> Column:
    return F.aggregate(rings, F.lit(False), lambda odd, r: odd != point_in_ring(point["x"], point["y"], r))


def clip(subjects: DataFrame, clips: DataFrame, key: str = "zone_id", other: str = "clip_id", thin: float = 1e-7) -> DataFrame:
    """What clips(other, rings) leave of subjects(key, rings): key, other, rings (outer ones turn left, holes right), area, parts, holes.

    Pairs whose common area is below thin times the square of the subject's size have no row.
    """
    found, of_a, of_b = _clipped(subjects, clips, key, other, thin)
    found = spread(found, "shape", "x0", "y0", "b_shape", "b_x0", "b_y0").join(of_a.select(key, "shape", "x0", "y0"), ["shape", "x0", "y0"])
    found = found.join(of_b.select(other, F.col("shape").alias("b_shape"), F.col("x0").alias("b_x0"), F.col("y0").alias("b_y0")), ["b_shape", "b_x0", "b_y0"])
    return found.select(key, other, _moved("rings", F.col("x0"), F.col("y0")).alias("rings"), "area", "parts", "holes")


def uncut(polygons: DataFrame, key: str, thin: float = 1e-7) -> DataFrame:
    """What clip() makes of polygons(key, rings) when nothing of them is cut off: key, rings, area, parts, holes."""
    corner = _moved("rings", -F.col("x0"), -F.col("y0"))
    by = F.array_sort(F.zip_with("rings", corner, lambda r, m: F.struct((-signed_area(m)).alias("o"), r.alias("ring"))))
    # Exploded as one element, so that the filter on the area does not work it out a second time.
    p = _prepared(polygons, key).withColumn("by", F.explode(F.array(by))).withColumn("area", F.aggregate("by", F.lit(0.0), lambda t, r: t - r["o"]))
    size, count = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), lambda f: F.size(F.filter("by", f)).cast("long")
    p = p.filter(F.col("area") > thin * size * size)
    return p.select(key, F.transform("by", lambda r: r["ring"]).alias("rings"), "area", count(lambda r: r["o"] < 0).alias("parts"), count(lambda r: r["o"] > 0).alias("holes"))


def kept(subjects: DataFrame, clips: DataFrame, key: str = "zone_id", other: str = "clip_id", thin: float = 1e-7) -> DataFrame:
    """(key) of the subjects that have a row in clip(), once for each of them: pairs are not written out."""
    found, of_a, _ = _clipped(subjects, clips, key, other, thin)
    return of_a.join(found.select("shape", "x0", "y0").distinct(), ["shape", "x0", "y0"], "left_semi").select(key)


def _clipped(subjects: DataFrame, clips: DataFrame, key: str, other: str, thin: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rings, area, parts and holes for each two places (shape, x0, y0, b_shape, b_x0, b_y0), rings from the first one's corner; members of both sides."""
    (shapes_a, of_a), (shapes_b, of_b) = shared_shapes(_prepared(subjects, key), key), shared_shapes(_prepared(clips, other), other)
    places = lambda of: of.select("shape", "x0", "y0", "x1", "y1", "level").distinct()
    met = candidates(places(of_a), places(of_b))
    met = stored(met.select("shape", "x0", "y0", "b_shape", "b_x0", "b_y0", (F.col("b_x0") - F.col("x0")).alias("dx"), (F.col("b_y0") - F.col("y0")).alias("dy")), "met")
    kind = ["shape", "b_shape", "dx", "dy"]
    pairs = spread(met.select(*kind).distinct(), *kind).join(shapes_a.withColumnRenamed("rings", "rings_a"), "shape").join(shapes_b.select(F.col("shape").alias("b_shape"), F.col("rings").alias("rings_b")), "b_shape")
    first = F.get("rings_a", F.lit(0))
    pairs = pairs.withColumn("size", F.greatest(F.array_max(F.transform(first, lambda q: q["x"])), F.array_max(F.transform(first, lambda q: q["y"]))))
    pairs = pairs.withColumn("rings_b", _moved("rings_b", F.col("dx") + F.col("size") * SHIFT[0], F.col("dy") + F.col("size") * SHIFT[1]))
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")  # from here on a pair has its number
    sides = F.aggregate("rings_a", F.lit(0), lambda t, r: t + F.size(r)) + F.aggregate("rings_b", F.lit(0), lambda t, r: t + F.size(r))
    # Without a side of the second polygon near the first one's bounds there is nothing to cross.
    near = F.exists("rings_b", lambda r: F.exists(F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("p"), F.slice(r, 2, F.size(r) - 1).alias("q")), lambda s: ~_apart(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])))
    fine = pairs.filter(near).withColumn("cell", F.col("size") / F.ceil(F.sqrt(sides / CELL_SIDES)))

    def edges(side: str) -> DataFrame:
        e = fine.select("pair", "cell", "size", F.posexplode(f"rings_{side}").alias("ring", "points"))
        e = e.select("pair", "cell", "size", "ring", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))).alias("i", "s"))
        e = e.select("pair", "cell", "size", "ring", "i", *(F.col(f"s.{p}.{c}").alias(f"{c}{n}") for n, p in enumerate("pq") for c in "xy"))
        # Crossings lie within the first polygon's bounds.
        span = lambda c: F.sequence(F.floor(F.greatest(F.least(f"{c}0", f"{c}1"), F.lit(0.0)) / F.col("cell")), F.floor(F.least(F.greatest(f"{c}0", f"{c}1"), F.col("size")) / F.col("cell")))
        near = e.filter(~_apart(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
        near = near.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y"))).drop("cell", "size")
        return near.toDF("pair", *(f"{side}_{c}" for c in ("ring", "i", "x0", "y0", "x1", "y1")), "cx", "cy")

    def turn(o: str, p: str, k: int) -> Column:
        """On which side of a side of o a corner k of p lies."""
        c = lambda s, x, m: F.col(f"{s}_{x}{m}")
        return (c(o, "x", 1) - c(o, "x", 0)) * (c(p, "y", k) - c(o, "y", 0)) - (c(o, "y", 1) - c(o, "y", 0)) * (c(p, "x", k) - c(o, "x", 0))

    x = edges("a").join(edges("b"), ["pair", "cx", "cy"])
    x = x.withColumns({"a0": turn("b", "a", 0), "a1": turn("b", "a", 1), "b0": turn("a", "b", 0), "b1": turn("a", "b", 1)})
    x = x.filter("(a0 > 0) <> (a1 > 0) and (b0 > 0) <> (b1 > 0)")
    t = F.col("a0") / (F.col("a0") - F.col("a1"))
    x = x.select(
        "pair", F.concat_ws(":", "pair", "a_ring", "a_i", "b_ring", "b_i").alias("cross"), "a_ring", "a_i", t.alias("a_t"), "b_ring", "b_i", (F.col("b0") / (F.col("b0") - F.col("b1"))).alias("b_t"),
        F.struct((F.col("a_x0") + t * (F.col("a_x1") - F.col("a_x0"))).alias("x"), (F.col("a_y0") + t * (F.col("a_y1") - F.col("a_y0"))).alias("y")).alias("at"), (F.col("a1") > 0).alias("a_enters"),
    ).dropDuplicates(["cross"])
    x = stored(x, "crossings")

    def pieces(side: str, enters: Column, far: str) -> DataFrame:
        along = Window.partitionBy("pair", "ring").orderBy("i", "t")
        all_ = Window.partitionBy("pair", "ring")
        c = x.select("pair", F.col(f"{side}_ring").alias("ring"), F.col(f"{side}_i").alias("i"), F.col(f"{side}_t").alias("t"), "cross", "at", enters.alias("enters"))
        first = F.min(F.struct("i", "t", "cross")).over(all_)
        c = c.withColumns({"next_i": F.coalesce(F.lead("i").over(along), first["i"]), "next": F.coalesce(F.lead("cross").over(along), first["cross"]), "last": F.lead("i").over(along).isNull()})
        c = c.filter("enters").join(pairs.select("pair", F.posexplode(f"rings_{side}").alias("ring", "points")), ["pair", "ring"])
        n = F.size("points") - 1
        corners = F.slice("points", 1, n)
        many = F.col("next_i") - F.col("i") + F.when(F.col("last"), n).otherwise(0)
        return c.select("pair", F.concat(F.lit(f"{side}:"), "cross").alias("id"), F.concat(F.lit(f"{far}:"), "next").alias("next"), F.concat(F.array("at"), F.slice(F.concat(corners, corners), F.col("i") + 2, many)).alias("points"))

    chain = stored(pieces("a", F.col("a_enters"), "b").unionByName(pieces("b", ~F.col("a_enters"), "a")), "pieces")
    order = ring_order(chain.select("id", "next"))
    closed = chain.join(order, "id").groupBy("pair", "ring").agg(F.array_sort(F.collect_list(F.struct("place", "points"))).alias("parts"))
    closed = closed.select("pair", F.flatten(F.transform("parts", lambda p: p["points"])).alias("ring"))
    closed = closed.select("pair", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))
    crossed = x.select("pair", F.lit("a").alias("side"), F.col("a_ring").alias("n")).union(x.select("pair", F.lit("b"), "b_ring")).distinct()
    for side, far in (("a", "b"), ("b", "a")):
        whole = pairs.select("pair", F.posexplode(f"rings_{side}").alias("n", "ring"), F.col(f"rings_{far}").alias("far")).join(crossed.filter(F.col("side") == side), ["pair", "n"], "left_anti")
        closed = closed.unionByName(whole.filter(_inside(F.get("ring", F.lit(0)), "far")).select("pair", "ring"))
    closed = closed.withColumn("area", signed_area(F.col("ring")))
    found = closed.groupBy("pair").agg(F.sum("area").alias("area"), F.count_if(F.col("area") > 0).alias("parts"), F.count_if(F.col("area") < 0).alias("holes"), F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("o"), "ring"))).alias("by"))
    found = found.join(pairs.select("pair", *kind, "size"), "pair").filter(F.col("area") > thin * F.col("size") * F.col("size"))
    found = found.select(*kind, F.transform("by", lambda r: r["ring"]).alias("rings"), "area", "parts", "holes")
    return met.join(found, kind).drop("dx", "dy"), of_a, of_b


def _apart(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A side lies beyond the square of the first polygon's size."""
    size = F.col("size")
    return (F.greatest(x0, x1) < 0) | (F.least(x0, x1) > size) | (F.greatest(y0, y1) < 0) | (F.least(y0, y1) > size)


def clip_report(subjects: DataFrame, clipped: DataFrame, key: str = "zone_id") -> DataFrame:
    """One row: features that came in, of which some area is left, and that were dropped."""
    left = clipped.select(F.col(key).alias("left_key")).distinct()
    met = subjects.select(key).join(left, F.col(key) == F.col("left_key"), "left")
    return met.agg(F.count("*").alias("features"), F.count("left_key").alias("kept"), F.count_if(F.col("left_key").isNull()).alias("dropped"))


def along_cells(x0: Column, y0: Column, x1: Column, y1: Column, cell: Column) -> Column:
    """The cells (cx, cy) that a side passes: for each row of cells those between where it enters and leaves the row."""
    low, high = F.least(y0, y1), F.greatest(y0, y1)

    def row(cy: Column) -> Column:
        at = lambda y: F.when(y1 == y0, F.lit(None).cast("double")).otherwise(x0 + (F.greatest(F.least(y, high), low) - y0) / (y1 - y0) * (x1 - x0))
        a, b = F.coalesce(at(cy * cell), x0), F.coalesce(at((cy + 1) * cell), x1)
        # A little wider, so rounding never loses a cell.
        return F.transform(F.sequence(F.floor(F.least(a, b) / cell - 1e-9), F.floor(F.greatest(a, b) / cell + 1e-9)), lambda cx: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor(low / cell - 1e-9), F.floor(high / cell + 1e-9)), row))


def validity(polygons: DataFrame, key: str) -> DataFrame:
    """(key, valid, reason) of polygons(key, rings): closed rings of four points at least, no two sides of which cross.

    Sides meet in cells of their polygon's own grid, so a ring of many short sides costs about its length; sides of different
    rings of a polygon are held against each other too. Keys must differ. No rings, or a null among the coordinates, is not valid.
    """
    bad = lambda r: (F.size(r) < 4) | F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull())
    short = F.coalesce(F.size("rings") < 1, F.lit(True)) | F.exists("rings", lambda r: r.isNull() | F.coalesce(bad(r), F.lit(True)))
    open_ = F.exists("rings", lambda r: F.element_at(r, 1) != F.element_at(r, -1))
    first = polygons.select(key, "rings", F.when(short, "too few points").when(open_, "not closed").alias("reason"))
    sound = first.filter("reason is null")
    every = F.flatten("rings")
    xs, ys = F.transform(every, lambda p: p["x"]), F.transform(every, lambda p: p["y"])
    extent = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys), F.lit(1e-9))
    grid = sound.select(key, "rings", F.array_min(xs).alias("ox"), F.array_min(ys).alias("oy"), (extent / F.ceil(F.sqrt(F.size(every) / 2))).alias("cell"))
    s = grid.select(key, "ox", "oy", "cell", F.posexplode("rings").alias("ring", "points"))
    s = s.select(key, "ox", "oy", "cell", "ring", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))).alias("i", "s"))
    s = s.select(key, "cell", F.struct("ring", "i").alias("at"), *((F.col(f"s.{p}.{c}") - F.col(f"o{c}")).alias(f"{c}{n}") for n, p in enumerate("pq") for c in "xy"))
    s = s.withColumn("c", F.explode(along_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("cell")))).drop("cell")
    t = s.select(F.col(key).alias("_key"), F.col("c").alias("_c"), F.col("at").alias("_at"), *(F.col(f"{c}{n}").alias(f"_{c}{n}") for n in (0, 1) for c in "xy"))
    met = s.join(t, (F.col(key) == F.col("_key")) & (F.col("c") == F.col("_c")) & (F.col("at") < F.col("_at")))
    turn = lambda o, p, k: F.signum((F.col(f"{o}x1") - F.col(f"{o}x0")) * (F.col(f"{p}y{k}") - F.col(f"{o}y0")) - (F.col(f"{o}y1") - F.col(f"{o}y0")) * (F.col(f"{p}x{k}") - F.col(f"{o}x0")))
    crossing = met.filter((turn("_", "", 0) * turn("_", "", 1) < 0) & (turn("", "_", 0) * turn("", "_", 1) < 0)).select(F.col(key).alias("_key")).distinct()
    found = first.join(crossing, F.col(key) == F.col("_key"), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_key").isNotNull(), "sides cross")))
    return found.select(key, F.col("reason").isNull().alias("valid"), "reason")
