"""Vector operators: points, boxes and polygons as columns; spatial joins hash cells, then refine by expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Ring: array of points (x, y), closed. Polygon: array of rings, the first outer.


def bbox_filter(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    return points.filter(F.col("lon").between(minx, maxx) & F.col("lat").between(miny, maxy))


def normalize_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def split_view(minx: float, miny: float, maxx: float, maxy: float) -> list[tuple[float, float, float, float]]:
    """One or two canonical envelopes of a view that may cross the antimeridian."""
    if maxx - minx >= 360:
        return [(-180.0, miny, 180.0, maxy)]
    left = (minx + 180) % 360 - 180
    right = left + (maxx - minx)
    return [(left, miny, right, maxy)] if right <= 180 else [(left, miny, 180.0, maxy), (-180.0, miny, right - 360, maxy)]


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over the ring's segments."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    crosses = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.aggregate(pairs, F.lit(False), lambda acc, s: acc != crosses(s))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def l_ring(x: Column, y: Column, w: Column, h: Column) -> Column:
    """An L-shaped ring: the box less its lower right quarter."""
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(point(x, y), point(x + w / 2, y), point(x + w / 2, y + h / 2), point(x + w, y + h / 2), point(x + w, y + h), point(x, y + h), point(x, y))


def ring_area_km2(ring: Column) -> Column:
    """Area of a closed lon/lat ring on the WGS84 authalic sphere."""
    a, b = 6378.137, 6356.752314245
    e2 = 1 - (b / a) ** 2
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    q1 = (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))
    r2 = a * a * q1 / 2
    beta = lambda lat: q(F.sin(F.radians(lat))) / q1
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("n"))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + F.radians(s["n"]["x"] - s["p"]["x"]) * (2 + beta(s["p"]["y"]) + beta(s["n"]["y"])))
    return F.abs(total) * r2 / 2


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def points_in_zones(points: DataFrame, zones: DataFrame, depth: int = 3) -> DataFrame:
    """(point columns, zone_id) of points (x, y) inside zones (zone_id, ring).

    A zone is cut into cells of its own size's order, at most (2**depth + 1)**2 of them whatever its size; points are looked up
    at each cell size in use. Cells carry bounds only: rings come back by id for the points that their bounds hold.
    A null ring holds nothing; rows of one zone_id are zones of their own.
    """
    b = ring_bounds(F.col("ring"))
    z = zones.filter("ring is not null").select("zone_id", F.xxhash64("ring").alias("_ring"), b.alias("_b"))
    side = F.greatest(F.col("_b.xmax") - F.col("_b.xmin"), F.col("_b.ymax") - F.col("_b.ymin"), F.lit(1e-9))
    z = z.withColumn("_level", F.ceil(F.log2(side)).cast("int") - depth)
    levels = [r[0] for r in z.select("_level").distinct().collect()] or [0]  # powers of two: a few dozen at most
    size = F.pow(F.lit(2.0), F.col("_level"))
    spans = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    z = z.withColumn("_cx", spans("_b.xmin", "_b.xmax")).withColumn("_cy", spans("_b.ymin", "_b.ymax"))
    p = points.withColumn("_level", F.explode(F.array(*(F.lit(x) for x in levels))))
    p = p.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    met = p.join(z, ["_level", "_cx", "_cy"]).filter("x between _b.xmin and _b.xmax and y between _b.ymin and _b.ymax").drop("_level", "_cx", "_cy", "_b")
    rings = zones.select("zone_id", F.xxhash64("ring").alias("_ring"), F.col("ring").alias("_points")).dropDuplicates(["zone_id", "_ring"])
    found = met.join(rings, ["zone_id", "_ring"]).filter(point_in_ring(F.col("x"), F.col("y"), F.col("_points")))
    return found.select(*points.columns, "zone_id")


def rasterize(zones: DataFrame, value: str) -> DataFrame:
    """Burn boxes (r0, c0, h, w): each cell whose center is inside takes the value of the last zone in order."""
    cells = zones.select("zone_id", value, F.explode(F.expr("sequence(r0, r0 + h - 1)")).alias("row"), "c0", "w").select("zone_id", value, "row", F.explode(F.expr("sequence(c0, c0 + w - 1)")).alias("col"))
    return cells.groupBy("row", "col").agg(F.max_by(value, "zone_id").alias("value"))


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """XYZ tile of a point, clamped to the zoom's range."""
    n = 1 << zoom
    p = F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878)))
    clamp = lambda c: F.greatest(F.least(F.floor(c), F.lit(n - 1)), F.lit(0))
    return clamp((lon + 180) / 360 * n), clamp((1 - F.log(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * n)


def tile_place(lon: Column, lat: Column, zoom: int, extent: int = 4096) -> tuple[Column, Column, Column, Column]:
    """Tile and quantized place inside it."""
    n = 1 << zoom
    p = F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878)))
    fx, fy = (lon + 180) / 360 * n, (1 - F.log(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * n
    x, y = tile_of(lon, lat, zoom)
    return x, y, F.floor((fx - x) * extent), F.floor((fy - y) * extent)


def feature_geojson() -> Column:
    """A GeoJSON Feature of a point row, the category folded into its properties."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("name", "category", "balance").alias("properties")))


def clip_box(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


#: What counts as a number in the text of a property; fixed pattern.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"


def property_summary(features: DataFrame) -> DataFrame:
    """(layer_id, property, type, numbers, low, high, mean) of features(layer_id, feature_id, properties as JSON text).

    A property's type is that of its value in the layer's first feature that has it; numbers are the values whose text is a plain
    number, so a word among them is passed over. Properties that are no JSON object have no properties; a null layer is a layer.
    """
    known = features.select("layer_id", "feature_id", F.explode(F.from_json("properties", "map<string,variant>")).alias("property", "v"))
    kind = F.schema_of_variant("v")
    known = known.select("layer_id", "feature_id", "property", kind.alias("kind"), F.col("v").cast("string").alias("text"))
    number = F.when(F.col("text").rlike(NUMBER), F.col("text").try_cast("double"))
    kinds = F.when(F.col("kind").isin("BIGINT", "BOOLEAN", "STRING", "DOUBLE"), F.lower("kind")).when(F.col("kind").startswith("DECIMAL"), "double").when(F.col("kind").startswith("ARRAY"), "array").when(F.col("kind").startswith("OBJECT"), "object").otherwise("null")
    return known.groupBy("layer_id", "property").agg(F.min_by(kinds, "feature_id").alias("type"), F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"))


def layer_samples(features: DataFrame, n: int = 3) -> DataFrame:
    """The first n features of each layer by id, numbered from 1."""
    from pyspark.sql import Window

    return features.withColumn("sample", F.row_number().over(Window.partitionBy("layer_id").orderBy("feature_id"))).filter(F.col("sample") <= n)
