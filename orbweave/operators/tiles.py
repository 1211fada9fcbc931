"""Web map tiles of a raster: Mercator placement, stretch, RGBA.

Tiles are squares of the global pixel grid of a zoom level; their pixels are sampled from the source by warping, band by
band, and each tile is stretched and packed by itself from its at most SIZE * SIZE pixels.

Defined cases: a pixel is opaque where any band is valid there, and an invalid band of it counts as 0; a tile without a valid
pixel has no row; one band is shown as grey, two as red and green; a stretch between equal values is black; an empty raster
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stats import exact_quantiles
from .warp import Grid, bounds_in, reproject

SIZE = 256
#: Half the side of the Mercator square, in metres.
EDGE = math.pi * 6378137.0
LOW, HIGH = 0.02, 0.98


def tile_grid(pixels: DataFrame, source: Grid, zoom: int) -> tuple[Grid, int, int]:
    """(grid of all tiles of a zoom level that the raster touches, first tile's x and y)."""
    n = 1 << zoom
    left, bottom, right, top = bounds_in(pixels.sparkSession, source, "EPSG:3857")
    clamp = lambda v: max(0, min(n - 1, math.floor(v)))
    x0, x1 = (clamp((v + EDGE) / (2 * EDGE) * n) for v in (left, right))
    y0, y1 = (clamp((EDGE - v) / (2 * EDGE) * n) for v in (top, bottom))
    res = 2 * EDGE / (n * SIZE)
    return Grid("EPSG:3857", x0 * SIZE * res - EDGE, EDGE - y0 * SIZE * res, res, res, (x1 - x0 + 1) * SIZE, (y1 - y0 + 1) * SIZE), x0, y0


def stretch(bands: list[np.ndarray], scene: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """(low, high) of each band of a tile: masks from 0 to 1, indices from -1 to 1, all else by the scene's percentiles."""
    low, high = min(b.min() for b in bands), max(b.max() for b in bands)
    if low >= 0 and high <= 1 and all(np.isin(b, (0, 1)).all() for b in bands):
        return [(0.0, 1.0)] * len(bands)
    return [(-1.0, 1.0)] * len(bands) if low >= -1.0001 and high <= 1.0001 else scene


def _painter(count: int, scene: list[tuple[float, float]], x0: int, y0: int):
    def run(rows: pa.Table) -> pa.Table:
        image = np.zeros((SIZE, SIZE, 4), np.uint8)
        at = (rows.column("row").to_numpy() % SIZE, rows.column("col").to_numpy() % SIZE)
        bands = []
        for k in range(count):
            band = np.zeros((SIZE, SIZE))
            band[at] = np.nan_to_num(rows.column(f"v{k}").to_numpy(zero_copy_only=False).astype(float))
            bands.append(band)
        image[(*at, 3)] = 255
        for k, (low, high) in enumerate(stretch(bands, scene)):
            image[..., k] = np.clip((bands[k] - low) / (high - low) * 255, 0, 255) if high > low else 0
        if count == 1:
            image[..., 1] = image[..., 2] = image[..., 0]
        image[image[..., 3] == 0] = 0
        sums = image.astype(np.int64).sum(axis=(0, 1))
        number = {"x": [rows.column("tx")[0].as_py() + x0], "y": [rows.column("ty")[0].as_py() + y0], "opaque": [int(sums[3]) // 255], "red": [int(sums[0])], "green": [int(sums[1])], "blue": [int(sums[2])]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in number.items()} | {"rgba": pa.array([image.tobytes()], pa.binary())})

    return run


def render(pixels: DataFrame, bands: list[str], source: Grid, zoom: int, method: str = "nearest") -> DataFrame:
    """(x, y, opaque, red, green, blue, rgba) of every tile of a zoom level: opaque pixels, channel sums, the raw image row by row."""
    if not 1 <= len(bands) <= 3:
        raise ValueError("one to three bands are shown")
    grid, x0, y0 = tile_grid(pixels, source, zoom)
    scene = [tuple(v or 0.0 for v in exact_quantiles(pixels, b, [LOW, HIGH])) for b in bands]
    long = None
    for k, b in enumerate(bands):
        own = reproject(pixels, b, source, grid, method).select("row", "col", F.lit(k).alias("k"), "value")
        long = own if long is None else long.unionByName(own)
    wide = long.groupBy("row", "col").agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in range(len(bands))))
    wide = wide.withColumns({"tx": F.floor(F.col("col") / SIZE), "ty": F.floor(F.col("row") / SIZE)})
    return wide.groupBy("tx", "ty").applyInArrow(_painter(len(bands), scene, x0, y0), "x long, y long, opaque long, red long, green long, blue long, rgba binary")
