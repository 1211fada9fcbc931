"""Per-pixel products as column expressions: indices, scores, calibration, band algebra."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .graph import stored
from .stats import exact_quantiles


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); 0/0 and NaN give 0, a zero sum gives the sign of the difference."""
    num, den = a - b, a + b
    return F.when(F.isnan(num) | F.isnan(den), 0.0).when(den == 0, F.signum(num)).otherwise(num / den)


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def ratio(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return (a - b) / (a + b + eps)


def ndvi(red: Column, nir: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalized_difference(swir, nir)


def mndwi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def awei(green: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    return 4 * (green - swir1) - (0.25 * nir + 2.75 * swir2)


def ibi(green: Column, red: Column, nir: Column, swir: Column) -> Column:
    background = (ratio(nir, red) + ratio(green, swir)) / 2
    built = ratio(swir, nir)
    return (built - background) / (built + background + 1e-10)


def whiteness(blue: Column, green: Column, red: Column) -> Column:
    """Mean absolute deviation of the visible bands from their mean, relative to it."""
    mean = (blue + green + red) / 3
    return (F.abs((blue - mean) / (mean + 1e-10)) + F.abs((green - mean) / (mean + 1e-10)) + F.abs((red - mean) / (mean + 1e-10))) / 3


def haze(blue: Column, red: Column) -> Column:
    return blue - 0.5 * red - 0.08


#: Cloud and building parameters by mode (fixed values).
CLOUD = {
    "default": {"blue": 0.25, "swir": 0.18, "brightness": 0.30, "whiteness": 0.70, "ndvi": 0.80, "ndsi": 0.80, "hot": 0.0, "score": 0.55},
    "strict": {"blue": 0.30, "swir": 0.22, "brightness": 0.35, "whiteness": 0.55, "ndvi": 0.80, "ndsi": 0.80, "hot": 0.0, "score": 0.65},
    "sensitive": {"blue": 0.18, "swir": 0.12, "brightness": 0.22, "whiteness": 0.85, "ndvi": 0.80, "ndsi": 0.80, "hot": 0.0, "score": 0.45},
}
BUILDING = {
    "default": {"ndbi": 0.0, "ibi": 0.0, "score": 0.55, "ndvi": 0.2, "mndwi": 0.0},
    "strict": {"ndbi": 0.08, "ibi": 0.08, "score": 0.55, "ndvi": 0.12, "mndwi": -0.05},
    "sensitive": {"ndbi": -0.05, "ibi": 0.0, "score": 0.55, "ndvi": 0.30, "mndwi": 0.10},
}


def cloud_terms(df: DataFrame) -> dict[str, Column]:
    b, g, r, n, s = (F.col(c) for c in ("b1", "b2", "b3", "b4", "b5"))
    return {"blue": b, "swir": s, "brightness": (b + g + r) / 3, "whiteness": whiteness(b, g, r), "ndvi": ratio(n, r), "ndsi": ratio(g, s), "hot": haze(b, r)}


def cloud_score(df: DataFrame, mode: str = "default") -> Column:
    t, p = cloud_terms(df), CLOUD[mode]
    return (
        0.30 * clip01((t["brightness"] - 0.15) / 0.55)
        + 0.20 * clip01((t["blue"] - 0.12) / 0.50)
        + 0.20 * clip01((p["whiteness"] - t["whiteness"]) / p["whiteness"])
        + 0.15 * clip01((p["ndvi"] - t["ndvi"]) / (p["ndvi"] + 1))
        + 0.10 * clip01((p["ndsi"] - t["ndsi"]) / (p["ndsi"] + 1))
        + 0.05 * clip01((t["hot"] - p["hot"] + 0.15) / 0.40)
    )


def cloud_fmask(df: DataFrame, mode: str = "default") -> Column:
    t, p = cloud_terms(df), CLOUD[mode]
    keep = (cloud_score(df, mode) > p["score"]) & (t["blue"] > p["blue"]) & (t["brightness"] > p["brightness"])
    keep = keep & (t["whiteness"] < p["whiteness"]) & (t["ndvi"] < p["ndvi"]) & (t["ndsi"] < p["ndsi"]) & (t["hot"] > p["hot"])
    return keep.cast("int")


def building_score(df: DataFrame, mode: str = "default") -> Column:
    g, r, n, s = (F.col(c) for c in ("b2", "b3", "b4", "b5"))
    p = BUILDING[mode]
    return 0.55 * clip01((ratio(s, n) + 1) / 2) + 0.25 * clip01((p["ndvi"] - ratio(n, r)) / (p["ndvi"] + 1)) + 0.20 * clip01((p["mndwi"] - ratio(g, s)) / (p["mndwi"] + 1))


def building_mask(index: Column, threshold: float, mode: str = "default") -> Column:
    g, r, n, s = (F.col(c) for c in ("b2", "b3", "b4", "b5"))
    p = BUILDING[mode]
    return ((index > threshold) & (ratio(n, r) < p["ndvi"]) & (ratio(g, s) < p["mndwi"])).cast("int")


_FUNCTIONS = {"arcsin": "asin", "arccos": "acos", "arctan": "atan", "arctan2": "atan2", "log": "ln", "where": "if"}


def calculator(df: DataFrame, expression: str, variables: dict[str, list[str]]) -> DataFrame:
    """Band algebra over wide pixels: a variable names a list of band columns, `A_2` its second band.

    Operands of equal band counts go band by band, one-band operands are repeated, other mixes fail. Results are named
    r1, r2, ...; a result that is not finite is NULL, as is one with a NULL operand.
    """
    tokens = re.findall(r"\b([A-Za-z]\w*?)(?:_(\d+))?\b(?!\s*\()", expression)
    picked: dict[str, list[str]] = {}
    for name, number in tokens:
        if name.upper() in ("E", "PI"):
            raise ValueError(f"{name} is the name of a constant")
        if name not in variables:
            raise ValueError(f"unknown variable {name}")
        bands = variables[name]
        if number and not 1 <= int(number) <= len(bands):
            raise ValueError(f"{name} has no band {number}")
        picked[name + (f"_{number}" if number else "")] = [bands[int(number) - 1]] if number else bands
    counts = {len(b) for b in picked.values()} - {1}
    if len(counts) > 1:
        raise ValueError("operands have different numbers of bands")
    out = []
    for i in range(max(counts, default=1)):
        text = re.sub(r"\b([A-Za-z]\w*)\b(\s*\()?", lambda m: (_FUNCTIONS.get(m[1], m[1]) + m[2]) if m[2] else "`" + picked[m[1]][min(i, len(picked[m[1]]) - 1)] + "`", expression)  # noqa: B023
        value = F.expr(text).cast("double")
        out.append(F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value).alias(f"r{i + 1}"))
    return df.select("row", "col", *out)


def calibrate(value: Column, mult: Column, add: Column, sun_elevation: Column | None = None, clamp: bool = False) -> Column:
    """mult * value + add, divided by the sine of the sun's elevation where one is given."""
    out = value * mult + add
    if sun_elevation is not None:
        out = F.when(sun_elevation.isNull(), out).otherwise(out / F.sin(F.radians(sun_elevation)))
    return clip01(out) if clamp else out


def radiance_to_reflectance(radiance: Column, distance: Column, irradiance: Column, sun_elevation: Column) -> Column:
    import math

    return F.lit(math.pi) * radiance * distance * distance / (irradiance * F.sin(F.radians(sun_elevation)))


def dark_object(df: DataFrame, band: str, percent: float = 0.01) -> DataFrame:
    """The band less its dark percentile (never below 0), floored at 0. The input is stored once."""
    df = stored(df, "dark")
    dark = exact_quantiles(df, band, [percent])[0]
    return df.withColumn(band, F.greatest(F.col(band) - max(dark or 0.0, 0.0), F.lit(0.0)))


def quick_correction(df: DataFrame, band: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(value - dark) / (bright - dark), clipped to 0..1; 0 where bright is not above dark. The input is stored once."""
    df = stored(df, "quick")
    dark, bright = exact_quantiles(df, band, [low, high])
    if dark is None or bright <= dark:
        return df.withColumn(band, F.lit(0.0))
    return df.withColumn(band, clip01((F.col(band) - dark) / (bright - dark)))


def valid_bands(df: DataFrame, bands: list[str], mask: Column | None = None, nodata: float | None = None, zero_is_invalid: bool = False) -> DataFrame:
    """Bands with NULL where the explicit mask, the nodata value, NaN or (if it counts) zero says that a pixel is missing."""

    def valid(c: str) -> Column:
        bad = F.isnan(c)
        if mask is not None:
            bad |= ~F.coalesce(mask, F.lit(False))
        if nodata is not None:
            bad |= F.col(c) == nodata
        if zero_is_invalid:
            bad |= F.col(c) == 0
        return F.when(~bad, F.col(c))

    return df.withColumns({c: valid(c) for c in bands})


def reflectance(df: DataFrame, band: str) -> DataFrame:
    """The band scaled by its largest value's range (1, 255, 10000 or 65535) and clipped to 0..1; missing counts as 0."""
    top = df.agg(F.max(F.when(~F.isnan(F.col(band).cast("double")), F.col(band))).alias("_top"))
    scale = F.when(F.col("_top") <= 1, 1.0).when(F.col("_top") <= 255, 255.0).when(F.col("_top") <= 12000, 10000.0).otherwise(65535.0)
    value = F.greatest(F.least(F.nanvl(F.col(band) / scale, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return df.crossJoin(F.broadcast(top)).withColumn(band, F.coalesce(value, F.lit(0.0))).drop("_top")


#: Largest NDVI and near infrared of water in each mode, and of near infrared and SWIR in deep water (fixed values).
WATER_MODES = {"standard": (0.1, 0.15), "strict": (0.05, 0.12), "sensitive": (0.15, 0.18)}
DEEP_NIR, DEEP_SWIR = 0.05, 0.05


def water_rules(blue: Column, green: Column, red: Column, nir: Column, swir: Column, threshold: float = 0.0, mode: str = "standard") -> Column:
    """Water mask of reflectances by MNDWI, NDVI, near infrared and colour rules, or by the deep-water rule."""
    most_ndvi, most_nir = WATER_MODES[mode]
    ratio = lambda a, b: (a - b) / F.nullif(a + b, F.lit(0.0))
    base = (ratio(green, swir) > threshold) & (ratio(nir, red) < most_ndvi) & (nir < most_nir) & (green > red) & (blue < green)
    deep = (ratio(green, swir) > -0.1) & (nir < DEEP_NIR) & (swir < DEEP_SWIR)
    return F.coalesce((base | deep).cast("int"), F.lit(0))
