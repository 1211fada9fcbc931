"""Water masks that look at the whole scene: rules with units decided from the bands, and trees trained on the scene's own seeds.

Defined cases: null and NaN band values are invalid and never water in the rules; 0 and 65535 or more are invalid there too, as no-data numbers;
in the trained mask an invalid value counts as its band's mean; an empty scene gives no rows; a scene without seeds falls
back to the guide index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .focal import closing
from .graph import stored
from .gridgraph import fill_holes, remove_small
from .stats import band_quantiles, exact_quantiles

TINY = 1e-10
#: Largest index of vegetation, and largest near infrared, of the rules' modes; fixed values.
MODES = {"standard": (0.1, 0.15), "auto": (0.1, 0.15), "prob": (0.1, 0.15), "strict": (0.05, 0.12), "sensitive": (0.15, 0.18)}
DEEP_NIR, DEEP_SWIR, DARK = 0.05, 0.05, 0.01
BANDS = ("green", "swir", "nir", "red", "blue")


def units(scene: DataFrame, bands: tuple[str, ...] = BANDS) -> dict[str, dict]:
    """The unit of each band, from its own largest, mean and smallest value, and its darkest percent where that counts.

    norm: reflectance up to 1; 8bit: up to 255; L2: scaled reflectance, up to 12000 with a mean of 200 to 3000; L1: raw numbers
    beyond 12000, darkest percent taken off; unknown: stretched between smallest and largest. Passes read the scene again: store
    it first where it is dear. The darkest percents of all bands come from the same passes.
    """
    s = scene.agg(*(f(b).alias(f"{n}_{b}") for b in bands for n, f in (("hi", F.max), ("mean", F.avg), ("lo", F.min), ("n", F.count)))).first()
    found = {}
    for b in bands:
        hi, mean, lo = s[f"hi_{b}"], s[f"mean_{b}"], s[f"lo_{b}"]
        kind = "norm" if hi is None or hi <= 1 else "8bit" if hi <= 255 else "L2" if hi <= 12000 and 200 <= mean <= 3000 else "L1" if hi > 12000 else "unknown"
        found[b] = {"unit": kind, "lo": lo, "hi": hi, "dark": None}
    raw = [b for b in bands if found[b]["unit"] == "L1"]
    if raw:
        values = scene.select(F.expr(f"stack({len(raw)}, {', '.join(f"'{b}', {b}" for b in raw)}) as (band, value)"))
        dark = band_quantiles(values, [DARK], ends=[(b, s[f"n_{b}"], s[f"lo_{b}"], s[f"hi_{b}"]) for b in raw])
        for b in raw:
            found[b]["dark"] = dark[b][0]
    return found


def scaled(band: str, unit: dict) -> Column:
    v = F.col(band)
    return {
        "norm": lambda: v, "8bit": lambda: v / 255.0, "L2": lambda: v / 10000.0, "L1": lambda: F.when(v.isNotNull(), F.greatest(v - unit["dark"], F.lit(0.0))) / 65535.0,
        "unknown": lambda: (v - unit["lo"]) / (unit["hi"] - unit["lo"] + TINY),
    }[unit["unit"]]()


def rule_water(pixels: DataFrame, columns: dict[str, str], mode: str = "standard", threshold: float = 0.0) -> DataFrame:
    """(row, col, mask, probability) by rules on bands of any unit; columns name green, swir, nir, red and, if there is one, blue.

    auto takes the threshold from the scene, halfway between the middle and the 85th percentile of the water index.
    """
    if mode not in MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}, not {mode}")
    names = tuple(b for b in BANDS if b in columns)
    if len(names) < 4 or set(names[:4]) != set(BANDS[:4]):
        raise ValueError("green, swir, nir and red are needed")
    raw = {b: F.col(columns[b]).cast("double") for b in names}
    scene = stored(pixels.select("row", "col", *(F.when((v != 0) & ~F.isnan(v) & (v < 65535), v).alias(b) for b, v in raw.items())), "rules")
    kinds = units(scene, names)
    vegetation, infrared = MODES[mode]
    scene = scene.select("row", "col", *(scaled(b, kinds[b]).alias(b) for b in names))
    green, swir, nir, red = (F.col(b) for b in BANDS[:4])
    scene = scene.withColumns({"index": (green - swir) / (green + swir + TINY), "plants": (nir - red) / (nir + red + TINY)})
    if mode == "auto":
        middle, high = exact_quantiles(scene, "index", [0.5, 0.85])
        threshold = (middle + high) / 2 if middle is not None else threshold
    rule = (F.col("index") > threshold) & (F.col("plants") < vegetation) & (nir < infrared) & (green > red)
    if "blue" in names:
        rule &= F.col("blue") < green * (1.1 if kinds["blue"]["unit"] == "L1" else 1.0)
    wide = lambda b: 1.5 if kinds[b]["unit"] == "L1" else 1.0
    deep = (F.col("index") > -0.1) & (nir < DEEP_NIR * wide("green")) & (swir < DEEP_SWIR * wide("swir"))
    share = lambda v, most: F.greatest(F.least(most - v, F.lit(most)), F.lit(0.0)) / most
    chance = 0.45 * F.greatest(F.least((F.col("index") + 1) / 2, F.lit(1.0)), F.lit(0.0)) + 0.30 * share(nir, infrared) + 0.25 * share(F.col("plants"), vegetation)
    mask = (F.coalesce(rule, F.lit(False)) | F.coalesce(deep, F.lit(False))).cast("int")
    known = F.col("index").isNotNull() & F.col("plants").isNotNull()
    return scene.select("row", "col", mask.alias("mask"), F.when(known, F.greatest(F.least(chance, F.lit(1.0)), F.lit(0.0))).alias("probability"))


#: Distance of sure seeds from the threshold; most sure and most hard seeds of a side, least of either for training.
SURE, MOST_SURE, MOST_HARD, LEAST_SURE, LEAST_HARD = 0.45, 12_000, 2_000, 100, 10
#: Regions of water up to this size go.
SMALL = 20
BLOCK, HALO = 256, 5
#: Tasks that trees are trained in: seeds are few.
SEED_PARTS = 4


def guide(green: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    """The index that seeds are taken from: seven parts shadow-proof water extraction, three parts water index."""
    shadow_proof = 4.0 * (green - nir) - (0.25 * swir1 + 2.75 * swir2)
    return 0.7 * shadow_proof + 0.3 * ((green - swir1) / (green + swir1 + 1e-7))


def seeds(index: DataFrame, threshold: float = 0.0) -> DataFrame:
    """index(row, col, guide) with seed: 'water', 'land', 'water?' and 'land?' by distance from the threshold, else null."""
    off = F.col("guide") - threshold
    return index.withColumn("seed", F.when(off > SURE, "water").when(off < -SURE, "land").when(off > 0, "water?").when(off < 0, "land?"))


def _gauss(a: np.ndarray, sigma: float = 1.2) -> np.ndarray:
    half = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    k /= k.sum()
    rows = sum(w * a[:, i : a.shape[1] - 2 * half + i] for i, w in enumerate(k))
    return sum(w * rows[i : rows.shape[0] - 2 * half + i] for i, w in enumerate(k))


def _mean(a: np.ndarray, half: int) -> np.ndarray:
    n = 2 * half + 1
    rows = sum(a[:, i : a.shape[1] - 2 * half + i] for i in range(n))
    return sum(rows[i : rows.shape[0] - 2 * half + i] for i in range(n)) / (n * n)


def stack(pixels: DataFrame, bands: list[str], height: int, width: int, block: int = BLOCK, only: str | None = None) -> DataFrame:
    """(row, col, features): each band itself, its means over 3 x 3 and under a bell, its Laplacian, its deviation over 5 x 5.

    All bands of a block with its halo are worked on at once; the grid mirrors at its edges. only: just the pixels where this column is
    not null, with the column; the others are seen by them alone.
    """
    means = pixels.agg(*(F.avg(F.when(~F.isnan(b), F.col(b))).alias(b) for b in bands)).first()
    means = [means[b] or 0.0 for b in bands]
    sees = lambda at, size: F.sequence(F.greatest(F.floor((F.col(at) - HALO) / block), F.lit(0)), F.least(F.floor((F.col(at) + HALO) / block), F.lit((size - 1) // block)))
    more = [only] if only else []
    sent = pixels.filter("row is not null and col is not null").select("row", "col", *more, *(F.col(b).cast("double").alias(b) for b in bands), F.explode(sees("row", height)).alias("br")).withColumn("bc", F.explode(sees("col", width)))

    def run(part: pa.Table) -> pa.Table:
        row, col = part.column("row").to_numpy(), part.column("col").to_numpy()
        br, bc = part.column("br")[0].as_py(), part.column("bc")[0].as_py()
        r0, c0, r1, c1 = max(br * block - HALO, 0), max(bc * block - HALO, 0), min((br + 1) * block + HALO, height), min((bc + 1) * block + HALO, width)
        pads = [(HALO - (br * block - r0), HALO - (r1 - min((br + 1) * block, height))), (HALO - (bc * block - c0), HALO - (c1 - min((bc + 1) * block, width)))]
        own = (row // block == br) & (col // block == bc)
        for c in more:
            own &= part.column(c).is_valid().to_numpy()
        at, found = (row[own] - br * block, col[own] - bc * block), []
        for band, mean in zip(bands, means, strict=True):
            a = np.full((r1 - r0, c1 - c0), mean)
            values = part.column(band).to_numpy(zero_copy_only=False).astype(float)
            a[row - r0, col - c0] = np.where(np.isfinite(values), values, mean)
            a = np.pad(a, pads, mode="symmetric")
            inner = lambda h, a=a: a[HALO - h : a.shape[0] - HALO + h, HALO - h : a.shape[1] - HALO + h]
            cross = inner(1)
            laplace = cross[:-2, 1:-1] + cross[2:, 1:-1] + cross[1:-1, :-2] + cross[1:-1, 2:] - 4 * cross[1:-1, 1:-1]
            deviation = np.sqrt(np.maximum(_mean(inner(2) ** 2, 2) - _mean(inner(2), 2) ** 2, 0))
            found += [f[at] for f in (inner(0), _mean(inner(1), 1), _gauss(inner(5)), laplace, deviation)]
        values = np.stack(found, axis=1).ravel()
        edges = np.arange(0, len(values) + 1, len(found), dtype=np.int32)
        kept = {c: part.column(c).filter(pa.array(own)) for c in more}
        return pa.table({"row": pa.array(row[own]), "col": pa.array(col[own]), "features": pa.ListArray.from_arrays(pa.array(edges), pa.array(values))} | kept)

    schema = StructType([StructField("row", LongType()), StructField("col", LongType()), StructField("features", ArrayType(DoubleType())), *(sent.schema[c] for c in more)])
    return sent.groupBy("br", "bc").applyInArrow(run, schema)


def training(labelled: DataFrame, least_sure: int = LEAST_SURE) -> DataFrame | None:
    """Balanced seeds (row, col, label, weight) of labelled(row, col, guide, seed); None where a side has fewer than least_sure sure ones.

    At most MOST_SURE sure and MOST_HARD hard seeds of a side, those with the smallest hash of their place.
    """
    count = {r.seed: r["count"] for r in labelled.groupBy("seed").count().collect()}
    sure, hard = (min(count.get(f"water{q}", 0), count.get(f"land{q}", 0), most) for q, most in (("", MOST_SURE), ("?", MOST_HARD)))
    if sure < least_sure:
        return None
    chosen = None
    for kind, n in (("water", sure), ("land", sure), *((("water?", hard), ("land?", hard)) if hard > LEAST_HARD else ())):
        own = labelled.filter(F.col("seed") == kind).orderBy(F.xxhash64("row", "col"), "row", "col").limit(n)
        chosen = own if chosen is None else chosen.unionByName(own)
    return chosen.select("row", "col", F.startswith("seed", F.lit("water")).cast("int").alias("label"), "guide")


def adaptive_water(pixels: DataFrame, columns: dict[str, str], height: int, width: int, threshold: float = 0.0, rounds: int = 20, depth: int = 5, clean: bool = True, least_sure: int = LEAST_SURE) -> DataFrame:
    """(row, col, mask) by gradient-boosted trees trained on what the guide index is sure of, and on its hard cases.

    columns name green, nir, swir1, swir2; other bands of columns are features too. Trees split on order alone, so features
    are not scaled. The mask is closed, its holes filled, small regions removed; with fewer than least_sure sure seeds of a side
    it is the index's own, beyond MOST_SURE always.
    """
    scene = stored(pixels.select("row", "col", *(F.col(c).cast("double").alias(n) for n, c in columns.items())), "water")
    g = guide(*(F.col(c) for c in ("green", "nir", "swir1", "swir2")))
    labelled = stored(seeds(scene.select("row", "col", F.when(~F.isnan(g), g).alias("guide")), threshold), "guide")
    chosen = training(labelled, least_sure)
    if chosen is None:
        return labelled.select("row", "col", F.coalesce((F.col("guide") > threshold).cast("int"), F.lit(0)).alias("mask"))
    weight = F.greatest(F.least(F.abs(F.col("guide") - threshold), F.lit(5.0)), F.lit(0.1))
    chosen = chosen.select("row", "col", F.struct("label", weight.alias("weight")).alias("seed"))  # bounded by MOST_SURE and MOST_HARD
    # Seeds get their features in a pass of their own and are stored: every tree reads them. Trees are trained on an order that
    # does not depend on how pixels were dealt. Features of the whole scene go to the model as they are made.
    train = stored(stack(scene.join(F.broadcast(chosen), ["row", "col"], "left"), list(columns), height, width, only="seed"), "seeds")
    train = train.select("row", "col", "features", "seed.*").repartition(SEED_PARTS, "row", "col").sortWithinPartitions("row", "col")
    vectors = lambda df: df.withColumn("features", array_to_vector(F.col("features")))
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7).fit(vectors(train))
    wet = model.transform(vectors(stack(scene, list(columns), height, width))).select("row", "col", (vector_to_array("probability")[1] > 0.5).cast("int").alias("mask"))
    if not clean:
        return wet
    kept = stored(remove_small(stored(wet, "wet"), SMALL + 1), "kept")
    closed = stored(closing(kept, "mask", height, width), "closed")
    return fill_holes(closed, height, width)
