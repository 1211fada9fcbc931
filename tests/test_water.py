"""Water masks: units, quantiles, seeds, and trees that must agree with what was held out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import focal, water
from orbweave.operators.stats import exact_quantiles

COLUMNS = {"green": "g", "nir": "n", "swir1": "s", "swir2": "t"}


def scene(spark, noise=0.02, size=48):
    """A lake in the left half with an island, a puddle and a pier in the right; shores are mixed."""
    rng = np.random.default_rng(3)
    wet = np.zeros((size, size), bool)
    wet[:, : size // 2] = True
    wet[10:16, 8:14] = False
    wet[30:33, 40:43] = True
    rows = []
    for r in range(size):
        for c in range(size):
            shore = abs(c - size // 2) <= 1
            w = 0.5 if shore else float(wet[r, c])
            v = [0.05 + 0.25 * w, 0.35 - 0.33 * w, 0.3 - 0.28 * w, 0.25 - 0.24 * w]
            rows.append((r, c, *(float(max(1e-3, x + rng.normal(0, noise))) for x in v)))
    return spark.createDataFrame(rows, "row long, col long, g double, n double, s double, t double"), wet


def test_trained_water_agrees_with_what_was_held_out(spark):
    pixels, wet = scene(spark)
    index = pixels.select("row", "col", water.guide(F.col("g"), F.col("n"), F.col("s"), F.col("t")).alias("guide"))
    labelled = water.seeds(index)
    assert {"water", "land"} <= {r.seed for r in labelled.select("seed").distinct().collect()}
    held = labelled.filter("seed in ('water', 'land') and (row * 7 + col) % 3 = 0")
    train = labelled.filter("(row * 7 + col) % 3 <> 0")
    chosen = water.training(train)
    count = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    assert count[0] == count[1] >= water.LEAST_SURE
    found = water.adaptive_water(pixels, COLUMNS, 48, 48, rounds=5, depth=3, clean=False)
    right = held.join(found, ["row", "col"]).select(F.avg((F.col("mask") == (F.col("seed") == "water").cast("int")).cast("double"))).first()[0]
    assert right > 0.97
    clean = {(r.row, r.col): r["mask"] for r in water.adaptive_water(pixels, COLUMNS, 48, 48, rounds=5, depth=3).collect()}
    assert clean[31, 41] == 0  # nine pixels are no water body
    assert clean[13, 11] == 1  # an island is filled as a hole
    inner = [(r, c) for r in range(3, 45) for c in (*range(3, 21), *range(28, 45)) if not (8 <= r < 18 and 6 <= c < 16)]
    assert np.mean([clean[at] == (at[1] < 24) for at in inner]) > 0.98


def test_rules_read_their_input_once(spark):
    """Whatever a pixel costs to make, units, darkest percents and the threshold of the scene are found from what was stored."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pixels = spark.range(400).selectExpr("id div 20 as row", "id % 20 as col", *(f"double((id * {p}) % 397 * 50 + 5000) as {b}" for p, b in ((7, "g"), (11, "s"), (13, "n"), (17, "r"), (19, "b"))))
    pixels = pixels.mapInArrow(count, pixels.schema)
    columns = {"green": "g", "swir": "s", "nir": "n", "red": "r", "blue": "b"}
    assert water.rule_water(pixels, columns, "auto").count() == 400 and made.value == 400
    kinds = water.units(spark.createDataFrame([(0, i, float(i), 13_000.0 + i) for i in range(101)], "row int, col int, green double, swir double"), ("green", "swir"))
    assert (kinds["green"]["unit"], kinds["green"]["dark"], kinds["swir"]["unit"], kinds["swir"]["dark"]) == ("8bit", None, "L1", 13_001.0)


def test_too_few_seeds_fall_back(spark):
    pixels, _ = scene(spark, size=8)
    odd = pixels.unionByName(spark.createDataFrame([(9, 9, None, 0.1, 0.1, 0.1), (9, 10, float("nan"), 0.1, 0.1, 0.1)], pixels.schema))
    got = {(r.row, r.col): r["mask"] for r in water.adaptive_water(odd, COLUMNS, 11, 11).collect()}
    assert len(got) == 66 and (got[9, 9], got[9, 10]) == (0, 0) and got[0, 0] == 1 and got[0, 7] == 0
    assert water.adaptive_water(pixels.limit(0), COLUMNS, 8, 8).count() == 0


def test_feature_stack_of_a_plane(spark):
    df = spark.createDataFrame([(r, c, float(2 * c + r)) for r in range(24) for c in range(24)], "row long, col long, v double")
    for block in (7, 256):
        got = {(r.row, r.col): r.features for r in water.stack(df, ["v"], 24, 24, block).collect()}
        assert len(got) == 576
        for r in range(6, 18):
            for c in range(6, 18):
                own, near, bell, laplace, spread = got[r, c]
                assert own == near == pytest.approx(2 * c + r) and bell == pytest.approx(2 * c + r) and laplace == pytest.approx(0, abs=1e-9) and spread == pytest.approx(math.sqrt(10))


def test_units_are_decided_from_the_bands(spark):
    base = np.random.default_rng(1).uniform(0.01, 0.6, (400, 5))
    for unit, make in {"norm": lambda x: x, "8bit": lambda x: np.round(x * 250), "L2": lambda x: np.round(x * 4000) + 100, "L1": lambda x: np.round(x * 30000) + 3000, "unknown": lambda x: np.round(x * 8000) + 3100}.items():
        rows = [(0, i, *(float(v) for v in make(x))) for i, x in enumerate(base)] + [(1, 0, 0.0, None, float("nan"), 70000.0, 1.0)]
        df = spark.createDataFrame(rows, "row long, col long, a double, b double, c double, d double, e double")
        valid = df.filter("row = 0").select(*(F.col(x).alias(n) for x, n in zip("abcde", water.BANDS)))
        assert {u["unit"] for u in water.units(valid).values()} == {unit}
        got = water.rule_water(df, dict(zip(water.BANDS, "abcde"))).filter("row = 1").first()
        assert got["mask"] == 0 and got.probability is None
    with pytest.raises(ValueError):
        water.rule_water(df, {"green": "a", "swir": "b", "nir": "c"})
    with pytest.raises(ValueError):
        water.rule_water(df, dict(zip(water.BANDS, "abcde")), "magic")


def test_features_of_the_whole_scene_are_not_stored(spark, monkeypatch):
    """Trees are trained on stored seeds; the scene's features go to the model as they are made."""
    pixels, _ = scene(spark)
    names = []
    monkeypatch.setattr(water, "stored", lambda df, name, do=water.stored: names.append((name, [c for c in df.columns if c == "features"], df.count())) or do(df, name))
    water.adaptive_water(pixels, COLUMNS, 48, 48, rounds=2, depth=2, clean=False).count()
    wide = [x for x in names if x[1]]
    assert [x[0] for x in wide] == ["seeds"] and water.LEAST_SURE * 2 <= wide[0][2] < 48 * 48


def test_features_of_some_pixels_are_those_of_the_whole_stack(spark):
    pixels, _ = scene(spark, size=24)
    marked = pixels.withColumn("mark", F.when(F.expr("(row * 5 + col) % 7 = 0"), F.struct(F.col("row").alias("a"), F.lit("x").alias("b"))))
    every = {(r.row, r.col): r.features for r in water.stack(pixels, ["g", "n"], 24, 24, 7).collect()}
    some = water.stack(marked, ["g", "n"], 24, 24, 7, only="mark").collect()
    assert {(r.row, r.col): r.features for r in some} == {at: v for at, v in every.items() if (at[0] * 5 + at[1]) % 7 == 0}
    assert len(some) == len({(r.row, r.col) for r in some}) and all(r.mark.a == r.row and r.mark.b == "x" for r in some)


def test_closing_is_dilation_then_erosion(spark):
    rng = np.random.default_rng(5)
    rows = [(r, c, int(rng.random() < 0.3)) for r in range(19) for c in range(23) if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "row long, col long, mask int")
    want = focal.erode(focal.dilate(df, "mask"), "mask", 19, 23)
    assert want.filter("mask = 1").count() > 20
    for block in (5, 256):
        got = focal.closing(df, "mask", 19, 23, block)
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=5001), np.repeat([1.0, 2.0, 5.0], [300, 1, 700]), np.array([3.0]), np.concatenate((rng.normal(size=2000) * 1e-9, [1e12]))):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
        shares = [0.0, 0.01, 0.5, 0.85, 0.999, 1.0]
        for small in (1 << 16, 1):
            assert exact_quantiles(df, "v", shares, 16, small) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12, abs=1e-18)
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_fallback_does_not_depend_on_how_many_seeds_there_are(spark):
    pixels, _ = scene(spark)
    index = pixels.select("row", "col", (water.guide(F.col("g"), F.col("n"), F.col("s"), F.col("t")) > 0).cast("int").alias("mask"))
    found = water.adaptive_water(pixels, COLUMNS, 48, 48, least_sure=water.MOST_SURE + 1)
    assert found.count() == 48 * 48 and found.exceptAll(index).count() == 0
