"""Graphs on the grid: flow, watersheds, components, holes. Flow is pointer jumping, O(log length) joins; components are labelled in
blocks, whose border pairs are then contracted by star rounds. Each round ends in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .focal import with_neighbours
from .graph import numbered, stored
from .regions import labelled

#: D8 neighbours in the order that wins ties: name -> (row, col, code).
D8 = {"e": (0, 1, 1), "se": (1, 1, 2), "s": (1, 0, 4), "sw": (1, -1, 8), "w": (0, -1, 16), "nw": (-1, -1, 32), "n": (-1, 0, 64), "ne": (-1, 1, 128)}


def d8_flow(dem: DataFrame, value: str = "z", cell: float = 1.0) -> DataFrame:
    """Code of the steepest drop (0: none) and the receiver's place; drops are compared in single precision."""
    n = with_neighbours(dem, value, {k: (r, c) for k, (r, c, _) in D8.items()})
    options = [
        F.struct(((F.col(value) - F.col(k)) / (cell * (2**0.5 if r and c else 1.0))).cast("float").alias("drop"), F.lit(-i).alias("rank"), F.lit(code).alias("code"), F.lit(r).alias("dr"), F.lit(c).alias("dc"))
        for i, (k, (r, c, code)) in enumerate(D8.items())
    ]
    best = F.array_max(F.filter(F.array(*options), lambda x: x["drop"] > 0))
    return n.select("row", "col", F.coalesce(best["code"], F.lit(0)).alias("code"), (F.col("row") + F.coalesce(best["dr"], F.lit(0))).alias("to_row"), (F.col("col") + F.coalesce(best["dc"], F.lit(0))).alias("to_col"))


def _keyed(flow: DataFrame) -> DataFrame:
    return flow.select(F.struct("row", "col").alias("v"), F.struct(F.col("to_row").alias("row"), F.col("to_col").alias("col")).alias("to"))


def flow_accumulation(flow: DataFrame) -> DataFrame:
    """Cells upstream of each cell, itself included: sums are passed along jumps of doubling length."""
    state = stored(_keyed(flow).select("v", F.when(F.col("to") != F.col("v"), F.col("to")).alias("to"), F.lit(1).cast("long").alias("acc")), "flow")
    while not state.filter("to is not null").isEmpty():
        gained = state.filter("to is not null").groupBy(F.col("to").alias("v")).agg(F.sum("acc").alias("more"))
        onward = state.select(F.col("v").alias("to"), F.col("to").alias("next"))
        state = stored(state.join(gained, "v", "left").join(onward, "to", "left").select("v", F.col("next").alias("to"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")), "flow")
    return state.select("v.row", "v.col", F.col("acc").alias("accumulation"))


def watershed(flow: DataFrame) -> DataFrame:
    """Outlet of each cell, and its basin's number by first cell in row order."""
    state = stored(_keyed(flow), "basin")
    while True:
        onward = state.select(F.col("v").alias("to"), F.col("to").alias("next"))
        state = stored(state.join(onward, "to").select("v", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "basin")
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    first = state.groupBy("to").agg(F.min("v").alias("first"))
    return state.join(numbered(first, "first", "basin"), "to").select("v.row", "v.col", F.col("basin").cast("int").alias("basin"))


def components(cells: DataFrame, value: str | None = None) -> DataFrame:
    """4-connected components of cells (of equal value, where one is named): label = first cell in row order."""
    named = labelled(cells, value)
    own = [F.col("value").cast(dict(cells.dtypes)[value]).alias(value)] if value else []
    return named.select("row", "col", *own, F.shiftright("label", 32).alias("label_row"), F.col("label").bitwiseAND((1 << 32) - 1).alias("label_col"))


def fill_holes(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Background that does not touch the border becomes foreground (dense mask 0/1)."""
    c = components(mask.filter("mask = 0").select("row", "col"))
    border = (F.col("row") == 0) | (F.col("row") == height - 1) | (F.col("col") == 0) | (F.col("col") == width - 1)
    outside = c.filter(border).select("label_row", "label_col").distinct()
    holes = c.join(outside, ["label_row", "label_col"], "left_anti").select("row", "col", F.lit(1).alias("hole"))
    return mask.join(holes, ["row", "col"], "left").select("row", "col", F.coalesce("hole", "mask").alias("mask"))


def remove_small(mask: DataFrame, least: int) -> DataFrame:
    """Foreground components below a size become background."""
    c = components(mask.filter("mask = 1").select("row", "col"))
    small = c.groupBy("label_row", "label_col").count().filter(F.col("count") < least)
    gone = c.join(small, ["label_row", "label_col"]).select("row", "col", F.lit(0).alias("gone"))
    return mask.join(gone, ["row", "col"], "left").select("row", "col", F.coalesce("gone", "mask").alias("mask"))


def boundary_edges(cells: DataFrame, value: str) -> DataFrame:
    """Unit edges between a region and what is not of it: the four sides of cells whose neighbour has another value."""
    n = with_neighbours(cells, value, {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)})
    sides = F.array(*(F.when(F.col(s).isNull() | (F.col(s) != F.col(value)), F.lit(s)) for s in ("up", "down", "left", "right")))
    return n.select("row", "col", value, F.explode(F.array_compact(sides)).alias("side"))
