"""Best-fit packing: a configuration linear program over the length histogram, multiplicative weights, rounding.

Documents longer than a sequence are cut; only the histogram of piece lengths (at most `size` numbers) goes to the
driver. A configuration is a multiset of lengths that fits one sequence. Multiplicative weights price the lengths, and a
knapsack dynamic program over token counts finds the best configurations at those prices, for every length that is covered
least. The cover is rounded by fixing: the longest length left takes its best configuration at the final prices, as often as
whole counts allow; short lengths are filled up best-fit, again counted by length. Never more sequences than best-fit
alone. Pieces then find their sequence by their rank among the pieces of their length, which Spark counts in salted
groups, so that a very common length is never gathered.

Defined cases: a null or empty text is its end token alone; equal lengths are ranked by salt and order inside a task,
any such ranking being as good; repeated rows are packed once each; a null doc_id is packed like others; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .subwords import byte_bpe, default_tokenizer
from .textscan import slices, text_bytes
from .workspace import materialize

#: Pricing rounds of the linear program, the step of its weights, and sequences after which rounding prices what is left anew.
ROUNDS, STEP, REPRICE = 120, 0.25, 8
#: Exponents by which prices of long pieces are raised, and shares of a sequence below which pieces are left to best-fit.
TILTS, LEAVE = (0.1, 0.3), (0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.0)
#: Pieces of one length that share a salt, about.
SALT_ROWS = 100_000


def _cutter(path: str, size: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch, column in slices(batches, 1):
            rows: list[list] = [[], [], [], [], []]
            for owner, text in zip(batch.column(0).to_pylist(), text_bytes(column), strict=True):
                ids = np.append(bpe.encode(text.decode()), np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for out, x in zip(rows, (owner, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, size: int = 1024, end: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32. The first piece may be shorter."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_cutter(tokenizer or default_tokenizer(), size, end), "doc_id long, piece long, start long, length long, ids_crc32 long")


def knapsack(price: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Highest total price of lengths that fit into 0..size tokens together, each as often as one likes."""
    best = np.zeros(size + 1)
    for room in range(1, size + 1):
        k = int(np.searchsorted(lengths, room, "right"))
        best[room] = max(best[room - 1], (best[room - lengths[:k]] + price[:k]).max() if k else 0.0)
    return best


def filled(first: int, best: np.ndarray, price: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A configuration around one length: (places of lengths, how often each), along the best prices as far as pieces last."""
    left, room, chosen = counts.copy(), size - int(lengths[first]), {first: 1}
    left[first] -= 1
    while (k := int(np.searchsorted(lengths, room, "right"))) > 0:
        value = np.where(left[:k] > 0, best[room - lengths[:k]] + price[:k], -1.0)
        i = int(value.argmax())
        if value[i] <= 0:
            break
        chosen[i] = chosen.get(i, 0) + 1
        left[i] -= 1
        room -= int(lengths[i])
    return np.fromiter(chosen, np.int64), np.fromiter(chosen.values(), np.int64)


def prices(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(best prices, last prices, bound) of the covering program by multiplicative weights.

    In a round the knapsack prices all configurations, and the lengths covered least get one each (so every length is covered
    again and again); weights fall as their lengths are covered. Weights over the best configuration's price are a
    feasible dual, so the counts at these prices are a lower bound of the sequences; the best bound is kept.
    """
    weight, covered, total = lengths / size, np.zeros(len(lengths)), np.zeros(len(lengths))
    kept, bound = weight, -1.0
    for _ in range(ROUNDS):
        best = knapsack(weight, lengths, size)
        dual = weight / best[size]
        total += dual
        if dual @ counts > bound:
            kept, bound = dual, float(dual @ counts)
        gain = np.zeros(len(lengths))
        for i in np.argsort(covered, kind="stable")[: max(8, len(lengths) // 12)].tolist():
            at, n = filled(i, best, weight, lengths, counts, size)
            gain[at] += (counts[at] / n).min() * n / counts[at]
        covered += gain
        weight = weight * np.exp(-STEP * gain / gain.max())
        weight = np.maximum(weight / weight.max(), 1e-6)
    mean = total / knapsack(total, lengths, size)[size]
    return (mean, weight, float(mean @ counts)) if mean @ counts > bound else (kept, weight, bound)


def rounded(price: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int, leave: float) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole sequences from the program: the longest piece left with its best configuration, as often as the counts allow, down to
    pieces of size * leave tokens. counts is left with what remains."""
    plan, best, turn = [], None, 0
    while len(act := np.flatnonzero(counts)) and lengths[act[-1]] > leave * size:
        if turn % REPRICE == 0:
            best = knapsack(price[act], lengths[act], size)
        turn += 1
        at, n = filled(len(act) - 1, best, price[act], lengths[act], counts[act], size)
        at = act[at]
        times = int((counts[at] // n).min())
        counts[at] -= times * n
        plan.append((sorted(zip(lengths[at].tolist(), n.tolist(), strict=True)), times))
    return plan


def program(histogram: dict[int, int], size: int) -> tuple[list, list, float]:
    """(sequences from the program, sequences by best-fit for what it leaves, lower bound): the fewest in all, then the most from the program.

    Long pieces are priced and filled first, which is where a bad partner costs a sequence; short ones go best-fit.
    Best-fit alone is one of the plans compared, so the result never has more sequences than it.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    kept, last, bound = prices(lengths, counts, size)
    found: list[tuple[list, list]] = [([], best_fit(dict(histogram), size))]
    # Prices of long pieces are raised a little: of equally full configurations those with fewer short pieces go first.
    for price in (last, kept, *(kept * (lengths / size) ** tilt for tilt in TILTS)):
        rest, made = counts.copy(), []
        for leave in LEAVE:
            made = made + rounded(price, lengths, rest, size, leave)
            found.append((made, best_fit({int(x): int(n) for x, n in zip(lengths, rest, strict=True) if n}, size)))
    of = lambda plan: sum(n for _, n in plan)
    best = min(found, key=lambda p: (of(p[0]) + of(p[1]), of(p[1])))
    return *best, bound


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths with their number in one sequence, number of such sequences)] that hold every piece once."""
    plan, left = [], dict(histogram)
    if left.get(size):
        plan.append(([(size, 1)], left.pop(size)))
    if left:
        made, rest, _ = program(left, size)
        plan += made + rest
    return plan


def best_fit(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest pieces first, each sequence filled by the longest that still fits; equal sequences are made together."""
    plan, keys = [], sorted(counts)
    while keys:
        room, chosen = size, {}
        while room > 0 and (k := bisect.bisect_right(keys, room)):
            x = keys[k - 1]
            if (free := counts[x] - chosen.get(x, 0)) <= 0:
                lower = next((y for y in reversed(keys[: k - 1]) if counts[y] > chosen.get(y, 0)), None)
                if lower is None:
                    break
                x, free = lower, counts[lower] - chosen.get(lower, 0)
            n = min(free, room // x)
            chosen[x] = chosen.get(x, 0) + n
            room -= n * x
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
        keys = [x for x in keys if counts[x]]
        plan.append((sorted(chosen.items()), times))
    return plan


def _placer(plan: list, salts: int) -> Callable:
    """Ranks of a length fall into ranges of sequences that are filled alike."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for content, times in plan:
        offset = 0
        for length, n in content:
            start = taken.get(length, 0)
            ranges.setdefault(length, []).append((start, sequence, n, offset))
            taken[length] = start + n * times
            offset += n * length
        sequence += times
    tables = {x: np.array(r, np.int64) for x, r in ranges.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                t = tables[x]
                t = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                nth = rank[own] - t[:, 0]
                where[own] = t[:, 1] + nth // t[:, 2]
                offset[own] = t[:, 3] + nth % t[:, 2] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(where), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, size: int = 1024, end: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut_documents(docs, size, end, tokenizer), "pieces")
    total = pieces.count()
    salts = max(64, -(-total // SALT_ROWS))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    groups = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    plan = pack_histogram(histogram, size)
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("nth", F.row_number().over(inside) - 1).join(groups, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placer(plan, salts), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
