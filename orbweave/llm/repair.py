"""Conversation structure repair: a run-length min-plus dynamic program over role and fault symbols.

The state is where a conversation stands in `(s?(ua)+)?`: nothing yet, after s, after u, after a. Each row is a symbol (role
initial and fault) with a 4 x 4 matrix of least costs from state to state, insertions before it included; equal consecutive
symbols are one run, advanced by cached binary powers of its matrix in min-plus arithmetic. Rows without their texts are
sorted over the whole table and cut into segments, so one conversation may span many tasks: every segment gives the product of
its runs, products of a conversation's segments are chained (16 numbers for SEGMENT rows), and each segment then unrolls
its choices by itself, blocks of equal choices from a cache. Texts meet the finished audit in one sorted stream that hashes
the repaired conversation; SHA-256 has to take a conversation's text in order, so there one task reads one conversation,
row by row, and keeps the audit and the hash state only.

Defined cases: null roles and texts are one space, also in a null conv_id's or turn's damage key; a null conv_id is one
conversation; null turns come first; rows of one turn are ordered by role, then by the SHA-1 of the text; equal rows of a turn
(repeated, or doubled by damage) are adjacent, and all but the first are duplicates; an empty role has no initial: keeping
it changes no state; a role counts by its first letter, as `(s?(ua)+)?` does; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .workspace import materialize

#: Rows (equal ones counted once) of a segment at most, and the largest power of two whose choices are kept as one string.
SEGMENT, BLOCK = 4096, 12
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
SPACES = " \t\n\x0b\f\r"
#: The state after an inserted or re-roled row, by the state before it; its role; what may end.
NEXT, ROLE, FINAL = (2, 2, 3, 2), {2: "user", 3: "assistant"}, (True, False, False, True)
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {0: 0, 1: 1, 2: 2, 3: 3}}
FINE, TRUNCATED, GONE = 0, 1, 2
Vector = tuple[int, int, int, int]


def _consumed(symbol: tuple[str, int], state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of every way to take a row of this symbol in this state."""
    initial, fault = symbol
    ways = [("D", state, DELETE)]
    if fault != GONE:
        extra = UNFINISHED * (fault == TRUNCATED)
        if (after := KEEP.get(initial, {}).get(state)) is not None:
            ways.append(("K", after, extra))
        ways.append(("R", NEXT[state], REROLE + extra))
    return ways


def _settled(values: list) -> Vector:
    """Costs of the states with insertions taken where they help."""
    out = list(values)
    for _ in range(3):
        out = [min(v, INSERT + out[NEXT[s]]) for s, v in enumerate(out)]
    return tuple(out)


#: What a conversation still costs after its last row, by state.
END = _settled([0 if f else float("inf") for f in FINAL])


@functools.cache
def power(symbol: tuple[str, int], k: int) -> tuple[Vector, ...]:
    """The min-plus matrix of 2**k equal rows: [state before][state after]."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    columns = []
    for after in range(4):
        columns.append(_settled([min((c for _, t, c in _consumed(symbol, s) if t == after), default=float("inf")) for s in range(4)]))
    return tuple(zip(*columns, strict=True))


def product(x: tuple[Vector, ...], y: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(row[m] + y[m][t] for m in range(4)) for t in range(4)) for row in x)


def before(x: tuple[Vector, ...], v: Vector) -> Vector:
    """Costs to go before a matrix, from those after it."""
    return tuple(min(row[t] + v[t] for t in range(4)) for row in x)


def _binary(n: int) -> list[int]:
    """Powers of two in n, the largest first."""
    return [k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def advance(runs: list[tuple[tuple[str, int], int]]) -> tuple[Vector, ...]:
    """The matrix of all runs in order."""
    total = tuple(tuple(0 if s == t else float("inf") for t in range(4)) for s in range(4))
    for symbol, n in runs:
        for k in _binary(n):
            total = product(total, power(symbol, k))
    return total


@functools.lru_cache(maxsize=4096)
def _letters(symbol: tuple[str, int], k: int, state: int, after: Vector) -> tuple[str, int, int]:
    """(letters, state after, cost) of the cheapest, then ASCII-least way through 2**k equal rows; after: costs to go then."""
    if k:
        middle = before(power(symbol, k - 1), after)
        least = min(middle)
        one, state, first = _letters(symbol, k - 1, state, tuple(x - least for x in middle))
        two, state, second = _letters(symbol, k - 1, state, after)
        return one + two, state, first + second
    letters, cost, here = "", 0, before(power(symbol, 0), after)
    while True:
        ways = [(c + after[t], letter, t, c) for letter, t, c in _consumed(symbol, state)] + [(INSERT + here[NEXT[state]], "I", NEXT[state], INSERT)]
        _, letter, state, c = min(ways)
        letters, cost = letters + letter, cost + c
        if letter != "I":
            return letters, state, cost


def unroll(runs: list[tuple[tuple[str, int], int]], state: int, after: Vector, last: bool) -> tuple[str, int, int]:
    """(letters, state after, cost) of a segment that is entered in a state and leaves costs to go after it."""
    parts = [(symbol, min(k, BLOCK)) for symbol, n in runs for k in _binary(n) for _ in range(1 << max(0, k - BLOCK))]
    ends = [after]
    for symbol, k in reversed(parts):
        v = before(power(symbol, k), ends[-1])
        least = min(v)
        ends.append(tuple(x - least for x in v))
    out, cost = [], 0
    for (symbol, k), v in zip(parts, ends[-2::-1], strict=True):
        letters, state, c = _letters(symbol, k, state, tuple(x - min(v) for x in v))
        out.append(letters)
        cost += c
    while last and not FINAL[state]:
        state, cost = NEXT[state], cost + INSERT
        out.append("I")
    return "".join(out), state, cost


def damage(turns: DataFrame) -> DataFrame:
    """Rows of turns(conv_id, turn, role, text) after the damage, with `copies` adjacent copies each."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _legal(x: str, y: str) -> bool:
    return x + y in ("su", "ua", "au")


def _segments(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, initial, n, fault, rest) as segments of at most so many: runs of equal symbols and their matrix."""
    out: list[dict] = []
    place = TaskContext.get().partitionId() << 32
    current: dict | None = None

    def close() -> None:
        matrix = advance(list(zip(zip(current["symbols"], current["faults"], strict=True), current["counts"], strict=True)))
        out.append({k: v for k, v in current.items() if k != "rows"} | {"matrix": [None if x == float("inf") else x for row in matrix for x in row]})

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(out, SEGMENTS)
        out.clear()
        return batch

    for batch in batches:
        for conv, initial, n, fault, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or conv != current["conv_id"] or current["rows"] >= size:
                if current is not None:
                    close()
                place += 1
                current = {"conv_id": conv, "place": place, "first": initial, "final": None, "illegal": 0, "symbols": [], "faults": [], "counts": [], "rows": 0}
            elif not _legal(current["final"], initial):
                current["illegal"] += 1
            for kind, many in ((fault, 1), (rest, n - 1)):
                if many and current["symbols"][-1:] == [initial] and current["faults"][-1] == kind:
                    current["counts"][-1] += many
                elif many:
                    for column, x in (("symbols", initial), ("faults", kind), ("counts", many)):
                        current[column].append(x)
            current["illegal"] += n - 1  # equal initials never follow each other
            current["final"] = initial
            current["rows"] += 1
        if len(out) >= 1024:
            yield made()
    if current is not None:
        close()
    yield made()


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("first", pa.string()), ("final", pa.string()), ("illegal", pa.int64()), ("symbols", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64()))])


def _chain(rows: pa.Table) -> pa.Table:
    """Costs to go after each of a conversation's segments, and whether its border with the one before is illegal."""
    rows = rows.sort_by("place")
    ends = [END]
    for m in reversed(rows.column("matrix").to_pylist()[1:]):
        v = before([tuple(float("inf") if x is None else x for x in m[i : i + 4]) for i in range(0, 16, 4)], ends[-1])
        ends.append(tuple(x - min(v) for x in v))
    firsts, finals = rows.column("first").to_pylist(), rows.column("final").to_pylist()
    border = [0] + [int(not _legal(a, b)) for a, b in zip(finals[:-1], firsts[1:], strict=True)]
    number = list(range(len(border)))
    return pa.table({"conv": rows.column("conv_id"), "at": rows.column("place"), "after": pa.array([list(e) for e in ends[::-1]], pa.list_(pa.int64())), "border": pa.array(border, pa.int64()), "nth": pa.array(number, pa.int64()), "last": pa.array([i == number[-1] for i in number])})


def _unroller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment and state in which it may be entered (a conversation's first: only state 0): letters, state after, cost."""
    for batch in batches:
        found: dict[str, list] = {"letters": [], "exits": [], "costs": []}
        for symbols, faults, counts, after, nth, last in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
            runs = list(zip(zip(symbols, faults, strict=True), counts, strict=True))
            ways = [unroll(runs, state, tuple(after) if after else END, last is not False) for state in range(4 if nth else 1)]
            for column, x in zip(found.values(), zip(*ways, strict=True), strict=True):
                column.append(list(x))
        kinds = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, k) for x, k in zip(found.values(), kinds, strict=True))], names=["conv_id", "place", "illegal", *found])


class _Repaired:
    """The repaired text of one conversation as it comes: its audit, then its rows in order."""

    def __init__(self) -> None:
        self.letters, self.state, self.cost, self.illegal = [], 0, 0, 0
        self.ahead: Iterator[str] | None = None
        self.hash, self.lines = hashlib.sha256(), 0

    def piece(self, letters: list[str], exits: list[int], costs: list[int], illegal: int) -> None:
        self.letters.append(letters[self.state])
        self.cost, self.illegal, self.state = self.cost + costs[self.state], self.illegal + illegal, exits[self.state]

    def _line(self, role: str, text: str) -> None:
        self.hash.update((chr(10) * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1

    def row(self, role: str, text: str, copies: int) -> None:
        if self.ahead is None:
            self.ahead, self.state = (letter for piece in self.letters for letter in piece), 0
        for _ in range(copies):
            while (letter := next(self.ahead)) == "I":
                self.state = NEXT[self.state]
                self._line(ROLE[self.state], "")
            if letter == "K":
                self.state = KEEP[role[:1]][self.state]
                self._line(role, text)
            elif letter == "R":
                self.state = NEXT[self.state]
                self._line(ROLE[self.state], text)

    def result(self) -> tuple[str, int, int, str]:
        for _ in self.ahead or ():  # what is inserted after the last row
            self.state = NEXT[self.state]
            self._line(ROLE[self.state], "")
        return "".join(self.letters), self.cost, self.illegal, self.hash.hexdigest()


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces and rows of conversations as (conv_id, audit, cost, illegal, repaired_sha256)."""
    out: list[tuple] = []
    conv, current = None, None

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "audit", "cost", "illegal", "repaired_sha256"])

    for batch in batches:
        for key, letters, exits, costs, illegal, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or key != conv:
                if current is not None:
                    out.append((conv, *current.result()))
                conv, current = key, _Repaired()
            if letters is not None:
                current.piece(letters, exits, costs, illegal)
            else:
                current.row(role, text, copies)
        if len(out) >= 1024:
            yield made()
    if current is not None:
        out.append((conv, *current.result()))
    yield made()


def repair_conversations(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation of turns(conv_id, turn, role, text), damaged first: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damage(turns).withColumn("digest", F.unhex(F.sha1("text")))
    bare = F.rtrim("text", F.lit(SPACES))
    kind = F.when(bare == "", "blank").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "fine").otherwise("truncated")
    light = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.min(kind).alias("kind"))
    light = materialize(light, "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("earliest")).toDF("conv", "who", "what", "earliest")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("who")) & (F.col("digest") == F.col("what"))
    light = light.join(firsts, same).withColumn("again", ~F.col("earliest").eqNullSafe(place))
    blank = F.col("kind") == "blank"
    fault = F.when(blank | F.col("again"), GONE).when(F.col("kind") == "truncated", TRUNCATED).otherwise(FINE)
    light = light.select("conv_id", "turn", "role", "digest", "n", "kind", "again", fault.alias("fault"))
    light = materialize(light, "repair-symbols")
    # One total order over the whole table: a long conversation lies in many partitions.
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    lined = light.repartitionByRange(*order).sortWithinPartitions(*order)
    lined = lined.select("conv_id", F.left("role", F.lit(1)).alias("initial"), "n", "fault", F.lit(GONE).alias("rest"))
    segments = materialize(lined.mapInArrow(functools.partial(_segments, segment), "conv_id long, place long, first string, final string, illegal long, symbols array<string>, faults array<int>, counts array<long>, matrix array<long>"), "repair-segments")
    several = segments.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select(F.col("conv_id").alias("conv"))
    small = segments.select("conv_id", "place", "first", "final", "matrix").join(several, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    chained = small.groupBy("conv_id").applyInArrow(_chain, "conv long, at long, after array<long>, border long, nth long, last boolean")
    pieces = segments.join(chained, F.col("place") == F.col("at"), "left")
    pieces = pieces.select("conv_id", "place", (F.col("illegal") + F.coalesce("border", F.lit(0))).alias("illegal"), "symbols", "faults", "counts", "after", "nth", "last")
    pieces = pieces.mapInArrow(_unroller, "conv_id long, place long, illegal long, letters array<string>, exits array<int>, costs array<long>")
    # Pieces of the audit come first, then the rows in the same order as above.
    stream = pieces.withColumnRenamed("place", "turn").withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"))
    repaired = stream.select("conv_id", "letters", "exits", "costs", "illegal", "role", "text", "copies").mapInArrow(_hasher, "conv_id long, audit string, cost long, illegal long, repaired_sha256 string")
    # Sums of a conversation, and every conversation there was before the damage.
    by_turn = light.groupBy("conv_id", "turn").agg(
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(blank, 0).otherwise(F.col("n") - F.when(F.col("again"), 0).otherwise(1))).alias("duplicate"),
        F.sum((F.col("fault") == TRUNCATED).cast("long")).alias("truncated"),
    )
    sums = by_turn.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))
    parts = turns.select(F.col("conv_id").cast("long")).distinct().unionByName(sums, allowMissingColumns=True).unionByName(repaired, allowMissingColumns=True)
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(none.get(c, 0))).alias(c) for c in columns))
