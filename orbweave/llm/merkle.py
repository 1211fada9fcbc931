"""Document fingerprints: a Merkle tree over sections and paragraphs, with a sketch of clauses for likeness.

A paragraph is a line with its end; its node hashes the whole line. A section ends at a blank line or at a paragraph
whose hash says so, so edits move no other section's bounds. A section hashes its paragraphs, the root its sections:
equal roots mean equal texts, and where roots differ, the differing branches lead to the edited paragraphs. Under each
paragraph stand short hashes of its clauses. The likeness of two fingerprints descends both trees: equal roots are alike
(1), equal sections have all their clauses in common, then equal paragraphs of the other sections, and only under
paragraphs that differ are clauses held against each other; the share of clauses in common is the likeness (Dice, with
multiplicity). Nodes are shown with 64 bits, roots with 128.

Defined cases: null counts as empty text, whose tree has no branch; two empty texts are alike (1), an empty and a
non-empty one are not (0); equal doc_ids are ordered by text; a null doc_id comes after all others; other columns are
ignored; the only document of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from .textscan import text_bytes

#: A clause: up to so many characters to the next sentence end (the end and white space after it belong to it).
_CLAUSE = re.compile(r"[^.!?]{1,40}[.!?]*\s*|[.!?]+\s*")
#: Hex digits of a node and of a clause.
NODE, CLAUSE = 16, 8
#: One in so many paragraphs ends a section.
SECTION_ODDS = 8
#: Rows that a task takes in a walk in order of doc_id, about.
RANGE_ROWS = 20_000
_FIRST = -(1 << 63)


def fingerprint(text: str) -> str:
    """root|section=paragraph:clauses,paragraph:clauses;section=... (hex; NODE digits a node, CLAUSE a clause)."""
    top, parts, nodes, shown = hashlib.blake2b(digest_size=16), [], hashlib.blake2b(digest_size=16), []
    crc = zlib.crc32
    for line in text.splitlines(keepends=True) if text else ():
        node = hashlib.blake2b(line.encode(), digest_size=16)
        nodes.update(node.digest())
        shown.append(node.hexdigest()[:NODE] + ":" + b"".join([crc(c.encode()).to_bytes(4, "big") for c in _CLAUSE.findall(line)]).hex())
        if node.digest()[0] % SECTION_ODDS == 0 or not line.strip():
            top.update(nodes.digest())
            parts.append(nodes.hexdigest()[:NODE] + "=" + ",".join(shown))
            nodes, shown = hashlib.blake2b(digest_size=16), []
    if shown:
        top.update(nodes.digest())
        parts.append(nodes.hexdigest()[:NODE] + "=" + ",".join(shown))
    return top.hexdigest() + "|" + ";".join(parts)


def sections(print_: str) -> list[str]:
    return [s for s in print_[33:].split(";") if s]


def paragraphs(section: str) -> list[str]:
    return section[NODE + 1 :].split(",")


def _size(section: str) -> int:
    """Clauses under a section, told from its length."""
    n = section.count(",") + 1
    return (len(section) - (NODE + 1) * (n + 1) - (n - 1)) // CLAUSE


def _apart(x: list[str], y: list[str]) -> tuple[list[str], list[str]]:
    """Branches of either side whose node the other has not, with multiplicity."""
    shared = Counter(s[:NODE] for s in x) & Counter(s[:NODE] for s in y)
    if not shared:
        return x, y
    left = []
    for side in (x, y):
        spare, own = shared.copy(), []
        for branch in side:
            if spare[branch[:NODE]]:
                spare[branch[:NODE]] -= 1
            else:
                own.append(branch)
        left.append(own)
    return left[0], left[1]


def _leaves(side: list[str]) -> Counter:
    found: Counter = Counter()
    for p in side:
        found.update([p[i : i + CLAUSE] for i in range(NODE + 1, len(p), CLAUSE)])
    return found


def likeness(a: str, b: str) -> float:
    """Share of common clauses of two fingerprints, 0 to 1, read only under branches that differ."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = sections(a), sections(b)
    total_x, total_y = sum(map(_size, x)), sum(map(_size, y))
    x, y = _apart(x, y)
    x, y = _apart([p for s in x for p in paragraphs(s)], [p for s in y for p in paragraphs(s)])
    own, other = _leaves(x), _leaves(y)
    both = total_x - own.total() + sum(min(n, other[c]) for c, n in own.items() if c in other)
    return 2 * both / max(1, total_x + total_y)


def differing_paragraphs(a: str, b: str) -> list[int]:
    """Numbers (from 0) of the paragraphs of b that a has not, found by descending only into sections that differ."""
    have, out, number = {s[:NODE] for s in sections(a)}, [], 0
    known = {p[:NODE] for s in sections(a) for p in paragraphs(s)}
    for section in sections(b):
        found = paragraphs(section)
        if section[:NODE] not in have:
            out += [number + i for i, p in enumerate(found) if p[:NODE] not in known]
        number += len(found)
    return out


def located_edits(a: str, b: str) -> dict[str, list]:
    """Where two fingerprints differ, paragraphs by number (from 0): removed of a, added in b, moved as (in a, in b).

    Sections that both texts share at the start and the end are passed over. In the branches between, the n-th equal
    paragraph of one text belongs to the n-th of the other; the most that keep their order stay, the others moved.
    Nodes have 64 bits here; paragraphs of equal nodes count as equal.
    """
    x, y = sections(a), sections(b)
    shared = 0
    while shared < min(len(x), len(y)) and x[shared][:NODE] == y[shared][:NODE]:
        shared += 1
    ends = 0
    while ends < min(len(x), len(y)) - shared and x[-1 - ends][:NODE] == y[-1 - ends][:NODE]:
        ends += 1
    base = sum(s.count(",") + 1 for s in x[:shared])
    old, new = ([p[:NODE] for s in t[shared : len(t) - ends] for p in paragraphs(s)] for t in (x, y))
    places: dict[str, list[int]] = {}
    for i in range(len(old) - 1, -1, -1):
        places.setdefault(old[i], []).append(i)
    pairs, added = [], []
    for j, node in enumerate(new):
        if places.get(node):
            pairs.append((places[node].pop(), j))
        else:
            added.append(base + j)
    # Longest rising run of places: the last pair of the best run of each length, and what each pair goes on from.
    tops: list[int] = []
    ends_at: list[int] = []
    before = [-1] * len(pairs)
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(tops, i)
        before[n] = ends_at[k - 1] if k else -1
        tops[k : k + 1], ends_at[k : k + 1] = [i], [n]
    stay, n = set(), ends_at[-1] if ends_at else -1
    while n >= 0:
        stay.add(n)
        n = before[n]
    moved = [(base + i, base + j) for n, (i, j) in enumerate(pairs) if n not in stay]
    return {"removed": sorted(base + i for left in places.values() for i in left), "added": added, "moved": moved}


def edited_by(text: str, other: str) -> str:
    """The text with its last half replaced by as much of the other's start (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, ghost, descending id: each row meets the one after it. Ghosts only end a range."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None  # (range, id, text, fingerprint) that waits for the next document

    def made(row: tuple, text: str, print_: str) -> tuple:
        _, doc_id, own, own_print = row
        new = edited_by(own, text)
        new_print = own_print if new == own else fingerprint(new)
        return (doc_id, len(own), hashlib.sha256(new.encode()).hexdigest(), own_print, new_print, likeness(own_print, new_print), likeness(own_print, print_))

    for batch in batches:
        out = []
        for part, ghost, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3)), strict=True):
            if ghost and (last is None or last[0] != part):
                continue
            text = data.decode()
            print_ = fingerprint(text)
            if last is not None and last[0] == part:
                out.append(made(last, text, print_))
            last = None if ghost else (part, doc_id, text, print_)
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


WALKED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): its fingerprint, that of its edited text, and likenesses (see the query's contract).

    Documents are dealt into ranges of doc_id. A range also gets a copy of the first document of the range below it (a
    ghost), so that every row finds the next one in its own task; only one id per range goes through the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("place", F.coalesce("doc_id", F.lit(_FIRST)))
    n = docs.count()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS)
    cut = 4 * ranges  # several ranges for each task: what hashing deals unevenly evens out
    edges = docs.approxQuantile("place", [i / cut for i in range(1, cut)], 0.2 / cut) if n and ranges > 1 else []
    splits = [-float("inf"), *sorted({float(e) for e in edges}), float("inf")]
    docs = docs.withColumn("real", F.col("place").cast("double"))
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="real", outputCol="part").transform(docs)
    else:
        docs = docs.withColumn("part", F.lit(0.0))
    docs = docs.withColumn("part", F.col("part").cast("int"))
    heads = sorted((r[0], r[1]) for r in docs.groupBy("part").agg(F.max("place")).collect())  # one row per range
    targets = [(heads[i][1], heads[(i + 1) % len(heads)][0]) for i in range(len(heads))]
    above = docs.sparkSession.createDataFrame(targets, "head long, above int")
    docs = docs.join(F.broadcast(above), F.col("place") == F.col("head"), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost"))
    copies = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("above").alias("part"), F.lit(1).alias("ghost"))))
    docs = docs.select("doc_id", "text", "place", F.explode(copies).alias("at")).select("at.part", "at.ghost", "doc_id", "text", "place")
    docs = docs.repartition(ranges, "part").sortWithinPartitions("part", "ghost", F.desc("place"), "text")
    return docs.select("part", "ghost", "doc_id", "text").mapInArrow(_walk, WALKED)
