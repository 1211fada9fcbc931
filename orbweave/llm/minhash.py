"""MinHash near-duplicate detection: universal-hash minima, banding, verification on full sets, star components.

Every text is one set of distinct k-word shingles. Documents with equal sets form a class and only its smallest doc_id
goes on. Bands of minima give buckets. A bucket is compared with a hub of its own, a few times while it spans several
components, and a document meets a hub once however many buckets they share; links count only after the full sets
confirm them. Alternating large-star and small-star rounds turn links into components.

What hubs leave open is settled exactly, without pairing a bucket's members. Open buckets whose hubs share a component
are one group. Its frequent shingles (of over WHOLE members) are the group's core; all others have few owners. With a and b shingles of the
core, two members have min(a, b) in common there at most, and exactly as many outside as keys of few owners bring them
together. So a link across components either shares rare shingles, which an index of these finds, or both members have
enough of the core, which a member that no hub reached seldom has. Shingles that no other candidate has bound links
likewise: with u of n shingles its own, a document shares at most n - u with any other.

Defined cases: a null or wordless text has no shingles, is linked with nothing and is its own component; fewer words
than k make one shingle of the whole sequence; repeated rows of one doc_id come back once each with the same class, rows
of one doc_id with different texts are versions of one document, and each is judged by its own text; a null doc_id comes
back with a null component and kept false; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textscan import U64, groups, mix, ragged, scan_words, slices, text_bytes
from .workspace import materialize

BANDS, ROWS = 32, 4
#: A group with up to so many members is compared as it is; in larger ones, shingles of more members are its core.
WHOLE = 32
#: Rounds in which open buckets get one more hub.
HUB_ROUNDS = 2
#: So many ids (8 bytes each) are broadcast at most.
BROADCAST_IDS = 1 << 20

MEMBER = ("rep", "n_rep", "alone_rep")
LONELY = "alone_rep / n_rep"

_rng = np.random.default_rng(97)
_A = _rng.integers(1, 1 << 62, size=BANDS * ROWS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _rng.integers(1, 1 << 62, size=BANDS * ROWS, dtype=np.int64).astype(U64)
_K = _rng.integers(1, 1 << 62, size=64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (A-Z lower-cased)."""
    bounds, _, _, words, _ = scan_words([t.lower() for t in texts])
    n = len(words) - k + 1
    rolled = np.zeros(max(n, 0), U64)
    for j in range(k if n > 0 else 0):
        rolled += words[j : j + n] * _K[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _K[: b - a]).sum() + U64(b - a)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (sets x BANDS) of non-empty sets: each mixes ROWS minima of multiply-shift hashes."""
    flat = np.concatenate(sets)
    begin = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=begin[1:])
    keys = np.zeros((len(sets), BANDS), U64)
    for p in range(BANDS * ROWS):
        low = np.minimum.reduceat((flat * _A[p] + _B[p]) >> U64(32), begin)
        keys[:, p // ROWS] = mix(keys[:, p // ROWS] + low + U64(p + 1))
    return keys


def _sketcher(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in slices(batches, 1):
            texts = text_bytes(column)
            for a, b in groups(texts):
                sets = shingle_sets(texts[a:b], k)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                digest = np.zeros((2, b - a), U64)
                digest[0, full] = [mix(s).sum() for s in sets if len(s)]
                digest[1, full] = [mix(s * _K[40] + _K[41]).sum() for s in sets if len(s)]
                keys = signatures([s for s in sets if len(s)]) if len(full) else np.zeros((0, BANDS), U64)
                bounds = np.concatenate(([0], np.cumsum((size > 0) * BANDS)))
                texts_sha1 = pa.array([hashlib.sha1(t).digest() for t in texts[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], texts_sha1, pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), ragged(keys.view(np.int64).ravel(), bounds, pa.int64())],
                    names=["doc_id", "text_sha1", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _setter(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in slices(batches, 1):
            texts = text_bytes(column)
            for a, b in groups(texts):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], k)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _verifier(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U64) for c in (2, 3))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _shingler(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in slices(batches, 1):
            texts = text_bytes(column)
            for a, b in groups(texts):
                sets = shingle_sets(texts[a:b], k)
                rows = np.repeat(np.arange(a, b), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "shingle"])

    return run


def lone_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(rep, alone): how many shingles of each document no other document of docs has; documents without one are left out."""
    owners = docs.mapInArrow(_shingler(k), "rep long, shingle long").groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    return owners.filter("rep = other").groupBy("rep").agg(F.count("*").alias("alone"))


def can_link(x: str, y: str, percent: int) -> Column:
    """Whether the bounds of documents x and y (columns n_ and alone_ with these endings) let them be similar enough."""
    (n, u), (m, v) = ((F.col(f"n_{d}"), F.col(f"alone_{d}")) for d in (x, y))
    return 100 * F.least(n - u, m - v) >= percent * F.greatest(n + v, m + u)


def verified_links(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_setter(k), "id long, shingles binary")
    sets = materialize(sets, "minhash-sets", "none")
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_verifier(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: alternating large-star and small-star until all links are stars.

    A star's center is found by a partial aggregate and joined back, so a node with very many links is never gathered.
    Stars are finished when every node either has one link to a smaller node or only links to larger ones.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    edges = materialize(edges.distinct(), "stars")
    while True:
        ends = edges.select(F.explode(F.array(F.struct("u", F.lit(1).alias("down")), F.struct(F.col("v").alias("u"), F.lit(0).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("u").agg(F.sum("down").alias("down"), F.min("down").alias("least")).filter("down > 1 or down > 0 and least = 0").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        center = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(center, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        center = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(center, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(center)
        edges = materialize(small.distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def distinct_texts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of one document of each group, the one with the smallest doc_id.

    Of a doc_id with several texts each is judged by itself; rows without doc_id or without words stay; repeated rows of
    the document that stays are that document.
    """
    found = near_duplicates(docs, k, percent, text_key=True).filter(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = found.select(F.col("doc_id").alias("gone_id"), "text_sha1").distinct()
    same = (docs.doc_id == gone.gone_id) & (F.unhex(F.sha1(F.coalesce(docs.text, F.lit("")))) == gone.text_sha1)
    return docs.join(gone, same, "left_anti")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text_key: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept; with text_key the text's text_sha1."""
    docs = docs.select("doc_id", "text")
    sketch = materialize(docs.mapInArrow(_sketcher(k), "doc_id long, text_sha1 binary, n_shingles long, h1 long, h2 long, bands array<long>"), "minhash-sketch")
    classes = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    # A band's key is mixed with its number, so a key alone names a bucket.
    members = sketch.join(classes, ["h1", "h2"]).filter("doc_id = rep").select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = materialize(members.join(shared, "bucket"), "minhash-members")
    # Only documents of buckets with several members are ever compared: few ids go to the texts, many meet them in a shuffle.
    ids = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "minhash-ids")
    near = materialize(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "minhash-near")
    bounds = sketch.join(classes, ["h1", "h2"]).filter("doc_id = rep").select("rep", F.col("n_shingles").alias("n_rep"))
    bounds = bounds.distinct().join(lone_shingles(near, k), "rep", "left").fillna(0, ["alone"]).withColumnRenamed("alone", "alone_rep")
    # Documents that can link with none leave their buckets.
    bounds = bounds.filter(100 * (F.col("n_rep") - F.col("alone_rep")) >= percent * F.col("n_rep"))
    members = materialize(members.join(bounds, "rep").select("bucket", *MEMBER), "minhash-bounded")
    labels = _settle(near, members, k, percent)
    labels = labels.select(F.col("node").alias("rep"), "component")
    out = sketch.join(classes, ["h1", "h2"], "left").join(labels, "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", *["text_sha1"] * text_key, F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _settle(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) after every bucket is settled: its members share a component, or links across are excluded.

    members: bucket, rep, n_rep, alone_rep.
    """
    inner = F.min_by(F.struct(*MEMBER, "component"), F.struct(F.expr(LONELY), "rep"))
    named, labels = members.withColumn("component", F.col("rep")), None
    for turn in range(1 + HUB_ROUNDS):
        # The hub has the smallest share of lone shingles, so it is near the middle; later hubs come from those still apart.
        if turn:
            sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
            main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
            apart = named.join(main, "bucket").filter("component <> main")
        else:
            apart = named
        hubs = apart.groupBy("bucket").agg(inner.alias("h")).selectExpr("bucket", "h.rep as a", "h.n_rep as n_a", "h.alone_rep as alone_a", "h.component as ca")
        met = named.join(hubs, "bucket").filter((F.col("ca") != F.col("component")) & can_link("a", "rep", percent))
        labels = _linked(docs, met.select(*ordered("a", "rep")).distinct(), labels, k, percent)
        named = _open(members, labels, percent)
        if named.isEmpty():
            return labels
    # Buckets whose hubs share a component are one group.
    hubs = named.groupBy("bucket").agg(inner.alias("h")).selectExpr("bucket", "h.component as hub")
    group = materialize(named.join(hubs, "bucket").select("hub", *MEMBER, "component").distinct(), "minhash-groups")
    return _linked(docs, _open_pairs(docs, group, k, percent).distinct(), labels, k, percent)


def ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _linked(docs: DataFrame, pairs: DataFrame, labels: DataFrame | None, k: int, percent: int) -> DataFrame:
    """Components of the links so far (as stars around what they made) and of the new pairs that are links."""
    found = materialize(verified_links(docs, materialize(pairs, "minhash-pairs"), k, percent), "minhash-links")
    if labels is not None and found.isEmpty():
        return labels
    return materialize(components(found if labels is None else found.union(labels.toDF("a", "b"))), "minhash-labels")


def _open(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Members, with component, of buckets that span components and could hold a link.

    Of two documents that link, the smaller has n - u in common with the other at most and n + u in the union at least:
    without such a document (a center) a bucket is settled.
    """
    center = 100 * (F.col("n_rep") - F.col("alone_rep")) >= percent * (F.col("n_rep") + F.col("alone_rep"))
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    size = named.groupBy("bucket").agg(F.count_if(center).alias("centers"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return materialize(named.join(size.filter("lo < hi and centers > 0").select("bucket"), "bucket"), "minhash-open")


def _open_pairs(docs: DataFrame, group: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a group (hub, rep, n_rep, alone_rep, component), among them all links across components."""
    size = group.groupBy("hub").agg(F.count("*").alias("size"), F.min("n_rep").alias("least"))
    sizes = group.groupBy("hub", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    group = materialize(group.join(size, "hub").join(main, "hub"), "minhash-sized")
    other = lambda d: d.select("hub", *(F.col(c).alias(c.replace("rep", "o")) for c in MEMBER), F.col("component").alias("co"))
    # Of two components one is not the main one of their group.
    small = group.filter(F.col("size") <= WHOLE)
    apart = small.filter("component <> main").join(other(small), "hub").filter((F.col("component") != F.col("co")) & can_link("rep", "o", percent))
    pairs = apart.select(*ordered("rep", "o"))
    large = group.filter(F.col("size") > WHOLE)
    own = docs.join(large.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_shingler(k), "rep long, shingle long").distinct()
    owned = materialize(large.select("hub", "rep", "component").join(own, "rep"), "minhash-owned")
    owners = owned.groupBy("hub", "shingle").agg(F.count("*").alias("owners"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    rare = materialize(owned.join(owners.filter(F.col("owners") <= WHOLE), ["hub", "shingle"]), "minhash-rare")
    outside = rare.groupBy("hub", "rep").agg(F.count("*").alias("outside"))
    core = large.join(outside, ["hub", "rep"], "left").withColumn("core", F.col("n_rep") - F.coalesce("outside", F.lit(0)))
    core = materialize(core, "minhash-core")
    enough = lambda common: (100 + percent) * common >= percent * (F.col("n_rep") + F.col("n_o"))
    # Keys of several components count as outside; who has too few with its core is in no link across, and leaves its keys.
    ends = rare.filter("lo < hi").select("hub", "shingle", "rep", "component")
    for _ in range(2):
        worth = ends.groupBy("hub", "rep").agg(F.count("*").alias("met")).join(core.select("hub", "rep", "n_rep", "core", "least"), ["hub", "rep"])
        worth = worth.filter((100 + percent) * (F.col("core") + F.col("met")) >= percent * (F.col("n_rep") + F.col("least"))).select("hub", "rep", "n_rep", "core")
        ends = ends.select("hub", "shingle", "rep", "component").join(worth, ["hub", "rep"])
        keys = ends.groupBy("hub", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        ends = materialize(ends.join(keys.select("hub", "shingle"), ["hub", "shingle"]).select("hub", "shingle", "rep", "n_rep", "core", "component"), "minhash-ends")
    far = ends.toDF("hub", "shingle", "o", "n_o", "core_o", "co")
    met = ends.join(far, ["hub", "shingle"]).filter("component < co").groupBy("hub", "rep", "o").agg(F.count("*").alias("common"), *(F.first(c).alias(c) for c in ("n_rep", "core", "n_o", "core_o")))
    pairs = pairs.union(met.filter(enough(F.col("common") + F.least("core", "core_o"))).select(*ordered("rep", "o")))
    # Members with enough of the core to link without rare shingles.
    near = core.filter((100 + percent) * F.col("core") >= percent * (F.col("n_rep") + F.col("least")))
    far = near.select("hub", F.col("rep").alias("o"), F.col("n_rep").alias("n_o"), F.col("core").alias("core_o"), F.col("component").alias("co"))
    met = near.filter("component <> main").join(far, "hub").filter((F.col("component") != F.col("co")) & enough(F.least("core", "core_o")))
    return pairs.union(met.select(*ordered("rep", "o")))
