"""WARC, chat and search."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import chat, topk, warc


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\n</p>", 0), (2, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u\nv", "x" * 300_000, 0), (5, "u", "x" * 300_000, 0), (None, "u", "y", 0)], "page_id long, url string, html string, archive int")
    path = warc.write_warc(pages)
    rows = warc.read_warc(spark, path).collect()
    assert all(r.status == "record" for r in rows) and len(rows) == 7
    by = {r.record_id: r for r in rows}
    assert by["<urn:page:2>"].record_type == "revisit" and by["<urn:page:2>"].refers_to == "<urn:page:1>" and by["<urn:page:2>"].payload_bytes == by["<urn:page:1>"].payload_bytes
    assert by["<urn:page:4>"].record_type == "revisit" and by["<urn:page:3>"].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert bytes(by["<urn:page:1>"].payload).decode() == "<p>é\r\n\r\nWARC/1.1\r\n</p>"
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def record(n: int, body: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r{n}>\r\nWARC-Block-Digest: sha1:{warc.digest_of(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_salvage_recovers_what_follows_damage():
    parts = [record(i, b"body %d " % i * 50) for i in range(4)]
    for plain in (True, False):
        packed = parts if plain else [gzip.compress(p) for p in parts]
        broken = bytearray(packed[1])
        broken[len(broken) // 2] ^= 0xFF
        data = packed[0] + bytes(broken) + b"junk" + packed[2] + packed[3][:-7]
        out = list(warc.salvage(data))
        assert [r.headers.get("warc-record-id") for r in out if r.status == "record"] == ["<r0>", "<r2>", *["<r3>"] * (not plain)]  # of a gzip member only the trailer is lost
        assert sum(r.length for r in out) == len(data) and [r.offset for r in out] == sorted(r.offset for r in out)
        assert all(r.reason for r in out if r.status == "quarantine")


def test_perspectives_cover_every_turn(spark):
    turns = [(1, i, "ann" if i % 2 else "bob", f"line {i}" * (i % 5), 9) for i in range(600)] + [(1, 0, "system", "be kind", 9), (2, None, None, None, 9), (2, 0, "bob", "hi", 9), (2, 0, "bob", "hi", 9), (3, 0, "system", "alone", 9), (None, 1, "zoe", "x", 9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, start int")
    rows = chat.rotate_perspectives(df).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "bob"), (2, "unknown"), (None, "zoe")}
    for (conv, who), parts in whole.items():
        parts.sort(key=lambda r: r.start)
        text = "".join(r.segment for r in parts)
        assert len(parts) == sum(t[0] == conv for t in turns)
        for r in parts:
            assert text[r.start : r.start + r.length] == r.segment
            if r.speaker == who:
                assert text[r.mask_start : r.mask_start + r.mask_length].endswith("<|im_end|>") and r.rendered_role == "assistant"
            else:
                assert r.mask_length == 0 and r.mask_start is None
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


@pytest.mark.parametrize("settings", [{}, {"FIRST": 1, "GROWTH": 2, "MAXIMA_TILES": 1, "QUERY_ROWS": 4}])
def test_search_equals_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.2, (900, 8))
    vectors[100:300] = vectors[7]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)] + [(1000, None, 0), (1001, [None] * 8, 0), (1002, [float("nan")] * 8, 0), (1050, [1e9] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if v and v[0] is not None and np.isfinite(v[0])}
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for i in (x for x in q if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i)[:5]
        assert got[i] == {n + 1: (j, -s) for n, (s, j) in enumerate(best)}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_salvage_finds_gzip_members_anywhere():
    parts = [record(i, b"body %d " % i * 50) for i in range(4)]
    members = [gzip.compress(p) for p in parts]
    ids = lambda data: [r.headers["warc-record-id"] for r in warc.salvage(data) if r.status == "record"]
    lost = bytes(100_000) + b"".join(members[1:])
    assert ids(lost) == ["<r1>", "<r2>", "<r3>"] and sum(r.length for r in warc.salvage(lost)) == len(lost)
    assert ids(parts[0] + members[1] + b"junk" + members[2] + parts[3]) == ["<r0>", "<r1>", "<r2>", "<r3>"]


def test_warc_query_with_a_null_page_id(spark, tmp_path):
    from orbweave.llm.queries import op1_warc

    spark.createDataFrame([(7, "u", "a"), (8, "u", "a"), (None, "u", "b")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = {(r.page_id, r.record_type, r.refers_to) for r in op1_warc(spark, str(tmp_path)).collect()}
    assert rows == {(7, "response", None), (8, "revisit", 7), (None, "response", None)}


def test_archives_are_gzip_members_of_bounded_size(spark):
    pages = spark.range(300).selectExpr("id as page_id", "'u' as url", "repeat(cast(sha2(cast(id as string), 256) as string), 300) as html").coalesce(1)
    path = warc.write_warc(pages, block_bytes=1 << 11)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) > 2
    for f in files:
        data = open(f, "rb").read()
        assert gzip.decompress(data).count(b"WARC-Record-ID") == sum(r.status == "record" for r in warc.salvage(data)) > 0
    rows = warc.read_warc(spark, path, payloads=False).collect()
    assert len(rows) == 300 and "payload" not in rows[0] and all(r.status == "record" and r.payload_bytes == 19200 for r in rows)


def test_a_record_beyond_16_mib_keeps_its_archive_whole():
    body = np.random.default_rng(2).bytes((17 << 20) + 5)
    member, rest = warc.gzip_member(record(1, body)), warc.gzip_member(record(2, b"x"))
    out = list(warc.salvage(member + b"\0" + rest))
    assert [r.headers["warc-record-id"] for r in out] == ["<r1>", "<r2>"] and out[0].length == len(member) + 1


def test_salvage_of_members_with_several_records():
    parts = [record(i, np.random.default_rng(i).bytes(90_000)) for i in range(4)]
    member, after = gzip.compress(b"".join(parts)), gzip.compress(record(9, b"after"))
    ids = lambda data: [r.headers["warc-record-id"] for r in warc.salvage(data) if r.status == "record"]
    covered = lambda data: sum(r.length for r in warc.salvage(data)) == len(data)
    assert ids(member + after) == ["<r0>", "<r1>", "<r2>", "<r3>", "<r9>"] and covered(member + after)
    broken = bytearray(member)
    broken[len(member) * 5 // 8] ^= 0xFF  # in the third record
    cut = member[: len(member) * 5 // 8]  # in the third record
    assert ids(bytes(broken) + after)[:2] == ["<r0>", "<r1>"] and ids(bytes(broken) + after)[-1] == "<r9>" and covered(bytes(broken) + after)
    assert ids(cut) == ["<r0>", "<r1>"] and covered(cut)
    inner = bytearray(b"".join(parts))
    inner[100_000] ^= 0xFF  # in the second record, inside a whole member
    out = list(warc.salvage(gzip.compress(bytes(inner))))
    assert [r.status for r in out] == ["record", "quarantine", "record", "record"] and [r.inner_offset for r in out] == sorted(r.inner_offset for r in out)


def test_search_with_scores_beyond_64_bits(spark):
    rows = [(0, [1e12, 1e12]), (1, [1e12, 1e12]), (2, [2e12, 3e12]), (3, [-1e12, -4e12]), (4, [1e307, 0.0]), (5, [0.5, 0.25]), (50, [3e12, -1.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i != 4}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for i in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(q[i], v))), j) for j, v in q.items() if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
