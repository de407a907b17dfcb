"""WARC archives: round trip, revisits, rolling, repeated runs."""

from __future__ import annotations

import bisect
import glob
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tokentide.llm import warc
from tokentide.llm.frames import range_of
from tokentide.session import scratch_path

LONG = "é" * 600
SCHEMA = "page_id long, url string, html string, size int"
PAGES = [
    (1, "http://a/1", LONG, 0),
    (5, "http://a/\n5 é", LONG, 0),
    (3, None, LONG, 0),
    (2, "http://a/2", "short", 0),
    (4, "http://a/4", "short", 0),
    (6, "http://a/6", None, 0),
    (7, "http://a/7", "", 0),
    (8, "http://a/8", "x" * 999, 0),
    (9, "http://a/9", "x" * 999, 0),
    (10, "http://a/10", "y" * 1000, 0),
    (10, "http://a/10", "y" * 1000, 0),
    (None, "http://a/n", "y" * 1000, 0),
    (-4, "http://a/m", "\r\n\r\nWARC/1.1\r\n", 0),
]


def path_of(folder):
    return folder.removeprefix("file://").removeprefix("file:")


def test_round_trip(spark, rows):
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_warc(rows(PAGES, SCHEMA), folder)
    assert sum(r.records for r in manifest.collect()) == len(PAGES)
    found = warc.read_warc(spark, folder).collect()
    assert all(r.verified for r in found) and len(found) == len(PAGES)
    told = sorted(((r.page_id is not None, r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found)
    winners = {LONG: 5, "y" * 1000: 10}
    wanted, seen = [], set()
    for page, _, html, _ in sorted(PAGES, key=lambda p: (p[0] is not None, p[0] or 0)):
        data = (html or "").encode()
        target = winners.get(html)
        revisit = target is not None and (target != page or (page, html) in seen)
        seen.add((page, html))
        wanted.append(((page is not None, page or 0), "revisit" if revisit else "response", target if revisit else None, len(data), hashlib.sha1(data).hexdigest()))
    assert told == sorted(wanted)
    payloads = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert payloads[-4] == b"\r\n\r\nWARC/1.1\r\n" and payloads[5] == LONG.encode() and payloads[6] == b""
    assert {r.page_id: r.url for r in found}[5] == "http://a/%0A5%20é" and {r.page_id: r.url for r in found}[3] is None


def test_files_roll_and_reruns_are_equal(spark, rows):
    data = [(i * 7 % 501, f"http://b/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40, 0) for i in range(501)]
    frames = [rows(data, SCHEMA), rows(data[::-1], SCHEMA).repartition(5)]
    contents = []
    for frame in frames:
        folder = scratch_path(spark, "warc-roll")
        manifest = warc.write_warc(frame, folder, shard_bytes=400_000, roll_bytes=20_000).orderBy("file").collect()
        assert len(manifest) > 4 and len({r.shard for r in manifest}) > 2
        assert all(r.bytes < 40_000 for r in manifest)
        ordered = [(r.first_id, r.last_id) for r in manifest]
        assert ordered == sorted(ordered)
        files = sorted(glob.glob(path_of(folder) + "/data/*.warc.gz"))
        assert [os.path.basename(f) for f in files] == [r.file for r in manifest]
        assert not [f for f in os.listdir(path_of(folder) + "/data") if ".warc.gz." in f and not f.endswith(".crc")]
        contents.append([open(f, "rb").read() for f in files])
        assert all(hashlib.sha256(c).hexdigest() == r.sha256 for c, r in zip(contents[-1], manifest, strict=True))
        assert gzip.decompress(contents[-1][0]).startswith(b"WARC/1.1\r\nWARC-Type: response")
        assert warc.read_warc(spark, folder, payloads=False).where("verified").count() == 501
        # What a lost task left behind is not read.
        with open(path_of(folder) + "/data/000000-99999.warc.gz", "wb") as stray:
            stray.write(b"junk")
        assert warc.read_warc(spark, folder).count() == 501
    assert contents[0] == contents[1]


def test_empty_table_and_damage(spark, rows):
    folder = scratch_path(spark, "warc-empty")
    assert warc.write_warc(rows([], SCHEMA), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0
    folder = scratch_path(spark, "warc-cut")
    warc.write_warc(rows(PAGES, SCHEMA), folder)
    [file] = glob.glob(path_of(folder) + "/data/*.warc.gz")
    data = open(file, "rb").read()
    with open(file, "wb") as cut:
        cut.write(data[:-5])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, folder).collect()


def test_shards_hold_equal_bytes_and_are_bounded(spark, rows):
    sizes = [(i, 40_000 if i < 20 else 100) for i in range(2000)]
    narrow = rows([*sizes, (None, 5000), (5, 30_000), (5, 1000)], "id long, size long")
    total = 20 * 40_000 + 1980 * 100 + 36_000
    bounds = warc._bounds(narrow, 50_000, 1 << 16)
    assert bounds == warc._bounds(narrow.repartition(9), 50_000, 1 << 16) and bounds == sorted(set(bounds))
    before, wanted = 5000, set()
    summed = {i: s for i, s in sizes} | {5: 71_000}
    shard = 0
    for i in sorted(summed):
        if before // 50_000 > shard:
            wanted, shard = wanted | {i}, before // 50_000
        before += summed[i]
    assert before == total and bounds == sorted(wanted)
    assert len(warc._bounds(narrow, 1000, 8)) < 8
    assert warc._bounds(narrow, 1 << 30, 8) == [] == warc._bounds(narrow.where("false"), 1, 8)


def test_many_bounds_are_one_literal(spark):
    bounds = list(range(-50_000, 50_000, 3))
    frame = spark.createDataFrame([(v,) for v in (-50_001, -50_000, -1, 0, 1, 49_999, 60_000, None)], "v long")
    found = frame.select("v", range_of(F.col("v"), bounds).alias("n")).collect()
    assert all(r.n == bisect.bisect_right(bounds, r.v) for r in found if r.v is not None)
    assert [r.n for r in found if r.v is None] == [0] or [r.n for r in found if r.v is None] == [None]
    assert frame.select(range_of(F.col("v"), []).alias("n")).distinct().first().n == 0
