"""Writing pages as sharded WARC archives, and reading archives back.

Records are dealt to ranges of the page id that hold about equally many bytes of payload, by
exact running totals, so shards and files depend on the data alone. A task streams its range in order, makes each record's
headers and digests anew, and begins another file when one has reached its compressed size.
Files are written under temporary names and renamed when complete; the manifest, written
last, names the files that count, so what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokentide.llm.frames import column, range_of, slices
from tokentide.operators.ordering import with_running_total
from tokentide.session import materialize, ship_package

MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = (
    "file string, page_id long, url string, record_type string, refers_to long, payload_bytes long,"
    " payload_digest string, verified boolean, payload binary"
)
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_CHUNK = 1 << 20


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, url: str | None, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """One WARC record, uncompressed; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    target = None if url is None else _CONTROL.sub(lambda found: f"%{ord(found[0]):02X}", url)
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{URN}{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("WARC-Refers-To", None if refers_to is None else f"<{URN}{refers_to}>"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{key}: {value}\r\n" for key, value in headers if value is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive under a temporary name, each record its own gzip member."""

    def __init__(self, system: fs.FileSystem, folder: str, shard: int, number: int, attempt: int, level: int):
        self.system, self.level = system, level
        self.name = f"{shard:06d}-{number:05d}.warc.gz"
        self.final, self.temporary = f"{folder}/{self.name}", f"{folder}/.{self.name}.{attempt}"
        self.out = system.open_output_stream(self.temporary, compression=None)
        self.digest, self.bytes, self.records, self.ids = hashlib.sha256(), 0, 0, []

    def add(self, data: bytes, page_id: int | None) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1
        self.ids = [self.ids[0] if self.ids else page_id, page_id]

    def commit(self, shard: int) -> tuple:
        self.out.close()
        self.system.move(self.temporary, self.final)
        return (self.name, shard, self.records, self.bytes, self.digest.hexdigest(), *self.ids)


def _bounds(narrow: DataFrame, shard_bytes: int, most_shards: int) -> list[int]:
    """Ids that begin a shard: those at which the payloads before them fill another ``shard_bytes``.

    There are less than ``most_shards``: beyond so many, shards become larger instead. Sizes
    are summed by id first, so the bounds do not depend on the order of rows that repeat an id.
    """
    total = narrow.agg(F.sum("size")).first()[0] or 0
    if total <= shard_bytes:
        return []
    each = max(shard_bytes, -(-total // most_shards))
    sizes = narrow.groupBy("id").agg(F.sum("size").alias("size"))
    placed = with_running_total(materialize(sizes, "sizes"), ["id"], F.col("size"), name="before")
    begun = placed.groupBy(F.floor(F.col("before") / each).alias("shard")).agg(F.min("id").alias("id"))
    return sorted(row["id"] for row in begun.where("shard > 0 AND id IS NOT NULL").collect())


def write_warc(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    shard_bytes: int = 16 << 20,
    roll_bytes: int = 8 << 20,
    least: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 4,
    most_shards: int = 1 << 16,
) -> DataFrame:
    """Write every page to ``folder``/data and return the manifest, one row per file.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest id is
    a response and the others revisit it; other pages are responses. A null payload is
    empty, a null url leaves the target out, control characters in one are percent-encoded.
    Rows that repeat an id keep a record each, in the order of url and payload; with equal
    payloads the first is the response. A row without id comes first and revisits like any
    other, but nothing revisits it. An empty table writes no file and an empty manifest.
    Other columns are left out. A shard holds some ``shard_bytes`` of payload, more where there
    would be over ``most_shards``, and the rows of one id are in one. ``folder`` must be one that all executors share.
    """
    spark = ship_package(pages.sparkSession)
    rows = pages.select(
        column(key).cast("long").alias("id"),
        column(url).alias("url"),
        F.coalesce(column(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    narrow = materialize(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("size")), "payloads")
    bounds = _bounds(narrow, shard_bytes, most_shards)
    large = narrow.where(F.col("size") >= least)
    shared = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    # Written, so that the join below reads plain shuffles, of which Spark can split a hot payload.
    shared = materialize(shared.where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"), "shared")
    marks = large.select("id", "digest").join(shared, "digest")
    place = F.coalesce(range_of(F.col("id"), bounds), F.lit(0)).alias("shard")
    nothing = F.lit(None)
    stream = (
        rows.select("id", "url", "payload", "digest", nothing.cast("long").alias("refers_to"), F.lit(1).alias("kind"))
        .unionByName(
            marks.select(
                "id",
                nothing.cast("string").alias("url"),
                nothing.cast("binary").alias("payload"),
                "digest",
                "refers_to",
                F.lit(0).alias("kind"),
            )
        )
        .select("*", place)
        .repartitionById(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "id", "kind", "url", "digest")
    )
    data = f"{folder.rstrip('/')}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(data)
        system.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        file, number, done = None, 0, []
        page, seen, targets, written = object(), 0, {}, set()
        for batch in slices(batches):
            for row in batch.to_pylist():
                if row["id"] != page:
                    page, seen, targets, written = row["id"], 0, {}, set()
                if row["kind"] == 0:
                    targets[row["digest"]] = row["refers_to"]
                    continue
                seen += 1
                name = ("none" if page is None else str(page)) + (f":{seen}" if seen > 1 else "")
                target = targets.get(row["digest"])
                revisits = target is not None and (target != page or row["digest"] in written)
                written.add(row["digest"])
                if file is None:
                    file = _File(system, path, row["shard"], number, attempt, level)
                made = record("revisit" if revisits else "response", name, row["url"], row["payload"], date, str(target) if revisits else None)
                file.add(made, page)
                if file.bytes >= roll_bytes:
                    done.append(file.commit(row["shard"]))
                    file, number = None, number + 1
                shard = row["shard"]
        if file is not None:
            done.append(file.commit(shard))
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, row, strict=True)) for row in done], schema=_MANIFEST)

    manifest = stream.select("shard", "id", "kind", "url", "digest", "payload", "refers_to").mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


_MANIFEST = pa.schema(
    [
        ("file", pa.string()),
        ("shard", pa.int32()),
        ("records", pa.int64()),
        ("bytes", pa.int64()),
        ("sha256", pa.string()),
        ("first_id", pa.int64()),
        ("last_id", pa.int64()),
    ]
)
_NAMES = _MANIFEST.names


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The uncompressed members of a gzip stream, one at a time."""
    unpacker, out = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            out.append(unpacker.decompress(chunk))
            chunk = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(out)
                unpacker, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the last record is cut off")


def parse(data: bytes) -> dict:
    """A record's page id, url, type, reference and payload, with digests computed again."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    number = lambda name: re.fullmatch(rf"<{URN}(none|-?\d+)(?::\d+)?>", name)[1]
    page, target = number(headers["WARC-Record-ID"]), headers.get("WARC-Refers-To")
    revisit = headers["WARC-Type"] == "revisit"
    told = headers["WARC-Payload-Digest"]
    good = _sha1(block) == headers["WARC-Block-Digest"] and (revisit or (_sha1(payload) == told and len(payload) == length))
    return {
        "page_id": None if page == "none" else int(page),
        "url": headers.get("WARC-Target-URI"),
        "record_type": headers["WARC-Type"],
        "refers_to": None if target is None else int(number(target)),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(told.removeprefix("sha1:")).hex(),
        "verified": good,
        "payload": None if revisit else payload,
    }


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the files that the manifest of ``folder`` names.

    One task streams a file record by record. payload is null for revisits, and for all
    with ``payloads=False``; verified tells whether the digests computed from what was read
    equal those in the headers. A file that is missing or cut off fails the job.
    """
    ship_package(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest").select("file")
    files = manifest.count()
    data = f"{folder.rstrip('/')}/data"
    schema = pa.schema(
        [
            ("file", pa.string()),
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("verified", pa.bool_()),
            ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(data)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    held: list[dict] = []
                    for member in members(iter(lambda: stream.read(_CHUNK), b"")):
                        held.append({"file": name, **parse(member)})
                        if not payloads:
                            held[-1]["payload"] = None
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return manifest.repartition(max(1, min(files, 100_000)), "file").mapInArrow(run, RECORDS)
