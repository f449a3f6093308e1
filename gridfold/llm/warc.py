"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each of whole WARC records up to about ``frame`` bytes, so that one
record is read by inflating one frame. Two skippable frames follow, which any Zstandard reader passes over: the map from
record ids to (frame, offset in the inflated frame, length), sorted by id, and last the seek table of the public seekable format with
the compressed and inflated size of every frame.

A task begins a new bundle when one has reached ``most`` bytes of records. Payload copies: of records with equal payloads of at least ``least`` bytes the smallest page_id is written as response, the
others as revisit records that name it and carry headers only. Null payloads count as empty. A null page_id or url is
written as an empty header and read as null; a null page_id counts after all others and is not in the map. Rows of one page_id are written as
often as they come. Empty tables give no bundles. Bundle names depend on the task's partition and their number in it and appear by rename, so
a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm._common import atomic_file, bounded_batches, column, materialise, n_shuffle, open_shared

LEAST, FRAME, MOST = 100, 1 << 18, 1 << 30
#: Fixed values of the seekable format: skippable frame magic, footer magic; and the skippable frame that holds our map.
SEEK_MAGIC, FOOTER_MAGIC, MAP_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_LAST = 9223372036854775807
_MAP = np.dtype([("record", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u8")])


def record(page_id, url, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """A response record, or a revisit record where refers_to is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {name}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, str(refers_to))}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at an offset: its headers, its block, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"a record at {at} doesn't end where its length says")
    return headers, data[start:stop], stop + 4


class _Bundle:
    """Writes records into frames, then the map and the seek table."""

    def __init__(self, file, frame: int):
        self.file, self.most = file, frame
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.part, self.held, self.frames, self.map, self.records, self.size = [], 0, [], [], 0, 0

    def add(self, record_id: int | None, data: bytes) -> None:
        if self.held and self.held + len(data) > self.most:
            self.end_frame()
        if record_id is not None:
            self.map.append((record_id, len(self.frames), self.held, len(data)))
        self.records += 1
        self.size += len(data)
        self.part.append(data)
        self.held += len(data)

    def end_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.part))
            self.file.write(packed)
            self.frames.append((len(packed), self.held))
            self.part, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        places = np.array(self.map, _MAP)
        body = places[np.argsort(places["record"], kind="stable")].tobytes()
        self.file.write(struct.pack("<II", MAP_MAGIC, len(body)) + body)
        table = [*self.frames, (8 + len(body), 0)]
        entries = b"".join(struct.pack("<II", *x) for x in table)
        self.file.write(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(table), 0, FOOTER_MAGIC))


class BundleReader:
    """Random access to a bundle: by frame, or by record id through the map."""

    def __init__(self, uri: str):
        self.file = open_shared(uri)
        self.file.seek(0, 2)
        size = self.file.tell()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        self.file.seek(size - 9 - 8 * n)
        table = np.frombuffer(self.file.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.packed, self.inflated = table[:-1, 0], table[:-1, 1]
        self.file.seek(int(self.starts[n - 1]) + 8)
        self.map = np.frombuffer(self.file.read(int(table[-1, 0]) - 8), _MAP)

    def __len__(self) -> int:
        return len(self.packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        return zstandard.ZstdDecompressor().decompress(self.file.read(int(self.packed[k])), max_output_size=int(self.inflated[k]))

    def record(self, record_id: int) -> tuple[dict[str, str], bytes]:
        at = int(np.searchsorted(self.map["record"], record_id))
        if at == len(self.map) or self.map[at]["record"] != record_id:
            raise KeyError(record_id)
        return parse(self.frame(int(self.map[at]["frame"])), int(self.map[at]["offset"]))[:2]

    def close(self) -> None:
        self.file.close()


def write(pages: DataFrame, folder: str, *, least: int = LEAST, frame: int = FRAME, most: int = MOST) -> DataFrame:
    """Writes the bundles below folder; returns one row per bundle: bundle, records, frames.

    pages needs page_id, url and html. Which payloads repeat is found from digests alone; payloads are shuffled once, by page.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    light = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("bytes")).filter(F.col("bytes") >= least)
    first = light.groupBy("digest").agg(F.min(F.coalesce("page_id", F.lit(_LAST))).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    # Rows of one page_id and digest: none of them revisits its own id.
    revisits = light.join(first, "digest").filter(F.coalesce("page_id", F.lit(_LAST)) != F.col("first")).select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first").distinct()
    dealt = rows.withColumn("digest", F.sha2("payload", 256))
    joined = dealt.join(revisits, dealt.page_id.eqNullSafe(revisits.id) & (dealt.digest == revisits.of), "left").select("page_id", "url", "digest", F.length("payload").alias("bytes"), F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "first")
    schema = pa.schema([("bundle", pa.string()), ("records", pa.int64()), ("frames", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (row for batch in batches for row in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "digest", "bytes", "payload", "first")), strict=True))
        left = next(records, None)
        for number in itertools.count():
            if left is None:
                return
            name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{number:03d}.warc.zst"
            with atomic_file(name) as file:
                out = _Bundle(file, frame)
                while left is not None and out.size < most:
                    page, url, digest, size, payload, refers = left
                    out.add(page, record(page, url, payload, digest, refers, size))
                    left = next(records, None)
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.records]), pa.array([len(out.frames)])], schema=schema)

    return materialise(joined.mapInArrow(run, "bundle string, records long, frames long"), f"{folder}/_bundles")


def read(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """One row per record of the bundles: page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest, bundle, frame, offset.

    Responses are measured and digested anew from what was read; a revisit's figures are those its record states.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64())])

    def rows(uri: str) -> Iterator[list[tuple]]:
        bundle = BundleReader(uri)
        for k in range(len(bundle)):
            data, at, out = bundle.frame(k), 0, []
            while at < len(data):
                headers, block, after = parse(data, at)
                kind, page = headers["WARC-Type"], headers["X-Page-ID"]
                payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record {page} of {uri} is damaged")
                refers = headers.get("X-Refers-To-Page-ID")
                out.append((int(page) if page else None, headers["WARC-Target-URI"] or None, kind, int(refers) if refers else None, payload, size, digest, uri, k, at))
                at = after
            yield out
        bundle.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in column(batch, "bundle").to_pylist():
                for out in rows(uri):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return bundles.select("bundle").repartition(n_shuffle(spark), "bundle").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, bundle string, frame long, offset long")
