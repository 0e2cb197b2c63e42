"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress alone. A bundle ends with two skippable frames: an index of record
identifiers to frame numbers and offsets within the frame, and the seek table of the Zstandard seekable format.
Of records with equal payloads of at least LEAST bytes, the one of the smallest page_id is a response and the others
revisit it.

Defined results: a null html is an empty payload; rows without page_id are responses; rows that repeat page_id and payload
are all written alike (all responses where theirs is the smallest page_id); a null url is left out of the record; an empty
table gives no bundle and no row; a very long html is a frame of its own; further columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt_name, filesystem, scratch, table, write_file, written

LEAST = 100
FRAME = 1 << 18  # bytes of records in a frame, more only where one record has more
BUNDLE = 1 << 26  # bytes of a bundle after which the task begins another
DATE = "2024-01-01T00:00:00Z"
SKIP_SEEK, SKIP_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Revisits of at most so many rows are broadcast (some 80 bytes each); beyond, pages are joined with them by shuffle.
BROADCAST_ROWS = 200_000


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


class BundleWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.z = out, zstandard.ZstdCompressor(level=3)
        self.frames, self.index, self.parts, self.size, self.bytes = [], [], [], 0, 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.parts and self.size + len(raw) > FRAME:
            self._frame()
        self.index.append((page_id or 0, page_id is not None, len(self.frames), self.size, len(raw)))
        self.parts.append(raw)
        self.size += len(raw)

    def _frame(self) -> None:
        packed = self.z.compress(b"".join(self.parts))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.bytes += len(packed)
        self.parts, self.size = [], 0

    def close(self) -> None:
        if self.parts:
            self._frame()
        raw = self.z.compress(np.array([x[:1] + tuple(map(int, x[1:])) for x in self.index], "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIP_INDEX, len(raw)) + raw)
        seek = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)


class Bundle:
    """Reads a bundle: records in turn, or one by its identifier from its frame alone."""

    def __init__(self, uri: str):
        import zstandard

        self.z = zstandard.ZstdDecompressor()
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        end = self.f.size()
        n, _, magic = struct.unpack("<IBI", self.f.read_at(9, end - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        at = end - 9 - 8 * n
        sizes = np.frombuffer(self.f.read_at(8 * n, at), "<u4").reshape(-1, 2).astype(np.int64)
        self.starts, self.sizes = np.concatenate([[0], np.cumsum(sizes[:, 0])]), sizes
        after = int(self.starts[-1])
        magic, size = struct.unpack("<II", self.f.read_at(8, after))
        if magic != SKIP_INDEX:
            raise ValueError(f"{uri} has no index")
        self.index = np.frombuffer(self.z.decompress(self.f.read_at(size, after + 8)), "<i8").reshape(-1, 5)

    def frame(self, k: int) -> bytes:
        return self.z.decompress(self.f.read_at(int(self.sizes[k, 0]), int(self.starts[k])), max_output_size=int(self.sizes[k, 1]))

    def get(self, page_id: int) -> list[bytes]:
        """The records of a page_id, from their frames alone."""
        found = self.index[(self.index[:, 0] == page_id) & (self.index[:, 1] == 1)]
        return [self.frame(k)[at : at + n] for _, _, k, at, n in found.tolist()]

    def records(self):
        """(page_id, record) in file order; one frame at a time is held."""
        held, raw = -1, b""
        for i, known, k, at, n in self.index.tolist():
            if k != held:
                held, raw = k, self.frame(k)
            yield (i if known else None), raw[at : at + n]


def write_bundles(pages: DataFrame, out_dir: str) -> DataFrame:
    """Writes pages (page_id, url, html) as bundles under out_dir. Returns the manifest, a table in the shared folder: path, n_records, bytes."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_ = rows.where((F.octet_length("payload") >= LEAST) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = written(long_.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to"), "warc-first")
    revisits = written(long_.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    small = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    decided = rows.join(small, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches):
        rest = (row for b in batches for lo in range(0, b.num_rows, 100) for row in zip(*(b.slice(lo, 100).column(k).to_pylist() for k in range(5)), strict=True))
        row, part = next(rest, None), 0
        while row is not None:
            name, total = f"{out_dir}/{attempt_name('pages')}-{part:04d}.warc.zst", [0]

            def fill(out, total=total):
                nonlocal row
                w = BundleWriter(out)
                while row is not None and w.bytes < BUNDLE:
                    w.add(row[0], record(row[0], row[1], row[2], row[3], row[4]))
                    total[0] += 1
                    row = next(rest, None)
                w.close()

            size = write_file(name, fill)
            part += 1
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [total[0]], "bytes": [size]})

    return written(decided.mapInArrow(write, "path string, n_records long, bytes long"), "warc-manifest")


def located(manifest: DataFrame) -> DataFrame:
    """Where each record is: page_id, path, frame, offset (in the frame), n_bytes; from the ends of the bundles alone."""

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                x = Bundle(path).index
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0], mask=x[:, 1] == 0), pa.array([path] * len(x), pa.string()), *(pa.array(np.ascontiguousarray(x[:, k])) for k in (2, 3, 4))], names=["page_id", "path", "frame", "offset", "n_bytes"])

    return manifest.select("path").repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(read, "page_id long, path string, frame long, offset long, n_bytes long")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """Reads the bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads of responses are
    hashed again and held against their digest."""

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                cols: list = [[], [], [], [], []]
                for page_id, raw in Bundle(path).records():
                    fields, http, payload = parsed(raw)
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest, to = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields.get("WARC-Refers-To")
                    if to is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} is damaged")
                    for c, v in zip(cols, (page_id, size, digest, fields["WARC-Type"], None if to is None else int(to.rpartition(":")[2][:-1])), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("path").repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST} GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first < page_id AND payload_bytes >= {LEAST} THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first < page_id AND payload_bytes >= {LEAST} THEN first END AS refers_to FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
