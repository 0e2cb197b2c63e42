"""Hashed byte trigrams of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 2048
#: Texts are counted in pieces of so many bytes, so that a very long text takes no more memory than a short one.
PIECE = 1 << 20


def trigrams(raw: bytes, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed trigrams of bytes, a space put before and after."""
    total = np.zeros(dims, np.int64)
    raw = b" " + raw + b" "
    for lo in range(0, len(raw), PIECE):
        a = np.frombuffer(raw, np.uint8, min(PIECE + 2, len(raw) - lo), lo).astype(np.uint32)
        if len(a) >= 3:
            h = (a[:-2] * np.uint32(0x01000193) + a[1:-1]) * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount((h >> np.uint32(16)) & np.uint32(dims - 1), minlength=dims)
    return total


def training_rows(column: str = "doc_id"):
    """Rows that may be learnt from: crc32 of the id as text, mod 4, isn't 2. A null id isn't learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def counted_sample(docs: DataFrame, ids: DataFrame, count, dims: int) -> tuple[list, np.ndarray]:
    """The labels and counts of the rows of docs (doc_id, text) named by ids (doc_id, label), a bounded table, in order of id."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [count(t).astype("<u4").tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    kind = ids.schema["label"].dataType.simpleString()
    found = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text").mapInArrow(run, f"doc_id long, label {kind}, x binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), "<u4").reshape(-1, dims)
    return found.column("label").to_pylist(), x
