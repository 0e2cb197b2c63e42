"""Word shingles as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The distinct hashes of the k-word shingles of a UTF-8 text, ascending. Words stand between \\x20 and \\x09-\\x0D; A-Z are
    lower-cased. Fewer words than k are one shingle; no words, none."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    s = np.full(len(words) - n + 1, MIX[0] * (n + 1) & (1 << 64) - 1, np.uint64)
    for j in range(n):
        s ^= h[j : len(h) - n + j + 1]
        s *= np.uint64(MIX[0])
        s ^= s >> np.uint64(29)
        s *= np.uint64(MIX[1])
        s ^= s >> np.uint64(32)
    return np.unique(s)


def texts_of(batch, column: int = 1) -> list:
    """The texts of an Arrow batch in UTF-8."""
    import pyarrow as pa

    return batch.column(column).cast(pa.binary()).to_pylist()
