"""Whole texts in bounded steps: groups of short texts, and long texts cut into pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest text, in bytes, that is measured at once.
PIECE_BYTES = 1 << 20
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def groups(texts: pa.Array | pa.ChunkedArray, max_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) over a string column, ``max_bytes`` or one text each; null is empty."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, int(ends[lo] - size[lo]) + max_bytes, side="right")))
        yield lo, hi, [t or b"" for t in texts.slice(lo, hi - lo).cast(kind).to_pylist()]
        lo = hi


def pieces(raw: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of at most ``limit`` bytes, cut after white space; a longer word is one piece."""
    lo = 0
    while len(raw) - lo > limit:
        cut = max(raw.rfind(c, lo, lo + limit) for c in SPACES) + 1
        if not cut:
            cut = min((at for c in SPACES if (at := raw.find(c, lo + limit)) >= 0), default=len(raw))
        yield raw[lo:cut]
        lo = cut
    yield raw[lo:]
