"""Numpy views of a batch of texts, for use inside Spark tasks.

A :class:`Block` holds the UTF-8 bytes of some texts, each followed by one
newline byte, so that words, lines and runs are found with a few array
operations over the whole block instead of a Python loop over words.  Word
and line values are compared by a 64-bit polynomial hash of their bytes.

Memory: about 60 bytes of scratch per text byte of one block.  A block holds
``BLOCK_BYTES`` of text, or a single longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and multiply rounds)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


#: A pseudo-random 64-bit value for each byte.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + U64(1)) * U64(BASE))


def byte_table(members: bytes | range | set[int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


#: ``[^\x20\x09-\x0D]``
NON_SPACE = ~byte_table({0x20, *range(0x09, 0x0E)})
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased
ALNUM = byte_table({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})
NON_NEWLINE = ~byte_table({0x0A})

_lower = np.arange(256)
_lower[0x41:0x5B] += 32
#: Byte values under which A-Z equal a-z.
FOLDED_VALUES = BYTE_VALUES[_lower]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per process, grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 65536)
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


class Block:
    """Texts ``raw``; text i is ``data[bounds[i]:bounds[i + 1] - 1]``."""

    def __init__(self, raw: list[bytes]):
        self.n = len(raw)
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=self.n)
        self.bytes = b"\n".join(raw) + b"\n"
        self.data = np.frombuffer(self.bytes, dtype=np.uint8)
        self.bounds = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(lens + 1, out=self.bounds[1:])

    def runs(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes in ``members``.

        The newline after each text must not be a member.
        """
        inside = members[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        return edges[0::2], edges[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the newline-separated lines (empty ones too)."""
        ends = np.flatnonzero(self.data == 0x0A)
        starts = np.empty_like(ends)
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
        return starts, ends

    def first_of(self, starts: np.ndarray) -> np.ndarray:
        """``f`` with the runs of text i at f[i]:f[i + 1]."""
        return np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """A 64-bit value for each run, equal for equal bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        x = values[self.data]
        x *= _power(BASE, n)
        np.cumsum(x, out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power(BASE_INVERSE, n)[starts]
        return mix(h ^ (ends - starts).astype(np.uint64))

    def counts(self, members: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in ``members`` (newlines must not be)."""
        return np.add.reduceat(members[self.data].astype(np.int32), self.bounds[:-1]).astype(np.int64)


def per_text(first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` over the runs of each text; see Block.first_of."""
    total = np.zeros(len(weights) + 1, dtype=np.int64)
    np.cumsum(weights, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each run belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a text: (hash, text, position of the first word)."""
    n = len(words)
    if n < k:
        return (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    doc = owners(first)
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1:])
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        h = h * U64(BASE) + words[at + i]
    return mix(h), doc[at], at


def blocks(texts: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes], Block]]:
    """(first row, end row, texts, block) over a string column; null is empty.

    Only one block's texts are Python objects at a time.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    lo = 0
    while lo < len(size):
        before = int(ends[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        raw = [t or b"" for t in texts.slice(lo, hi - lo).cast(kind).to_pylist()]
        yield lo, hi, raw, Block(raw)
        lo = hi
