"""Pattern packing of token pieces into fixed-length sequences.

Documents longer than ``capacity`` are cut into capacity-long pieces.  The
packing is planned on the histogram of piece lengths alone (at most
``capacity`` numbers, whatever the corpus size):

1. enumerate patterns of one to four lengths that fill a sequence exactly,
2. fit how often each is used to the histogram by non-negative least squares,
3. round the repeats down to what the histogram still has,
4. pack the residual histogram best-fit decreasing.

The plan says, for each length, which ranks among the pieces of that length go
to which sequences.  Spark ranks the pieces (a running count per task and
length, plus a prefix sum over tasks), so that no length, however common, is
gathered in one task and no token is shuffled.

Definite results: null or empty text is one piece holding the end id; an empty
table gives no rows; repeated rows are packed separately; equal lengths are
ranked by task and row order; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.session import materialize, shipped
from typesift.llm.tokens import encoder, vocabulary

CAPACITY = 2048
END_ID = 0
#: Patterns considered for each number of documents from three up.
MAX_PATTERNS = 6000
FIT_STEPS = 400

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


# ---- plan -----------------------------------------------------------------

def enumerate_patterns(hist: np.ndarray, max_patterns: int = MAX_PATTERNS) -> list[tuple[int, ...]]:
    """Length patterns (descending) that fill a sequence exactly; hist[n]: pieces of length n."""
    capacity = len(hist) - 1
    there = np.flatnonzero(hist)
    found = [(capacity,)] if hist[capacity] else []
    found += [(int(a), int(capacity - a)) for a in there if capacity - a <= a < capacity and hist[capacity - a]]
    # More documents: the longest and the most common lengths, completed to the full.
    common = there[np.argsort(-hist[there], kind="stable")][:256]
    few = common[:40]
    for heads in (np.stack(np.meshgrid(there, common, indexing="ij"), -1).reshape(-1, 2),
                  np.stack(np.meshgrid(common[:120], few, few, indexing="ij"), -1).reshape(-1, 3)):
        last = capacity - heads.sum(1)
        ok = (last > 0) & (last <= heads[:, -1]) & (np.diff(heads, axis=1) <= 0).all(1)
        heads, last = heads[ok], last[ok]
        ok = hist[last] > 0
        full = np.column_stack([heads[ok], last[ok]])
        weight = hist[full].min(1)
        # the scarcest member says how often a pattern can be used; longer first members come first in ties
        best = np.lexsort((-full[:, 0], -weight))[:max_patterns]
        found += [tuple(map(int, p)) for p in full[best]]
    return list(dict.fromkeys(found))


def fit_repeats(hist: np.ndarray, patterns: list[tuple[int, ...]], steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares of pattern repeats to the histogram (accelerated projected gradient)."""
    if not patterns:
        return np.zeros(0)
    width = max(map(len, patterns))
    member = np.zeros((len(patterns), width), dtype=np.int64)  # 0: no member
    for i, p in enumerate(patterns):
        member[i, : len(p)] = p
    goal = hist.astype(float)
    use = np.bincount(member.ravel(), minlength=len(hist)).astype(float)
    use[0] = 0
    rate = 1.0 / max(1.0, (np.where(member > 0, use[member], 0).sum(1)).max())
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(steps):
        made = np.bincount(member.ravel(), weights=np.repeat(y, width), minlength=len(hist))
        gap = made - goal
        gap[0] = 0
        nxt = np.maximum(0, y - rate * gap[member].sum(1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram, by groups of equal sequences: (lengths, repeats)."""
    capacity = len(left) - 1
    rooms: list[int] = []  # ascending free space of the open groups
    groups: list[tuple[tuple[int, ...], int]] = []

    def put(free: int, pattern: tuple[int, ...], n: int) -> None:
        i = bisect.bisect_left(rooms, free)
        rooms.insert(i, free)
        groups.insert(i, (pattern, n))

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                free, (pattern, have) = rooms.pop(i), groups.pop(i)
            else:
                free, pattern, have = capacity, (), n
            each = min(free // size, n)
            filled = min(have, n // each)
            put(free - each * size, pattern + (size,) * each, filled)
            if pattern and have > filled:
                put(free, pattern, have - filled)
            n -= filled * each
    return list(groups)


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; every piece of the histogram is in one."""
    left = hist.astype(np.int64).copy()
    patterns = enumerate_patterns(left)
    want = np.floor(fit_repeats(left, patterns)).astype(np.int64)
    out = []
    for i in np.argsort(-want, kind="stable"):
        if not want[i]:
            break
        sizes, times = np.unique(patterns[i], return_counts=True)
        n = int(min(want[i], (left[sizes] // times).min()))
        if n > 0:
            left[sizes] -= n * times
            out.append((patterns[i], n))
    return out + best_fit(left)


def slots(packing: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, repeats, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, n in packing:
        at = 0
        for size in pattern:
            rows.append((size, used.get(size, 0), n, sequence, at))
            used[size] = used.get(size, 0) + n
            at += size
        sequence += n
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


# ---- Spark ----------------------------------------------------------------

def _pieces(path: str, keep_space: bool, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep_space)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            for lo, hi, _, block in tb.blocks(b.column("text")):
                ids, n = enc.encode(block)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                begins = np.cumsum(n) - n
                many = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                flat = memoryview(ids).cast("B")
                at = begins[row] + start
                crc = [zlib.crc32(flat[4 * s:4 * e]) for s, e in zip(at.tolist(), (at + length).tolist())]
                # running count of each length in this task
                order = np.argsort(length, kind="stable")
                sizes, first, counts = np.unique(length[order], return_index=True, return_counts=True)
                k = np.empty(len(length), dtype=np.int64)
                k[order] = np.arange(len(length)) - np.repeat(first, counts) + np.repeat(seen[sizes], counts)
                seen[sizes] += counts
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(k)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return cut


def _place(table: np.ndarray, capacity: int):
    # ranks of one length lie next to each other: search on length * big + rank
    big = np.int64(1) << np.int64(48)
    keys = table[:, 0] * big + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            row = np.searchsorted(keys, b.column("length").to_numpy() * big + rank, side="right") - 1
            seq = table[row, 3] + rank - table[row, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(seq), pa.array(table[row, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer_path: str, keep_space: bool = False, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = shipped(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, keep_space, capacity, end_id), PIECE_SCHEMA), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        hist[r["length"]] = r["n"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("k"))
    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(_place(slots(plan(hist)), capacity),
                        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op8(docs: DataFrame) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"))
