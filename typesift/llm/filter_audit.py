"""Interaction audit of document filters by truth-table survival words.

Five filters A to E are judged on every whole text; a document's verdicts are
five bits.  They pick one 32-bit word: bit S is set if the document survives the
subset S of the filters (bit i of S: the i-th filter is on).  Positional
popcounts of the words, made with carry-save adders in the tasks that hold the
documents, say how many documents of a part survive each subset, all of them,
the good ones and the toxic ones.  Every figure of every order of the filters is
a difference of two of those counts, so orders cost nothing to compare.

Filters: A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] >
2 * code points; D any of ``#$%&*|``; E the text of a smaller doc_id.

Scale: texts are read once and only verdicts and digests leave the tasks.  E
compares SHA-256 digests: the smallest doc_id of each text (partial minima before
the shuffle) is joined back on (digest, doc_id), so copies of one text are spread
over all tasks.  Counts leave a task as one row of 96 numbers per part.

Definite results: a null text is empty, a null source the part ``''``; an empty
text has no words (fails A, not B, C or D); a row without a doc_id is neither
small nor large, so it never fails E and has no label; rows that repeat a doc_id
each count, and don't make each other fail E; a doc_id with several labels is
good (toxic) if any of them says so; empty documents give no rows, empty labels
zeros; other columns are ignored.  Texts over 1 MiB are measured in pieces cut at
white space (a longer word is one piece).  Distinct words are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.longtext import PIECE_BYTES, groups, pieces
from typesift.llm.session import materialize, shipped

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
ALL = SUBSETS - 1
MIN_WORDS = 200
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 8192
GROUPS = ("a", "g", "t")  # all, good, toxic

_POINTS = ~tb.byte_table(range(0x80, 0xC0))  # one byte of each code point
_UPPER = tb.byte_table(range(0x41, 0x5B))
_MARKS = tb.byte_table(b"#$%&*|")

#: SURVIVORS[verdicts]: the word whose bit S is set if none of S's filters fails.
SURVIVORS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], dtype=np.uint32)

ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Of each (order, step): its filter, and the filters before it as a subset.
_FILTER = np.array([[LETTERS.index(c) for c in o] for o in ORDERS])
_BEFORE = np.cumsum(1 << _FILTER, axis=1) - (1 << _FILTER)


# ---- verdicts -------------------------------------------------------------

def _counts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per text: letters A-Z, code points, marks; and the hashes of its words."""
    block = tb.Block(raw)
    starts, ends = block.runs(tb.NON_SPACE)
    words = np.split(block.hashes(starts, ends), block.first_of(starts)[1:-1]) if block.n else []
    return block.counts(_UPPER), block.counts(_POINTS) - 1, block.counts(_MARKS), words


def _long(raw: bytes) -> tuple[int, int, int, int, int]:
    """Letters A-Z, code points, marks, words and distinct words of a long text, piece by piece."""
    upper = points = marks = n = 0
    seen = np.zeros(0, dtype=np.uint64)
    for piece in pieces(raw):
        if len(piece) > PIECE_BYTES:  # one word
            data = np.frombuffer(piece, dtype=np.uint8)
            found = [int(t[data].sum()) for t in (_UPPER, _POINTS, _MARKS)]
            words = np.frombuffer(hashlib.blake2b(piece, digest_size=8).digest(), dtype=np.uint64)
        else:
            *found, words = (x[0] for x in _counts([piece]))
        upper, points, marks, n = upper + int(found[0]), points + int(found[1]), marks + int(found[2]), n + len(words)
        seen = np.union1d(seen, words)
    return upper, points, marks, n, len(seen)


def verdicts(raw: list[bytes]) -> np.ndarray:
    """Bits 0 to 3 of each text: the filters A to D that it fails."""
    small = [i for i, t in enumerate(raw) if len(t) <= PIECE_BYTES]
    m = np.zeros((5, len(raw)), dtype=np.int64)
    if small:
        upper, points, marks, words = _counts([raw[i] for i in small])
        m[:, small] = upper, points, marks, [len(w) for w in words], [len(set(w.tolist())) for w in words]
    for i, t in enumerate(raw):
        if len(t) > PIECE_BYTES:
            m[:, i] = _long(t)
    upper, points, marks, n, distinct = m
    return (n < MIN_WORDS) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * points) << 2 | (marks > 0) << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw in groups(b.column("text")):
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "part")), pa.array(verdicts(raw).astype(np.int32)),
                 pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())], names=["doc_id", "part", "fails", "digest"])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every row of documents(doc_id, source, text); fails: bits of A to E."""
    shipped(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(_judge, "doc_id long, part string, fails int, digest binary"), "verdicts")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc_id is not null and (good or toxic)")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(first, ["digest", "doc_id"], "left").join(one, "doc_id", "left")
            .select("part", F.when(copy, F.col("fails") + 16).otherwise(F.col("fails")).alias("fails"),
                    F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


# ---- positional popcounts -------------------------------------------------

def positional_popcounts(words: np.ndarray, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """counts[g, b]: how many words of group g have bit b; by carry-save adders.

    Three words of equal weight become a sum word and a carry word of twice the
    weight, in all groups at once, until no group has three of one weight left.
    """
    counts = np.zeros((n_groups, 32), dtype=np.int64)
    order = np.argsort(groups, kind="stable")
    words, groups, weight = words[order], groups[order], 0
    while len(words):
        carried: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            size = np.bincount(groups, minlength=n_groups)
            rank = np.arange(len(groups)) - (np.cumsum(size) - size)[groups]
            full = rank < (size - size % 3)[groups]
            if not full.any():
                break
            a, b, c = words[full].reshape(-1, 3).T
            own, half = groups[full][::3], a ^ b
            carried.append((a & b | c & half, own))
            words, groups = np.concatenate([half ^ c, words[~full]]), np.concatenate([own, groups[~full]])
            order = np.argsort(groups, kind="stable")
            words, groups = words[order], groups[order]
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        np.add.at(counts, groups, bits.astype(np.int64) << weight)
        words = np.concatenate([w for w, _ in carried]) if carried else words[:0]
        groups = np.concatenate([g for _, g in carried]) if carried else groups[:0]
        order = np.argsort(groups, kind="stable")
        words, groups, weight = words[order], groups[order], weight + 1
    return counts


_COUNT_COLUMNS = [f"{g}{s}" for g in GROUPS for s in range(SUBSETS)]


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def handed() -> pa.RecordBatch:
        table = np.array(list(held.values())).reshape(-1, len(_COUNT_COLUMNS))
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c) for c in table.T.copy())], names=["part", *_COUNT_COLUMNS])
        held.clear()
        return out

    for b in batches:
        coded = b.column("part").dictionary_encode()
        names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        word = SURVIVORS[b.column("fails").to_numpy()]
        good, toxic = (b.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
        found = np.hstack([positional_popcounts(word[m], part[m], len(names)) for m in (np.ones(len(word), dtype=bool), good, toxic)])
        for name, row in zip(names, found):
            held[name] = held[name] + row if name in held else row
        if len(held) > HELD_PARTS:
            yield handed()
    if held:
        yield handed()


def survivors(rows: DataFrame) -> DataFrame:
    """Per part: columns a0..a31, g0..g31, t0..t31, the documents (good, toxic ones) that survive each subset."""
    schema = "part string, " + ", ".join(f"{c} long" for c in _COUNT_COLUMNS)
    found = rows.mapInArrow(_popcounts, schema)
    return found.groupBy("part").agg(*[F.sum(c).alias(c) for c in _COUNT_COLUMNS])


# ---- orders ---------------------------------------------------------------

AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
                "good_lost long, toxic_lost long, shapley long")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f, before = _FILTER.ravel(), _BEFORE.ravel()
    after = before | 1 << f
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            own = b.slice(lo, 256)
            n = own.num_rows
            a, g, t = (np.stack([own.column(f"{x}{s}").to_numpy() for s in range(SUBSETS)], axis=1) for x in GROUPS)
            removed = a[:, before] - a[:, after]
            shapley = np.stack([removed[:, f == i].sum(1) for i in range(len(LETTERS))], axis=1)
            found = (a[:, after], removed, (a[:, :1] - a[:, 1 << f]) - removed, a[:, ALL & ~(1 << f)] - a[:, [ALL]],
                     g[:, before] - g[:, after], t[:, before] - t[:, after], shapley[:, f])
            yield pa.RecordBatch.from_arrays(
                [own.column("part").take(pa.array(np.repeat(np.arange(n), len(f)))),
                 pa.array(np.repeat(ORDERS, len(LETTERS)).tolist() * n, pa.string()),
                 pa.array(np.tile(np.arange(1, len(LETTERS) + 1, dtype=np.int32), len(ORDERS) * n)),
                 *(pa.array(x.ravel()) for x in found)],
                names=[c.split()[0] for c in AUDIT_SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    return survivors(judged(docs, labels)).mapInArrow(_orders, AUDIT_SCHEMA)


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)
