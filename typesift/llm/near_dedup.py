"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

Words are runs without white space, A-Z lower-cased; a document's set holds
its distinct ``SHINGLE``-word shingles (a shorter text is one shingle).  Two
documents are linked when 100 * intersection >= percent * union of the sets;
op3 has ``PERCENT``.

1. A signature has ``LANES`` lanes of 16 bits.  The join guarantees all pairs
   that differ in at most ``MAX_DISTANCE`` lanes: with ``CHUNKS`` chunks one
   chunk differs in at most MAX_DISTANCE // CHUNKS lanes, so each chunk is
   indexed once for every choice of lanes left out.  At a similarity of 0.85 a
   pair differs in more than 15 of 32 lanes with a probability of 3e-6.  Other
   thresholds (``lane_join``) take as many chunks as keep that under ``MISSED``:
   for 0.8 ten chunks and 19 lanes, with a probability of 2e-7.
2. Equal sets are one class before that, numbered, and first seen in the
   smallest (doc_id, hash of the text).  Within a bucket of the index, a
   breadth-first search over signature distances gives the edges of a spanning
   forest, never all pairs; their components are families.
3. Each family's whole texts are fetched once; a search over exact set
   similarities gives the forest of confirmed links, whose components are the
   result.  Buckets and families over a bound are dealt out by pairs of blocks,
   so every pair still meets in one task of bounded memory.

Definite results: null or empty texts have no set and are linked with nothing;
a row with a null doc_id is linked with nothing and has a null component;
repeated rows are each returned by ``near_duplicates``; rows that repeat a
doc_id with different texts are linked each by its own text; equal texts share a
component; ties (a similarity of exactly the threshold) are links; an empty
table gives no rows; columns other than doc_id and text are ignored by
``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.components import components
from typesift.llm.session import materialize, shipped

SHINGLE = 5
PERCENT = 85
LANES = 32
CHUNKS = 8
MAX_DISTANCE = 15
#: Members of a bucket, and shingles of a family, that one task compares at once.
BUCKET_BLOCK = 4096
FAMILY_BLOCK = 4_000_000

#: Least threshold, and the largest probability of missing a pair of exactly the threshold.
MIN_PERCENT = 80
MISSED = 4e-6


class LaneJoin(NamedTuple):
    """A threshold, the lanes in which a pair may differ, and the lanes of each key of the index."""

    percent: int
    distance: int
    keep: list[tuple[int, ...]]


def lane_join(percent: int = PERCENT) -> LaneJoin:
    """The join that meets pairs of ``percent`` or more: one lane of each chunk may differ."""
    if not MIN_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {MIN_PERCENT} to 100, not {percent}")
    p = percent / 100

    def missed(distance):
        return sum(math.comb(LANES, k) * (1 - p) ** k * p ** (LANES - k) for k in range(distance + 1, LANES + 1))

    chunks = CHUNKS
    while missed(2 * chunks - 1) > MISSED:
        chunks += 1
    bounds = [i * LANES // chunks for i in range(chunks + 1)]
    return LaneJoin(percent, 2 * chunks - 1, [c for lo, hi in zip(bounds, bounds[1:])
                                              for c in itertools.combinations(range(lo, hi), hi - lo - 1)])


_KEEP = lane_join().keep


def shingle_sets(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, ascending within a text; first of each text)."""
    starts, ends = block.runs(tb.NON_SPACE)
    words = block.hashes(starts, ends, tb.FOLDED_VALUES)
    first = block.first_of(starts)
    h, doc, _ = tb.shingles(words, first, SHINGLE)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    if len(short):
        one = np.array([_sequence(words[first[i]:first[i + 1]]) for i in short.tolist()], dtype=np.uint64)
        h, doc = np.concatenate([h, one]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    at = np.searchsorted(doc, np.arange(block.n + 1))
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        h[s:e].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(block.n + 1))


def _sequence(words: np.ndarray) -> int:
    h = np.uint64(len(words))  # a whole short text never equals a shingle of SHINGLE words
    with np.errstate(over="ignore"):
        for w in words:
            h = tb.mix(np.array([h * np.uint64(tb.BASE) + w]))[0]
    return h


def set_keys(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, equal for equal sets; None for an empty one."""
    full = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        sums = np.empty((len(full), 2), dtype=np.uint64)
        sums[:, 0] = np.add.reduceat(tb.mix(h ^ np.uint64(0x1B873593A5A5A5A5)), at[full])
        sums[:, 1] = np.add.reduceat(tb.mix(h + np.uint64(0x52DCE729DA3ED5C1)), at[full])
        raw = sums.tobytes()
        for j, i in enumerate(full.tolist()):
            out[i] = raw[16 * j:16 * j + 16]
    return out


_LANE_XOR = tb.mix(np.arange(101, 101 + LANES, dtype=np.uint64))
_LANE_MUL = tb.mix(np.arange(1, 1 + LANES, dtype=np.uint64)) | np.uint64(1)


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """LANES 16-bit values for each set: bits of the least hash under each of LANES hash functions."""
    out = np.zeros((len(at) - 1, LANES), dtype="<u2")
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for lane in range(LANES):
            x = (h ^ _LANE_XOR[lane]) * _LANE_MUL[lane]
            out[full, lane] = (np.minimum.reduceat(x, at[full]) >> np.uint64(20)).astype("<u2")
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, _, block in tb.blocks(b.column("text")):
            h, at = shingle_sets(block)
            raw = signatures(h, at).tobytes()
            keys = set_keys(h, at)
            sigs = [None if k is None else raw[2 * LANES * i:2 * LANES * (i + 1)] for i, k in enumerate(keys)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(lo, hi - lo), b.column("text_hash").slice(lo, hi - lo), pa.array(np.diff(at)),
                 pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "sig"])


def _index(batches: Iterator[pa.RecordBatch], keep: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """The bucket keys of each class: for each chunk, the lanes that are left after the allowed errors."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u2").reshape(-1, LANES).astype(np.uint64)
        rep = b.column("rep").to_numpy()
        for i, lanes in enumerate(keep):
            key = np.full(len(sig), i + 1, dtype=np.uint64)
            for lane in lanes:
                key = tb.mix(key * np.uint64(tb.BASE) + sig[:, lane])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep)], names=["key", "rep"])


def _forest(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of ``range(n)``; near(x, others): which of others x is joined to."""
    left = np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            for y in left[hit].tolist():
                yield x, y
                queue.append(y)
            left = left[~hit]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], read) -> Iterator[list]:
    """Rows of consecutive equal keys, as lists of what ``read(batch)`` gives for each row."""
    now, rows = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        items = read(b)
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(c[s] for c in cols)
            if key != now:
                if len(rows) > 1:
                    yield rows
                now, rows = key, []
            rows.extend(items[s:e])
    if len(rows) > 1:
        yield rows


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])


def _sizes_near(size: np.ndarray, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    a, b = size[x], size[others]
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _bucket_edges(batches: Iterator[pa.RecordBatch], join: LaneJoin) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the buckets under signature distance (and set sizes that allow a link)."""
    def read(b):
        return list(zip(b.column("rep").to_pylist(), b.column("n").to_pylist(), b.column("sig").to_pylist()))

    out: list[tuple[int, int]] = []
    for rows in _groups(batches, ["key", "i", "j"], read):
        rep = [r[0] for r in rows]
        size = np.array([r[1] for r in rows])
        sig = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u2").reshape(-1, LANES)
        near = lambda x, others: ((sig[others] != sig[x]).sum(1) <= join.distance) & _sizes_near(size, x, others, join.percent)  # noqa: E731, B023
        out.extend((rep[x], rep[y]) for x, y in _forest(len(rows), near))
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _confirmed_edges(batches: Iterator[pa.RecordBatch], join: LaneJoin) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the families under exact set similarity."""
    def read(b):
        items = []
        for lo, hi, _, block in tb.blocks(b.column("text")):
            h, at = shingle_sets(block)
            keys = set_keys(h, at)
            for i, (rep, key, sig) in enumerate(zip(*(b.column(c).slice(lo, hi - lo).to_pylist() for c in ("rep", "set_key", "sig")))):
                # another text with the same doc_id is not the class's
                items.append((rep, h[at[i]:at[i + 1]].copy(), sig) if keys[i] == key else None)
        return items

    out: list[tuple[int, int]] = []
    for rows in _groups(batches, ["family", "i", "j"], read):
        rows = list({r[0]: r for r in rows if r is not None}.values())
        if len(rows) < 2:
            continue
        rep = [r[0] for r in rows]
        size = np.array([len(r[1]) for r in rows])
        sig = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u2").reshape(-1, LANES)
        distinct, codes = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(len(distinct), dtype=bool)

        def near(x, others):
            hit = ((sig[others] != sig[x]).sum(1) <= join.distance) & _sizes_near(size, x, others, join.percent)
            some = others[hit]
            if len(some):
                mine = codes[at[x]:at[x + 1]]
                mark[mine] = True
                if len(some) < 8:
                    common = np.array([np.count_nonzero(mark[codes[at[o]:at[o + 1]]]) for o in some.tolist()])
                else:
                    n = size[some]
                    where = np.repeat(at[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    common = np.add.reduceat(mark[codes[where]].astype(np.int64), np.cumsum(n) - n)
                mark[mine] = False
                hit[hit] = 100 * common >= join.percent * (size[x] + size[some] - common)
            return hit

        out.extend((rep[x], rep[y]) for x, y in _forest(len(rows), near))
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _block_pairs(rows: DataFrame, blocks) -> DataFrame:
    """Repeat each row for the pairs of blocks (i, j) that its own block is in."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    return (rows.withColumn("blocks", blocks).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, first: for each row, the (doc_id, text_hash) that stays of its group.

    ``first`` is null for rows that are linked with nothing because they have no doc_id or no word.
    """
    join = lane_join(percent)
    shipped(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    described = materialize(
        texts.mapInArrow(_describe, "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary"), "signatures")
    classes = materialize(
        described.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes")

    index = classes.select("sig", "rep").mapInArrow(partial(_index, keep=join.keep), "key long, rep long")
    shared = index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = index.join(shared, "key").join(classes.select("rep", "n", "sig"), "rep")
    members = _block_pairs(members, F.ceil(F.col("members") / BUCKET_BLOCK))
    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    edges = dealt.select("key", "i", "j", "rep", "n", "sig").mapInArrow(partial(_bucket_edges, join=join), "a long, b long")
    families = materialize(components(edges), "families").withColumnsRenamed({"node": "rep", "root": "family"})

    family = families.join(classes, "rep")
    sizes = family.groupBy("family").agg(F.sum("n").alias("weight"))
    family = _block_pairs(family.join(sizes, "family"), F.ceil(F.col("weight") / FAMILY_BLOCK))
    family = family.withColumns({"doc_id": F.col("first.doc_id"), "text_hash": F.col("first.text_hash")})
    dealt = (family.join(texts, ["doc_id", "text_hash"])
             .select("family", "i", "j", "rep", "set_key", "sig", "text")
             .repartition("family", "i", "j").sortWithinPartitions("family", "i", "j"))
    links = materialize(components(dealt.mapInArrow(partial(_confirmed_edges, join=join), "a long, b long")), "links")

    linked = links.withColumnRenamed("node", "rep").join(classes.select("rep", "set_key", "first"), "rep")
    firsts = linked.groupBy("root").agg(F.min("first").alias("group_first"))
    roots = classes.select("set_key", "first").join(linked.select("set_key", "root").join(firsts, "root"), "set_key", "left").select(
        "set_key", F.coalesce("group_first", "first").alias("first"))
    out = described.join(roots, "set_key", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    out = _linked(docs, percent).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns.

    Rows are told apart by doc_id and text: of rows that repeat a doc_id those
    whose own text is no copy stay, and of rows equal in both, one (any one, if
    other columns differ).  Rows without a doc_id or a word all stay.
    """
    linked = materialize(_linked(docs, percent).where("first is not null").groupBy("doc_id", "text_hash")
                         .agg(F.min("first").alias("first"), F.count("*").alias("rows")), "linked")
    linked = linked.withColumnsRenamed({"doc_id": "doc_id_", "text_hash": "text_hash_"})
    stays = F.struct("doc_id_", "text_hash_") == F.col("first")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no clash with the joined columns
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    same = (doc_id.cast("long") == F.col("doc_id_")) & (F.xxhash64(text.cast("string")) == F.col("text_hash_"))
    out = plain.join(linked.where(~stays | (F.col("rows") > 1)).select("doc_id_", "text_hash_"), same, "left_anti")
    repeats = linked.where(stays & (F.col("rows") > 1)).select("doc_id_", "text_hash_")
    if not repeats.isEmpty():
        one = plain.join(repeats, same).dropDuplicates(["doc_id_", "text_hash_"])
        out = out.unionByName(one.drop("doc_id_", "text_hash_"))
    return out.toDF(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
