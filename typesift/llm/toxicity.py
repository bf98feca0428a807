"""Toxicity by a character n-gram classifier on naive Bayes features.

Features are the presence of character n-grams (``SIZES`` bytes of one line,
A-Z lower-cased, hashed into ``2**BITS`` buckets), each scaled by its log ratio
of smoothed document shares between the two classes.  A logistic regression
with an L1 penalty is fitted to the scaled features (accelerated proximal
gradient), so few n-grams keep a weight and scoring is a table look-up.

The fit uses at most ``MAX_TOXIC + MAX_CLEAN`` labelled documents, chosen by a
hash of doc_id, each with one text; every text is scored whole.

Definite results: null or empty texts get the score of no n-grams; without
labelled rows of both classes the score is the share of toxic labels (0 without
any); labels that are null or without a document are not used; a doc_id labelled
both ways is toxic; of the texts of one doc_id that with the least hash is fitted;
a null doc_id is held out; repeated rows are each scored; an empty table gives no rows; other
columns are ignored by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.session import shipped

SIZES = (3, 5, 7)
BITS = 20
FOLDS = 5
MAX_TOXIC = 2000
MAX_CLEAN = 4000
#: An n-gram is a feature if so many sampled documents have it, and its log ratio is that far from 0.
MIN_DOCUMENTS = 3
MIN_RATIO = 1.0
PENALTY = 3e-4
STEPS = 200

_FOLDED = tb.FOLDED_VALUES.copy()
_FOLDED[[0x09, 0x0B, 0x0C, 0x0D]] = _FOLDED[0x20]  # other white space as the space


def grams(block: tb.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (bucket at each place, places where an n-gram of one line begins)."""
    values = _FOLDED[block.data]
    breaks = block.data == 0x0A
    h, broken = values, breaks
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint64(tb.BASE) + values[n - 1:]
        broken = broken[:-1] | breaks[n - 1:]
        if n in SIZES:
            yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64), ~broken


def _features(one: bytes) -> np.ndarray:
    """The distinct buckets of a text."""
    found = [b[ok].astype(np.int32) for b, ok in grams(tb.Block([one]))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


def fit(texts: list[bytes], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, their weights with the ratio multiplied in, intercept)."""
    n, n1 = len(texts), int(toxic.sum())
    none = np.zeros(0, dtype=np.int64), np.zeros(0)
    if not 0 < n1 < n:
        share = min(max(n1 / n if n else 0.0, 1e-6), 1 - 1e-6)
        return *none, float(np.log(share / (1 - share)))
    size = 1 << BITS
    df = np.zeros((2, size), dtype=np.int32)
    for y, one in zip(toxic.tolist(), texts):
        df[y, _features(one)] += 1
    ratio = np.log((df[1] + 1) / (n1 + 2)) - np.log((df[0] + 1) / (n - n1 + 2))
    used = (df.sum(0) >= MIN_DOCUMENTS) & (np.abs(ratio) >= MIN_RATIO)
    place = np.full(size, -1, dtype=np.int32)
    buckets = np.flatnonzero(used)
    if not len(buckets):
        return *none, float(np.log(n1 / (n - n1)))
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    # a second look at the texts costs time, not the memory of all their features
    found = [place[f[used[f]]] for f in map(_features, texts)]
    col = np.concatenate(found)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in found])
    del found, df
    r = ratio[buckets]
    x = r[col].astype(np.float32)
    y = toxic.astype(float)
    # each class counts the same, whatever the sample's shares
    weight = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))
    # step: 1 over a bound of the curvature, by power iteration
    v = np.ones(len(buckets))
    for _ in range(15):
        u = np.bincount(row, weights=x * v[col], minlength=n) * weight
        v = np.bincount(col, weights=x * u[row], minlength=len(buckets))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (0.25 * max(top, 1e-9) * 1.1 + 0.25)
    w = z = np.zeros(len(buckets))
    b = zb = 0.0
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=x * z[col], minlength=n) + zb, -35, 35)))
        gap = (p - y) * weight
        w2 = z - step * np.bincount(col, weights=x * gap[row], minlength=len(buckets))
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * PENALTY, 0)
        b2 = zb - step * gap.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    kept = np.flatnonzero(w)
    return buckets[kept], (w * r)[kept], float(b)


def score_block(block: tb.Block, table: np.ndarray, intercept: float) -> np.ndarray:
    """Scores of the block's texts; table: weight of each bucket."""
    some = table != 0
    keys = []
    for bucket, ok in grams(block):
        at = np.flatnonzero(some[bucket] & ok)
        doc = np.searchsorted(block.bounds, at, side="right") - 1
        keys.append((doc << BITS) | bucket[at])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)  # presence, not counts
    total = np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=block.n) + intercept
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled documents outside the held-out fold."""
    shipped(docs.sparkSession)
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id"))))
    def some(y, n):
        return known.where(F.col("toxic") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = some(1, max_toxic).unionByName(some(0, max_clean)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # one text an id, so an id on very many rows counts no more than another; partial aggregation comes before the shuffle
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, y = [], []
        for b in batches:
            raw += [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            y += b.column("toxic").to_pylist()
        buckets, weights, intercept = fit(raw, np.array(y, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([buckets.tolist()], pa.list_(pa.int64())), pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([intercept])],
            names=["buckets", "weights", "intercept"])

    model = rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, "buckets array<long>, weights array<double>, intercept double").first()
    if model is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -20.0
    return np.array(model["buckets"], dtype=np.int64), np.array(model["weights"]), model["intercept"]


def _scores(model: tuple[np.ndarray, np.ndarray, float], column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    table = np.zeros(1 << BITS)
    table[model[0]] = model[1]
    for lo, hi, _, block in tb.blocks(column):
        yield lo, hi, score_block(block, table, model[2])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score for every document."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, s in _scores(model, b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with all their columns."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, s in _scores(model, b.column("text")):
                yield b.slice(lo, hi - lo).filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
