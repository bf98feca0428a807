"""Prefix sums over a linked list that is spread over many tasks.

Each element names the next one.  A level of contraction deals the elements out by
ranges of their numbers; a task joins those of its own elements that follow each
other into segments (pointer doubling over arrays) and keeps one element of each,
its head, with the sums of the segment.  The heads are a shorter list, which is
contracted again.  Numbers that run along the list leave about as many heads as
there are tasks.  Where they don't, and a level leaves more than half, elements
are paired by coin flips (each that flips tails joins a predecessor that flips
heads), which takes about a quarter away, whatever the numbers are.  The last
level is one segment; sums are then handed down level by level by joins.

No task holds more than about ``task_rows`` elements, at any level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.llm.session import materialize, shipped

TASK_ROWS = 1 << 18

_SEGMENTS = "a long, head long, o1 long, o2 long, next long, w1 long, w2 long"


def segments(a: np.ndarray, following: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each element (ascending a; following: the next one's number or -1): place of its segment's head, sums before it in the segment;
    of each head: the number that follows its segment, sums of the segment."""
    n = len(a)
    at = np.minimum(np.searchsorted(a, following), n - 1)
    own = (following >= 0) & (a[at] == following)
    head = np.arange(n)
    head[at[own]] = np.flatnonzero(own)  # the predecessor, or itself
    lone = head == np.arange(n)
    before = [np.where(lone, 0, w[head]) for w in (w1, w2)]
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        before = [o + o[head] for o in before]
        head = further
    tail = np.flatnonzero(~own)
    last = np.full(n, -1, dtype=np.int64)
    total = [np.zeros(n, dtype=np.int64) for _ in range(2)]
    last[head[tail]] = following[tail]
    for t, o, w in zip(total, before, (w1, w2)):
        t[head[tail]] = o[tail] + w[tail]
    return head, *before, last, *total


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)  # bounded by task_rows
    if not sum(b.num_rows for b in rows):
        return
    a, following, w1, w2 = (np.concatenate([b.column(c).fill_null(-1).to_numpy() for b in rows]) for c in ("a", "next", "w1", "w2"))
    order = np.argsort(a)
    a, following, w1, w2 = a[order], following[order], w1[order], w2[order]
    head, o1, o2, last, t1, t2 = segments(a, following, w1, w2)
    out = pa.table([pa.array(a), pa.array(a[head]), pa.array(o1), pa.array(o2), pa.array(last, mask=last < 0), pa.array(t1), pa.array(t2)],
                   names=["a", "head", "o1", "o2", "next", "w1", "w2"])
    yield from out.to_batches(max_chunksize=1 << 16)


def _by_ranges(rows: DataFrame, n_rows: int, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """(element to head, heads) after joining what lies in one range of numbers."""
    tasks = -(-n_rows // task_rows)
    dealt = rows.repartition(1) if tasks == 1 else rows.repartitionByRange(tasks, "a")
    found = materialize(dealt.mapInArrow(_contract, _SEGMENTS), "segments")
    return found.select("a", "head", "o1", "o2"), found.where("a = head").select("a", "next", "w1", "w2")


def _by_coins(rows: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(element to head, heads) after joining elements to predecessors by coin flips."""
    flipped = rows.withColumn("tails", F.pmod(F.xxhash64(F.lit(turn), F.col("a")), F.lit(2)) == 1)
    pred = flipped.where("not tails and next is not null").select(F.col("a").alias("head"), F.col("next").alias("a"), F.col("w1").alias("o1"), F.col("w2").alias("o2"))
    joined = materialize(flipped.where("tails").join(pred, "a"), "coins")  # those that go, and into which head
    kept = flipped.join(joined.select("a"), "a", "left_anti").drop("tails")
    more = joined.select(F.col("head").alias("a"), F.col("next").alias("n"), F.col("w1").alias("v1"), F.col("w2").alias("v2"), F.lit(True).alias("took"))
    heads = kept.join(more, "a", "left").select(
        "a", F.when(F.col("took"), F.col("n")).otherwise(F.col("next")).alias("next"),
        *[(F.col(f"w{i}") + F.coalesce(f"v{i}", F.lit(0))).alias(f"w{i}") for i in (1, 2)])
    zero = F.lit(0).cast("long")
    to_head = joined.select("a", "head", "o1", "o2").unionByName(kept.select("a", F.col("a").alias("head"), zero.alias("o1"), zero.alias("o2")))
    return materialize(to_head, "coins"), materialize(heads, "coins")


def prefix_sums(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, o1, o2): sums of w1 and w2 over the elements before ``a``.

    rows(a, next, w1, w2) must be one list: distinct a, next null at its end.
    """
    shipped(rows.sparkSession)
    levels, n, turn = [], rows.count(), 0
    if not n:
        return rows.select("a", F.col("w1").alias("o1"), F.col("w2").alias("o2"))
    while True:
        to_head, heads = _by_ranges(rows, n, task_rows)
        levels.append(to_head)
        left = heads.count()
        if left == 1:
            break
        if n <= task_rows and left == n:
            raise ValueError("the rows are not one list")
        if 2 * left > n:
            turn += 1
            to_head, heads = _by_coins(heads, turn)
            levels.append(to_head)
            left = heads.count()
        rows, n = heads, left
    found = levels.pop().select("a", "o1", "o2")
    for level in reversed(levels):
        above = found.select(F.col("a").alias("head"), F.col("o1").alias("p1"), F.col("o2").alias("p2"))
        found = level.join(above, "head").select("a", (F.col("o1") + F.col("p1")).alias("o1"), (F.col("o2") + F.col("p2")).alias("o2"))
    return found
