"""The prefix trie of rebuilt conversations, measured by the Euler-tour technique.

Conversation c begins with the first h(c) turns of conversation c - c % 5 and goes
on with its own turns after its first h(c); h(c) = crc32(decimal c) % 9.  A node is
a distinct sequence of first turns.

1. Turns become 128-bit digests of (role, text); texts are not moved any further.
   They are numbered within their conversation by a range sort, so that a
   conversation of any length is spread over tasks; what a task must know of the
   tasks before it is one row a task.
2. A node's key is the exclusive-or of one term for each (turn, place) of its
   sequence, in two lanes of 64 bits: prefix sums over the turns, put together from
   tasks as the numbers are.  The parent's key is the key without the last term.
3. Members are folded into nodes (partial aggregates first), and nodes numbered in
   the order of (smallest member, depth), so that most of a subtree has numbers
   next to each other.
4. Each node has an arc into it and one out of it.  Siblings sorted by range give
   the next arc of each; the arcs are one list, the tour.
5. ``list_rank`` ranks it.  The weights lie on the arcs out; a subtree's leaves and
   savings are the difference of the sums at its top's two arcs, and its own.

ends_sha256 hashes the members that end in a node: node by node in the tasks of a
range sort; only a node that lies over the end of a task's range is hashed from the
texts of several tasks, in order, one row a task (a hash is sequential).

Definite results: turns are ordered by turn (null first), equal ones by the SHA-256
of role and text; null role or text is empty; rows without a conv_id belong to no
conversation; c % 5 has the sign of c; an empty table has no nodes, not even a
root; repeated rows are turns of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typesift.llm import list_rank
from typesift.llm.session import materialize, partitions, shipped

FAMILY = 5
HEAD_MODULUS = 9
#: Rows that a task of a range sort is meant to get at most.
RANGE_ROWS = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _ranges(rows: DataFrame) -> int:
    return max(partitions(rows.sparkSession), -(-rows.count() // RANGE_ROWS))


def _term(digest: Column, place: Column) -> list[Column]:
    """The two lanes of a turn at a place."""
    place = place.cast("long")
    return [F.xxhash64(digest, place), F.xxhash64(place, F.lit("second lane"), digest)]


# ---- rebuilt conversations ------------------------------------------------

def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation within this task."""
    part, last, had = TaskContext.get().partitionId(), None, 0
    for b in batches:
        conv = b.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.concatenate(([True], conv[1:] != conv[:-1]))
        k = np.arange(len(conv))
        place = k - np.maximum.accumulate(np.where(new, k, 0)) + 1
        if conv[0] == last:
            place[:int(np.argmax(np.append(new[1:], True))) + 1] += had
        last, had = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(conv), part, dtype=np.int32)), pa.array(place), *(b.column(c) for c in ("digest", "n_bytes"))],
                                         names=["conv_id", "part", "place", "digest", "n_bytes"])


def members(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes, ends): every rebuilt conversation in each of its nodes.

    k: the node's key, p: its parent's (the root: null); ends: whether the
    conversation has no further turn.
    """
    spark = shipped(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    turns = materialize(turns, "turns")
    order = ["conv_id", "turn", "digest"]
    sorted_turns = turns.repartitionByRange(_ranges(turns), *order).sortWithinPartitions(*order)
    own = materialize(sorted_turns.mapInArrow(_number, "conv_id long, part int, place long, digest binary, n_bytes long"), "numbered")

    # one block: the turns of one conversation in one task; at most one block a task is not its conversation's first
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "part").agg(F.max("place").alias("n")).select(
        "conv_id", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), "n")
    blocks = materialize(blocks, "blocks")
    later = F.broadcast(blocks.where("before > 0").select("conv_id", "part", "before"))  # at most one row a task
    most = HEAD_MODULUS - 1
    opening = (own.where(F.col("place") <= most).join(later, ["conv_id", "part"], "left")
               .withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).where(F.col("place") <= most))
    opening = opening.groupBy(F.col("conv_id").alias("base")).agg(  # a few turns a conversation
        F.array_sort(F.collect_list(F.struct("place", "digest", "n_bytes"))).alias("opening"))

    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD_MODULUS)).cast("int")
    convs = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(opening, "base", "left").withColumn("opening", F.when(F.col("opening").isNull() | (F.col("h") == 0), F.array().cast(
        "array<struct<place:bigint,digest:binary,n_bytes:bigint>>")).otherwise(F.slice("opening", F.lit(1), F.greatest(F.col("h"), F.lit(1)))))
    terms = F.transform("opening", lambda t: F.struct(*[x.alias(f"t{i}") for i, x in enumerate(_term(t["digest"], t["place"]), 1)], t["n_bytes"].alias("n_bytes")))
    convs = convs.withColumn("terms", terms).withColumn("depth", F.size("opening").cast("long"))
    convs = convs.withColumn("total", F.col("depth") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))

    def upto(lane: str, i: Column) -> Column:
        return F.aggregate(F.slice("terms", F.lit(1), i), F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[lane]))

    convs = convs.withColumn("x1", upto("t1", F.size("terms"))).withColumn("x2", upto("t2", F.size("terms")))
    convs = materialize(convs.select("conv_id", "h", "depth", "total", "terms", "x1", "x2"), "conversations")
    shared = convs.select("conv_id", "total", "terms", F.posexplode("terms").alias("i", "t"))
    shared = shared.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "total", *[upto(f"t{j}", F.col("i") + 1).alias(f"k{j}") for j in (1, 2)],
                           F.col("t.t1").alias("t1"), F.col("t.t2").alias("t2"), F.col("t.n_bytes").alias("n_bytes"))

    # own turns: running keys within each block, then what the blocks before it add
    info = blocks.select("conv_id", "part", "before").join(convs.select("conv_id", "h", "depth", "total", "x1", "x2"), "conv_id")
    rows = own.join(info, ["conv_id", "part"]).withColumn("place", F.col("place") + F.col("before")).where("place > h")
    rows = rows.withColumn("depth", F.col("depth") + F.col("place") - F.col("h"))
    t1, t2 = _term(F.col("digest"), F.col("depth"))
    rows = rows.withColumn("t1", t1).withColumn("t2", t2)
    w = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "part", "depth", "total", "t1", "t2", *[F.bit_xor(f"t{i}").over(w).bitwiseXOR(F.col(f"x{i}")).alias(f"k{i}") for i in (1, 2)], "n_bytes")
    rows = materialize(rows, "running")
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2")).select(
        "conv_id", "part", F.bit_xor("s1").over(w).alias("o1"), F.bit_xor("s2").over(w).alias("o2"))
    earlier = F.broadcast(materialize(earlier.where("o1 is not null"), "earlier"))  # at most one row a task
    zero = F.lit(0).cast("long")
    rows = rows.join(earlier, ["conv_id", "part"], "left").withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"o{i}", zero)) for i in (1, 2)})

    columns = ["conv_id", "depth", "total", "k1", "k2", "p1", "p2", "n_bytes"]
    parents = {f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")) for i in (1, 2)}
    none = F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), "total", zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("n_bytes"))
    every = rows.withColumns(parents).select(*columns).unionByName(shared.withColumns(parents).select(*columns)).unionByName(root)
    return every.withColumn("ends", F.col("depth") == F.col("total")).drop("total")


# ---- nodes and tour -------------------------------------------------------

KEY = ["depth", "k1", "k2"]


def _tour():
    """Arcs of sorted siblings.  edge 0: an arc; 1: the arc out of this task's last child, next is its parent; 2: the first child and its parent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def rows(a, following, leaf, saved, edge):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, following, leaf, saved)]
                                              + [pa.array(np.full(n, edge, dtype=np.int32)), pa.array(np.full(n, part, dtype=np.int32))],
                                              names=["a", "next", "w1", "w2", "edge", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            parent, node, leaf, saved = (b.column(c).to_numpy().astype(np.int64) for c in ("parent", "id", "leaf", "saved"))
            zero = np.zeros(len(node), dtype=np.int64)
            none = leaf == 1  # into a node without children, and out again
            yield rows(2 * node[none], 2 * node[none] + 1, zero[none], zero[none], 0)
            if held is None:
                yield rows(parent[:1], node[:1], zero[:1], zero[:1], 2)
            else:
                parent, node, leaf, saved = (np.concatenate((h, x)) for h, x in zip(held, (parent, node, leaf, saved)))
            same = parent[1:] == parent[:-1]
            yield rows(2 * node[:-1] + 1, np.where(same, 2 * node[1:], 2 * parent[:-1] + 1), leaf[:-1], saved[:-1], 0)
            first = np.flatnonzero(~same) + 1
            yield rows(2 * parent[first], 2 * node[first], 0 * first, 0 * first, 0)
            held = [x[-1:] for x in (parent, node, leaf, saved)]
        if held is not None:
            parent, node, leaf, saved = held
            yield rows(node, parent, leaf, saved, 1)

    return run


def tour(children: DataFrame, root: int, root_is_leaf: bool) -> DataFrame:
    """(a, next, w1, w2): the arcs of all nodes; 2 * id into a node, 2 * id + 1 out of it; leaves and savings lie on the arcs out."""
    dealt = children.select("parent", "id", "leaf", "saved").repartitionByRange(_ranges(children), "parent", "id").sortWithinPartitions("parent", "id")
    found = materialize(dealt.mapInArrow(_tour(), "a long, next long, w1 long, w2 long, edge int, part int"), "arcs")
    w = Window.orderBy("part")  # two rows a task
    first = found.where("edge = 2").select("part", F.col("a").alias("parent"), F.col("next").alias("id"))
    last = found.where("edge = 1").select("part", F.col("a").alias("last"), F.col("next").alias("of"), "w1", "w2")
    ends = first.join(last, "part").withColumns({"next_parent": F.lead("parent").over(w), "next_id": F.lead("id").over(w), "previous": F.lag("of").over(w)})
    zero = F.lit(0).cast("long")
    out = ends.select((2 * F.col("last") + 1).alias("a"), F.when(F.col("next_parent") == F.col("of"), 2 * F.col("next_id")).otherwise(2 * F.col("of") + 1).alias("next"), "w1", "w2")
    into = ends.where("previous is null or previous <> parent").select((2 * F.col("parent")).alias("a"), (2 * F.col("id")).alias("next"), zero.alias("w1"), zero.alias("w2"))
    spark = children.sparkSession
    top = [(2 * root + 1, None, int(root_is_leaf), 0)] + ([(2 * root, 2 * root + 1, 0, 0)] if root_is_leaf else [])
    return (found.where("edge = 0").select("a", "next", "w1", "w2").unionByName(out).unionByName(into)
            .unionByName(spark.createDataFrame(top, "a long, next long, w1 long, w2 long")))


# ---- members that end -----------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node: the digest of its ids, or their text where the node may go on in another task."""
    part, key, first, held, out = TaskContext.get().partitionId(), None, True, [], []

    def row(whole: bool):
        text = ",".join(held)
        return (*key, part, hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text)

    for b in batches:
        depth, k1, k2, ids = (b.column(c).to_numpy() for c in (*KEY, "conv_id"))
        new = np.flatnonzero((depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), len(ids)]):
            if s == e:
                continue
            own = (int(depth[s]), int(k1[s]), int(k2[s]))
            if own != key:
                if key is not None:
                    out.append(row(not first))
                    first = False
                key, held = own, []
            held.append(",".join(map(str, ids[s:e].tolist())))
        if out:
            yield _batch(out)
            out = []
    if key is not None:
        yield _batch([row(False)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*KEY, "part", "ends_sha256", "text"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes whose texts come in order, one row a task."""
    key = state = None
    for b in batches:
        out = []
        for r in b.to_pylist():
            own = (r["depth"], r["k1"], r["k2"])
            if own != key:
                if key is not None:
                    out.append((*key, 0, state.hexdigest(), None))
                key, state = own, hashlib.sha256(r["text"].encode())
            else:
                state.update(b"," + r["text"].encode())
        if out:
            yield _batch(out)
    if key is not None:
        yield _batch([(*key, 0, state.hexdigest(), None)])


def ends(found: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes in which a conversation ends; found: its members."""
    schema = "depth long, k1 long, k2 long, part int, ends_sha256 string, text string"
    rows = materialize(found.where("ends").select(*KEY, "conv_id"), "ends")
    order = [*KEY, "conv_id"]
    runs = materialize(rows.repartitionByRange(_ranges(rows), *order).sortWithinPartitions(*order).mapInArrow(_runs, schema), "ends")
    cut = runs.where("ends_sha256 is null").repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(_joined, schema)
    return runs.where("ends_sha256 is not null").unionByName(cut).select(*KEY, "ends_sha256")


# ---- trie -----------------------------------------------------------------

def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    found = materialize(members(conversations), "members")
    nodes = found.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"))
    nodes = materialize(nodes.withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long"))
                        .withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    order = ["conv", "depth"]
    nodes = materialize(nodes.repartitionByRange(_ranges(nodes), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "nodes")
    root = nodes.where("depth = 0").select("id", "conv", "leaf").first()
    if root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    inner = nodes.where("leaf = 0 and depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv").alias("parent_conv_id"))
    top = nodes.where("depth = 1").withColumn("parent", F.lit(root["id"])).withColumn("parent_conv_id", F.lit(root["conv"]))
    children = materialize(nodes.where("depth > 1").join(inner, ["depth", "p1", "p2"]).unionByName(top), "children")

    ranked = list_rank.prefix_sums(materialize(tour(children, root["id"], bool(root["leaf"])), "tour"))
    way = F.when(F.col("a") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    below = ranked.groupBy(F.shiftright("a", 1).alias("id")).agg(F.sum(way * F.col("o1")).alias("leaves_below"), F.sum(way * F.col("o2")).alias("saved_below"))
    counts = children.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    every = children.unionByName(nodes.where("depth = 0"), allowMissingColumns=True)
    return (every.join(below, "id").join(counts, "id", "left").join(ends(found), KEY, "left")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    (F.col("leaves_below") + F.col("leaf")).alias("n_leaves"), (F.col("saved_below") + F.col("saved")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")))


def op12(conversations: DataFrame) -> DataFrame:
    return trie(conversations)
