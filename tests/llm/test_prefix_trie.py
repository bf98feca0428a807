"""The prefix trie and list ranking against brute force, and the defined results on odd input."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from typesift.llm import list_rank, prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, part string, n_convs long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role or '')}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    nodes: dict = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in children.get(k, [])) or 1
        saved[k] = own_saved + sum(saved[x] for x in children.get(k, []))
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), len(children.get(k, [])), leaves[k], saved[k],
                   sha(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k)))))) for k, m in nodes.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "p", 9) for r in rows], SCHEMA)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None and c == "parent_conv_id" else r[c] for c in names) for r in df.collect())


def random_rows(seed, n):
    r = random.Random(seed)
    rows = [(r.choice([None, -7, -5, 0, *range(60)]), r.choice([None, 0, 1, 1, 2, 3, 4]), r.choice(["user", "assistant", None, ""]),
             r.choice(["hello", "é", "", None, "a", "b"])) for _ in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = random_rows(seed, 400)
    assert got(T.op12(frame(spark, rows))) == brute(rows)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(3, i, "user", f"turn {i}") for i in range(2500)]  # deeper than any recursion, over several tasks
    rows += [(100 + c, i, "user", f"same {i}") for c in range(300) for i in range(2)]
    rows += [(1000 + c, 0, "system", "one opening") for c in range(50)] + [(1000 + c, 1, "user", f"own {c}") for c in range(50)]
    assert got(T.op12(frame(spark, rows))) == brute(rows)


def test_odd_tables(spark):
    assert T.op12(frame(spark, [])).count() == 0
    assert T.op12(frame(spark, [(None, 1, "a", "b")])).count() == 0
    for rows in ([(1, None, None, None)], [(2, 0, "u", "x")], [(5, 0, "u", "x"), (5, 0, "u", "x"), (6, 3, None, "y")]):
        assert got(T.op12(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("order", ["along", "random"])
def test_list_rank(spark, order):
    r, n = random.Random(7), 3000
    numbers = list(range(0, 3 * n, 3))
    if order == "random":  # no two neighbours in one range: coin flips
        r.shuffle(numbers)
    weights = [(r.randint(-5, 9), r.randint(0, 3)) for _ in numbers]
    rows = [(a, b, *w) for a, b, w in zip(numbers, [*numbers[1:], None], weights)]
    r.shuffle(rows)
    out = list_rank.prefix_sums(spark.createDataFrame(rows, "a long, next long, w1 long, w2 long"), task_rows=200)
    want, s1, s2 = {}, 0, 0
    for a, (w1, w2) in zip(numbers, weights):
        want[a] = (s1, s2)
        s1, s2 = s1 + w1, s2 + w2
    assert {x["a"]: (x["o1"], x["o2"]) for x in out.collect()} == want


def test_list_rank_refuses_two_lists(spark):
    with pytest.raises(ValueError):
        list_rank.prefix_sums(spark.createDataFrame([(1, None, 1, 1), (2, None, 1, 1)], "a long, next long, w1 long, w2 long"))
