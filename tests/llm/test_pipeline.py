"""The pipeline against a brute-force run of its stages, and the registered SQL against DuckDB."""

from __future__ import annotations

import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from test_operators import brute_components, brute_hits, crc, frame, odd_rows, whole_ids
from typesift.llm import packing, toxicity
from typesift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    leaf = lambda w: (len(w), tuple("<*>" if re.search("[0-9]", t) else t for t in w[:8]))
    tokens = lambda line: re.findall(r"[^\x20\x09-\x0D]+", line)
    first: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(w := tokens(line)) >= 5:
                first[leaf(w)] = min(first.get(leaf(w), i), i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(tokens(x)) < 5 or first[leaf(tokens(x))] == i]
        new = "\n".join(kept)
        if len(kept) == len(lines) or tokens(new):
            out.append((i, new))
    return out


def test_pipeline(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = [(r["doc_id"], r["text"]) for r in tables["documents"].collect()]
    model = toxicity.train(tables["documents"], tables["labels"])
    toxic = {r["doc_id"] for r in toxicity.score(tables["documents"], model).where("score >= 0.5").collect()}
    docs = brute_lines([d for d in docs if d[0] not in toxic])
    kept = {i for i, _, c in brute_components(docs) if i == c}
    items = [(str(r["item_id"]), r["text"]) for r in tables["benchmark"].collect()]
    grams = {w for _, t in items for w in re.findall("[a-z]{7,}", t.lower())}  # texts without any of the items' long words have no hits
    docs = [(i, t) for i, t in docs if i in kept]
    clean = []
    for i, t in docs:
        n, h, _ = brute_hits(t, items, 13) if len(set(re.findall("[a-z]{7,}", t.lower())) & grams) > 2 else (1, 0, [])
        if not (h and 20 * h >= n):
            clean.append((i, t))
    want = sorted((i, p, p * 2048, len(c), crc(c)) for i, t in clean for ids in [whole_ids("word_bpe_49k.json", t)]
                  for p in range(-(-len(ids) // 2048)) for c in [ids[p * 2048:p * 2048 + 2048]])
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()) == want
    total = sum(x[3] for x in want)
    assert out.select("sequence_id").distinct().count() <= 1.05 * -(-total // packing.CAPACITY) + 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLES[name]).df()[list(got.columns)]
    key = [c for c in got.columns if not (got[c].isna().any() or want[c].isna().any())]  # the first column alone may have ties
    got, want = (x.sort_values(key).reset_index(drop=True).astype(object) for x in (got, want))
    got, want = (x.where(x.notna(), None) for x in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        assert np.array_equal(got[c].map(str).to_numpy(), want[c].map(lambda v: str(v)).to_numpy()) or \
            [None if v is None else str(v).removesuffix(".0") for v in got[c]] == [None if v is None else str(v).removesuffix(".0") for v in want[c]], c


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Each stage by itself: columns kept, no clean row lost, copies and near copies of 0.8 gone, nothing invented."""
    words = [f"w{i}x" for i in range(200)]
    near = [*words[:95], "changed", *words[96:]]  # 191 of 201 shingles shared
    fair = [*words[:40], "one", *words[41:90], "two", *words[91:140], "three", *words[141:180], "four", *words[181:]]
    share = lambda a, b: (lambda x, y: len(x & y) / len(x | y))(*({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b)))
    assert share(words, near) > 0.85 and 0.8 <= share(words, fair) < 0.85
    rows = odd_rows() + [(1000, " ".join(words)), (1001, " ".join(words)), (1002, " ".join(near)), (1003, " ".join(fair))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = frame(spark, rows)
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        ids = [r["doc_id"] for r in out.collect()]
        assert {1, 2, 3, 4, 5, 7, 1000} <= set(ids), name
        if name == "near_dedup":
            assert not {1001, 1002, 1003} & set(ids) and len(ids) == len(set(ids))
        elif name != "line_dedup":
            assert len(ids) == len(rows), name
        empty = stage(spark, frame(spark, []), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name
    packed = corpus_pipeline.packed(spark, frame(spark, rows), SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows} and corpus_pipeline.packed(spark, frame(spark, []), SF).count() == 0
