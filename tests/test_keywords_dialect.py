"""Keyword tables of any size, and dialects of files."""

from __future__ import annotations

import csv
import io
import random

from pyspark.sql import functions as F

from typesift.operators import keyword_index as KI
from typesift.operators import profile as P
from typesift.sources import dialect as DI
from typesift.sources import rules as RULES


def test_index_equals_the_case(spark):
    names = [(n,) for n in ["品目コード", "Order_No", "単価", "受注数量", "amount_total", "", None, "x", "QTY", "売上金額コード"]]
    profile = spark.createDataFrame([("f.csv", n[0], 3, 0, 0, 3, 0, 3) for n in names], P.PROFILE_SCHEMA)
    shipped = P.infer_corrected(profile)
    table = P.infer_corrected(profile, keywords=RULES.default_keywords(spark))
    assert shipped.columns == table.columns
    assert sorted(map(str, shipped.collect())) == sorted(map(str, table.collect()))


def test_many_keywords(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdeéコ", k=r.randint(1, 7))) for _ in range(3000)]
    order = {"code": 0, "amount": 1}
    keywords = [(i % 50, r.choice(["code", "amount", "quantity"]), w) for i, w in enumerate(words)]
    names = ["".join(r.choices("abcdeéコXY_", k=r.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in names + names[:50] + [None]], "n string")
    got = {x["n"]: (x["category"], x["keyword"]) for x in KI.match(df, "n", spark.createDataFrame(keywords, RULES.KEYWORDS_SCHEMA)).collect()}
    want = {None: (None, None)}
    for n in names:
        hits = sorted((order.get(c, 2), s, k, c) for s, c, k in keywords if k in n.lower())
        want[n] = (hits[0][3], hits[0][2]) if hits else (None, None)
    assert got == want


def test_hundred_thousand_keywords(spark):
    keywords = spark.range(100_000).select((F.col("id") % 7).cast("int").alias("seq"), F.lit("code").alias("category"),
                                           F.concat(F.lit("kw"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("keyword"))
    names = spark.range(0, 100_000, 50).select(F.concat(F.lit("A_KW"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("_x")).alias("n"))
    out = KI.match(names, "n", keywords)
    assert out.count() == 2000 and out.where("lower(n) = concat('a_', keyword, '_x')").count() == 2000


def test_empty_keyword_and_tables(spark):
    one = spark.createDataFrame([(1, "code", "")], RULES.KEYWORDS_SCHEMA)
    names = spark.createDataFrame([("a",), ("",)], "n string")
    assert {r["keyword"] for r in KI.match(names, "n", one).collect()} == {""}
    assert KI.match(names, "n", one.limit(0)).where("keyword is null").count() == 2
    assert KI.match(names.limit(0), "n", one).count() == 0


def test_dialects(spark):
    r = random.Random(5)
    rows, want = [], {}
    for i, (d, q) in enumerate([(d, q) for d in DI.DELIMITERS for q in ('"', "'")] * 2):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=d, quotechar=q, lineterminator="\n", quoting=csv.QUOTE_ALL if i % 2 else csv.QUOTE_MINIMAL)
        for _ in range(30):
            writer.writerow([str(r.randint(0, 99)), r.choice(["a", f"b{d}c", f"{d}{d}x"]), "2024-01-01", "z"])
        rows += [(i, x) for x in out.getvalue().split("\n")]
        want[i] = (d, q)
    rows += [(1000, "plain"), (1000, "text"), (1001, ""), (1001, " ")]
    got = {x["id"]: (x["delimiter"], x["quote"]) for x in DI.detect(spark.createDataFrame(rows, "id int, line string"), "id", "line").collect()}
    assert got == want | {1000: ("N/A", "")}
