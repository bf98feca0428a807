"""What keeps a cell's cost low: code that the JIT compiles under any session setting, and date regexes that know the calendar."""

from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from typesift.functions import constants as K
from typesift.functions import text as X
from typesift.operators import load as L
from typesift.operators import profile as P

JIT_LIMIT = 8000


def largest_method(spark, df):
    """Bytes of the largest generated method of the plan, with every stage generated whole."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.codegen.hugeMethodLimit")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        package = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages, sizes = package.codegenStringSeq(df._jdf.queryExecution().executedPlan()).iterator(), []
        while stages.hasNext():
            sizes.append(stages.next()._3().maxMethodCodeSize())
        return max(sizes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_profile_code_is_small_enough_for_the_jit(spark):
    df = spark.range(5).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(11)])
    assert largest_method(spark, P.profile_cells(P.to_cells(df, "f.txt"))) < JIT_LIMIT


def test_load_code_is_small_enough_for_the_jit(spark):
    cells = P.to_cells(spark.range(5).select("id", F.col("id").cast("string").alias("b")), "f.txt")
    dec = spark.createDataFrame([("f.txt", "id", "INTEGER", None), ("f.txt", "b", "DATETIME", "%Y%m%d")],
                                "file_name string, column_name string, load_type string, date_format string")
    assert largest_method(spark, L.load_typed_cells(cells, F.broadcast(dec))) < JIT_LIMIT


def parses(v, fmt, lo, hi):
    if re.sub("[0-9]", "0", v) not in X.format_shapes(fmt):
        return False
    try:
        d = dt.datetime.strptime(v, fmt)
    except ValueError:
        return False
    return "%Y" not in fmt or lo <= d.year <= hi


def test_date_regexes_are_strptime():
    rnd = random.Random(7)
    for fmts, lo, hi in ((K.INFER_DATE_FORMATS, K.INFER_YEAR_MIN, K.INFER_YEAR_MAX), (K.RATIO_DATE_FORMATS, K.RATIO_YEAR_MIN, K.RATIO_YEAR_MAX)):
        for fmt in fmts:
            regex = re.compile(X.valid_date_regex([fmt], lo, hi).replace(r"\z", r"\Z"))
            for _ in range(5000):
                part = {"%Y": f"{rnd.choice([0, 1, 400, 1600, 1677, 1678, 1900, 2000, 2024, 2100, 2261, 2262, rnd.randint(0, 9999)]):04d}"}
                for k, most in (("%m", 13), ("%d", 32), ("%H", 25), ("%M", 61), ("%S", 59)):
                    part[k] = f"{rnd.randint(0, most):0{2 if X._packed(fmt) else rnd.choice([1, 2])}d}"
                if rnd.random() < 0.3:
                    part |= {"%m": "02", "%d": rnd.choice(["28", "29", "30"])}
                v = re.sub("%[YmdHMS]", lambda m: part[m[0]], fmt)
                assert bool(regex.match(v)) == parses(v, fmt, lo, hi), (v, fmt)


def test_masks_of_odd_cells(spark):
    """Signs, exponents, trailing minus, white space, other digits and long numbers."""
    cases = {"7": P.BIT_DIGITS | P.BIT_NUM | P.BIT_INT, "07": P.BIT_DIGITS | P.BIT_ZPAD | P.BIT_NUM | P.BIT_INT, "+7": P.BIT_NUM | P.BIT_INT,
             "1.50-": P.BIT_NUM | P.BIT_DEC, "12-": P.BIT_NUM | P.BIT_INT, "+12-": 0, "1e2-": 0, "1e2": P.BIT_NUM | P.BIT_INT, "1e-2": P.BIT_NUM,
             ".5": P.BIT_NUM | P.BIT_DEC, ".": P.BIT_DEC, "-": 0, " 12 ": P.BIT_NUM | P.BIT_INT, "١٢": P.BIT_DIGITS, "1٢": P.BIT_DIGITS,
             "9" * 310: P.BIT_DIGITS | P.BIT_NUM, "9" * 305: P.BIT_DIGITS | P.BIT_NUM | P.BIT_INT, "TRUE": P.BIT_BOOL, "a,b": P.BIT_DEC,
             "20240229": P.BIT_DIGITS | P.BIT_NUM | P.BIT_INT | P.FORMAT_BITS["%Y%m%d"], "20230229": P.BIT_DIGITS | P.BIT_NUM | P.BIT_INT,
             " 20240229": P.BIT_NUM | P.BIT_INT, "2024-2-9": P.FORMAT_BITS["%Y-%m-%d"], "2024.02.09": P.BIT_DEC,
             "01/02/2024": P.FORMAT_BITS["%d/%m/%Y"] | P.FORMAT_BITS["%m/%d/%Y"] | P.BIT_ZPAD, "23:59:59": P.FORMAT_BITS["%H:%M:%S"],
             "2024-02-29 1:02:3": P.FORMAT_BITS["%Y-%m-%d %H:%M:%S"]}
    df = spark.createDataFrame([("f", "c", v) for v in cases], "file_name string, column_name string, value string")
    got = {r["v"]: (r["m"], r["dp"]) for r in P.classify(df).collect()}
    assert {v: m for v, (m, _) in got.items()} == cases
    assert {v for v, (_, dp) in got.items() if dp} == {"20240229", " 20240229", "2024.02.09", "01/02/2024"}


def test_typed_cells_render_every_format(spark):
    want = {("2024-2-9", "%Y-%m-%d"): "2024-02-09 00:00:00", ("2024/02/09", "%Y/%m/%d"): "2024-02-09 00:00:00", ("20240209", "%Y%m%d"): "2024-02-09 00:00:00",
            ("2024-2-9 3:04:5", "%Y-%m-%d %H:%M:%S"): "2024-02-09 03:04:05", ("3:04:5", "%H:%M:%S"): "1900-01-01 03:04:05",
            ("9.2.2024", "%d.%m.%Y"): "2024-02-09 00:00:00", ("09/02/2024", "%d/%m/%Y"): "2024-02-09 00:00:00", ("2/9/2024", "%m/%d/%Y"): "2024-02-09 00:00:00",
            ("2023-02-29", "%Y-%m-%d"): None, ("20240209", "%Y-%m-%d"): None, ("2024-02-09", None): None, (None, "%Y-%m-%d"): None}
    df = spark.createDataFrame(list(want), "v string, f string")
    assert {(r["v"], r["f"]): r["o"] for r in L.with_datetime_text(df, "v", "f", "o").collect()} == want


def test_checksums_need_no_decimals_and_tell_copies(spark):
    from typesift.sources import typed_tables as TT
    schema = "table string, column string, int_value long, real_value double, text_value string"
    one = spark.createDataFrame([("t", "c", 1, None, None), ("t", "c", None, None, None), ("t", "c", 2, None, None)], schema)
    twice = spark.createDataFrame([("t", "c", 1, None, None), ("t", "c", None, None, None), ("t", "c", 1, None, None)], schema)
    assert "decimal" not in TT.column_sums(one)._jdf.queryExecution().toString()
    assert TT.readback(one, one).first()["same"] and not TT.readback(one, twice).first()["same"]
    nulls = spark.createDataFrame([("t", "c", None, None, None)], schema)
    assert TT.readback(nulls, nulls).first()["same"]


def test_spread_extract_has_all_rows(spark):
    from paths import SF_SMALL
    from typesift.plans import fixtures as FX
    plain, spread = FX.extract_orders(spark, SF_SMALL), FX.extract_orders(spark, SF_SMALL, spread=True)
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))
