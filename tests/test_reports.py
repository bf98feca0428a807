"""Report sets, the default rule template, and the diff against an older registry."""

from __future__ import annotations

from paths import SF_SMALL
from typesift.functions import constants as K
from typesift.operators import fixes as FIX
from typesift.operators import reports as RP
from typesift.plans import catalog
from typesift.plans import fixtures as FX
from typesift.plans import jobs as J


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_report_sets_hold_the_registered_reports(spark):
    rep = FX.compare_report(spark, SF_SMALL)
    queries = catalog.registry()
    other = {"storage_issues"}  # its query gives the report a file name of its own
    compared = 0
    for made in (RP.t001_report(rep), RP.t002_report(rep)):
        for name, df in made.items():
            got = rows(df)
            for query in {f"report_{name}", f"report_t002_{name}"} & set(queries) if name not in other else ():
                assert got == rows(queries[query][0](spark, SF_SMALL)), name
                compared += 1
    assert compared >= 10
    assert set(RP.t001_report(rep)) == {"totals", "type_distribution", "worst_files", "mismatch_patterns", "candidates", "formats", "duplicates"}


def test_default_template(spark):
    t = FIX.default_template(spark)
    assert [r["pattern"] for r in t["datetime_patterns"].orderBy("seq").collect()] == list(K.TEMPLATE_DATETIME_PATTERNS)
    assert {r["keyword"] for r in t["code_fields"].collect()} == set(K.TEMPLATE_CODE_FIELDS)
    assert {r["keyword"] for r in t["price_fields"].collect()} == set(K.TEMPLATE_PRICE_FIELDS)
    assert t["unregistered_files"].count() == len(K.DEFAULT_FILE_RULES)


def test_master_diff(spark):
    registry = "file_name string, column_name string, data_type string"
    analysis = spark.createDataFrame([("f", "a", "INTEGER"), ("f", "b", "TEXT"), ("f", "new", "REAL")], "file_name string, column_name string, Inferred_Type string")
    new, changed = J.master_diff(analysis, spark.createDataFrame([("f", "a", "TEXT"), ("f", "b", "TEXT"), ("f", "gone", "TEXT")], registry))
    assert [r["column_name"] for r in new.collect()] == ["new"]
    assert [(r["column_name"], r["data_type"], r["data_type_master"]) for r in changed.collect()] == [("a", "INTEGER", "TEXT")]
