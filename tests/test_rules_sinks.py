"""Rule documents (S13), sinks (K05/K06), header-less probe (S10), consistency (X11), status."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from f6_files import write_f6
from typesift.functions import constants as K
from typesift.operators import fixes as FIX
from typesift.operators import load as L
from typesift.sources import files as S
from typesift.sources import rules as RU
from typesift.sources import sinks as SK


def _rule_doc() -> dict:
    return {
        "unregistered_files": {f: {"encoding": e, "separator": s} for f, e, s in K.DEFAULT_FILE_RULES},
        "datetime_patterns": list(K.DEFAULT_DATETIME_PATTERNS),
        "business_logic_rules": {"code_fields": list(K.DEFAULT_CODE_KEYWORDS) + ["zzz"],
                                 "amount_fields": list(K.DEFAULT_AMOUNT_KEYWORDS),
                                 "quantity_fields": list(K.DEFAULT_QUANTITY_KEYWORDS)},
        "sap_patterns": dict(K.DEFAULT_ERP_PATTERNS),
    }


def test_rule_document_round_trip(spark, scratch):
    path = os.path.join(scratch, "rules.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(_rule_doc(), f, ensure_ascii=False, indent=2)
    doc = RU.read_rule_document(spark, path)
    assert doc["file_rules"].count() == 4
    assert [r["pattern"] for r in doc["datetime_patterns"].orderBy("seq").collect()] == list(K.DEFAULT_DATETIME_PATTERNS)
    kw = doc["keywords"]
    assert kw.filter(F.col("category") == "code").count() == len(K.DEFAULT_CODE_KEYWORDS) + 1
    from typesift.operators import profile as P
    assert P.keyword_list(kw)[0] == ("code", K.DEFAULT_CODE_KEYWORDS[0])


def test_overrides_and_fix_documents(spark, scratch):
    ov_path = os.path.join(scratch, "overrides.json")
    ov = RU.default_overrides(spark)
    doc = json.loads(SK.overrides_document(ov).first()["json"])
    assert doc["total_overrides"] == 5 and len(doc["storage_code_fields"]) == 1
    with open(ov_path, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False)
    back = RU.read_overrides(spark, ov_path)
    assert sorted(tuple(r) for r in back.select("file", "field", "kind").collect()) == \
        sorted((f, c, k) for f, c, k in K.DEFAULT_OVERRIDES)
    assert RU.read_overrides(spark, os.path.join(scratch, "missing.json")).count() == 0
    rules = spark.createDataFrame(
        [("pattern2", "a.txt", "d", "DATETIME", "TEXT", "r", None), ("pattern4", "zm114.txt", "保管場所", "INTEGER", "TEXT", "s", None)],
        RU.FIX_RULES_SCHEMA)
    fix_doc = json.loads(SK.fix_rules_document(rules).first()["json"])
    assert fix_doc["summary"]["total_fixes"] == 2
    assert fix_doc["summary"]["pattern_counts"]["pattern1_fixes"] == 0
    fpath = os.path.join(scratch, "fix.json")
    with open(fpath, "w", encoding="utf-8") as f:
        json.dump(fix_doc, f, ensure_ascii=False)
    assert RU.read_fix_rules(spark, fpath).count() == 2


def test_report_csv_round_trip(spark, scratch):
    rep = spark.createDataFrame([("a.txt", "c", "TEXT", "TEXT", "○", "utf-8", ",")],
                                "File string, Column string, Inferred_Type string, Actual_Type string, "
                                "Match string, Encoding string, Delimiter string")
    out = os.path.join(scratch, "report")
    SK.write_report_csv(rep, out, single_file=True)
    back = S.read_compare_report(spark, out)
    assert back.columns == rep.columns and back.first()["Match"] == "○"


def test_headerless_probe(spark, scratch):
    write_f6(scratch)
    got = {os.path.basename(r["path"]): r for r in
           S.headerless_probe(spark, S.probe(S.list_files(spark, scratch))).collect()}
    assert got["a_utf8.csv"]["delimiter"] == ","
    assert got["a_utf8.csv"]["data_types"] == "string, string, string, string, string"
    assert got["h_ragged.csv"]["delimiter"] == ","


def test_consistency_and_status(spark):
    typed = spark.createDataFrame([(1, 2.0, "x")], "q bigint, p double, m string")
    schemas = L.schema_table(spark, {"my_file": typed})
    reg = spark.createDataFrame([("my-file.txt", "q", "INTEGER"), ("my-file.txt", "p", "TEXT")],
                                "file_name string, column_name string, data_type string")
    got = {r["column"]: r["Match"] for r in L.consistency(schemas, reg).collect()}
    assert got == {"q": "○", "p": "×", "m": "×"}
    st = FIX.rule_status(spark, file_rules=RU.default_file_rules(spark),
                         datetime_patterns=RU.default_datetime_patterns(spark),
                         keywords=RU.default_keywords(spark), overrides=None).first()
    assert st["unregistered_files"] == 4 and st["sync_required"] is True
    assert st["code_fields"] == len(K.DEFAULT_CODE_KEYWORDS)


def test_empty_override_lists_and_remote_paths(spark, scratch):
    path = os.path.join(scratch, "empty.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"datetime_override_fields": [{"file": "a", "field": "b", "action": "force_text"}], "storage_code_fields": []}, f)
    assert RU.read_overrides(spark, f"file://{path}").count() == 1
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"datetime_override_fields": [], "storage_code_fields": []}, f)
    assert RU.read_overrides(spark, path).count() == 0


def test_missing_rule_document_is_written_with_the_defaults(spark, scratch):
    path = os.path.join(scratch, "rules")
    doc = RU.read_rule_document(spark, path)
    assert doc["file_rules"].count() == len(K.DEFAULT_FILE_RULES)
    again = RU.read_rule_document(spark, path)
    assert [r["pattern"] for r in again["datetime_patterns"].orderBy("seq").collect()] == list(K.DEFAULT_DATETIME_PATTERNS)
    assert {(r["name"], r["pattern"]) for r in again["erp_patterns"].collect()} == set(K.DEFAULT_ERP_PATTERNS)


def test_fix_rules_as_lines(spark, scratch):
    rules = spark.createDataFrame(
        [("pattern2", f"f{i}.txt", "d", "DATETIME", "TEXT", "r", None) for i in range(50)]
        + [("pattern4", "zm114.txt", "保管場所", "INTEGER", "TEXT", "s", 0.5)], RU.FIX_RULES_SCHEMA)
    SK.write_fix_rules(rules, os.path.join(scratch, "fixes"))
    back = SK.read_fix_rule_lines(spark, os.path.join(scratch, "fixes"))
    assert sorted(map(str, back.select(*rules.columns).collect())) == sorted(map(str, rules.collect()))
