"""Rule tables as small DataFrames (F4) and their JSON sources.

Rule tables are configuration, not data: a few dozen rows that users edit.
Operators take them as DataFrame arguments; these functions build the
shipped defaults and read the JSON rule documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typesift.functions import constants as K

FILE_RULES_SCHEMA = "file_name string, encoding string, separator string"
DATETIME_PATTERNS_SCHEMA = "seq int, pattern string"
KEYWORDS_SCHEMA = "seq int, category string, keyword string"
ERP_PATTERNS_SCHEMA = "name string, pattern string"
OVERRIDES_SCHEMA = "file string, field string, action string, kind string"
FIX_RULES_SCHEMA = ("pattern string, file_name string, field_name string, from_type string, "
                    "to_type string, reason string, confidence double")


def default_file_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.DEFAULT_FILE_RULES), FILE_RULES_SCHEMA)


def default_datetime_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(K.DEFAULT_DATETIME_PATTERNS, 1)), DATETIME_PATTERNS_SCHEMA)


def default_keywords(spark: SparkSession) -> DataFrame:
    rows = []
    for cat, words in (("code", K.DEFAULT_CODE_KEYWORDS), ("amount", K.DEFAULT_AMOUNT_KEYWORDS),
                       ("quantity", K.DEFAULT_QUANTITY_KEYWORDS)):
        rows += [(i, cat, w) for i, w in enumerate(words, 1)]
    return spark.createDataFrame(rows, KEYWORDS_SCHEMA)


def default_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, c, K.FORCE_TEXT, kind) for f, c, kind in K.DEFAULT_OVERRIDES],
                                 OVERRIDES_SCHEMA)


def empty_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OVERRIDES_SCHEMA)


def patterns_of(df: DataFrame | None) -> tuple[str, ...]:
    """Ordered pattern strings of a (seq, pattern) rule table, which a person edits."""
    if df is None:
        return K.DEFAULT_DATETIME_PATTERNS
    return tuple(r["pattern"] for r in df.orderBy("seq").select("pattern").collect())


# --------------------------------------------------------------------------
# JSON rule documents
# --------------------------------------------------------------------------

def _read_json_doc(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document on any store Spark reads, under an explicit schema; None if there is no such file."""
    try:
        return spark.read.option("multiLine", True).schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


RULE_DOCUMENT = ("unregistered_files map<string, struct<encoding: string, separator: string>>, datetime_patterns array<string>, "
                 "business_logic_rules struct<code_fields: array<string>, amount_fields: array<string>, quantity_fields: array<string>>, "
                 "sap_patterns map<string, string>")


def default_rule_document(spark: SparkSession) -> DataFrame:
    """The shipped rules as one JSON document column."""
    files = {name: (enc, sep) for name, enc, sep in K.DEFAULT_FILE_RULES}
    row = (files, list(K.DEFAULT_DATETIME_PATTERNS),
           (list(K.DEFAULT_CODE_KEYWORDS), list(K.DEFAULT_AMOUNT_KEYWORDS), list(K.DEFAULT_QUANTITY_KEYWORDS)), dict(K.DEFAULT_ERP_PATTERNS))
    doc = spark.createDataFrame([row], RULE_DOCUMENT)
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("json"))


def read_rule_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rule document -> {file_rules, datetime_patterns, keywords, erp_patterns}.

    Lists keep their order.  A missing document gives the shipped rules and is
    written with them, so that it can be edited.  A part that the document
    lacks is left out.
    """
    doc = _read_json_doc(spark, path, RULE_DOCUMENT)
    if doc is None:
        default_rule_document(spark).coalesce(1).write.text(path)
        doc = _read_json_doc(spark, path, RULE_DOCUMENT)
    has = doc.select(*[F.col(c).isNotNull().alias(c) for c in doc.columns]).first()
    out: dict[str, DataFrame] = {}
    if has["unregistered_files"]:
        out["file_rules"] = doc.select(F.explode("unregistered_files").alias("file_name", "r")).select("file_name", "r.encoding", "r.separator")
    if has["datetime_patterns"]:
        out["datetime_patterns"] = doc.select(F.posexplode("datetime_patterns").alias("seq", "pattern")) \
            .select((F.col("seq") + 1).cast("int").alias("seq"), "pattern")
    if has["business_logic_rules"]:
        parts = []
        for cat, key in (("code", "code_fields"), ("amount", "amount_fields"), ("quantity", "quantity_fields")):
            parts.append(doc.select(F.posexplode(f"business_logic_rules.{key}").alias("seq", "keyword"))
                         .select((F.col("seq") + 1).cast("int").alias("seq"), F.lit(cat).alias("category"), "keyword"))
        out["keywords"] = _union(spark, parts, KEYWORDS_SCHEMA)
    if has["sap_patterns"]:
        out["erp_patterns"] = doc.select(F.explode("sap_patterns").alias("name", "pattern"))
    return out


_OVERRIDE = "array<struct<file: string, field: string, action: string>>"


def read_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """Load overrides document; a missing file or an empty list gives no rows."""
    doc = None if path is None else _read_json_doc(spark, path, f"datetime_override_fields {_OVERRIDE}, storage_code_fields {_OVERRIDE}")
    if doc is None:
        return empty_overrides(spark)
    return _union(spark, [
        doc.select(F.explode(key).alias("o")).select("o.file", "o.field", "o.action", F.lit(kind).alias("kind"))
        for key, kind in (("datetime_override_fields", "datetime"), ("storage_code_fields", "storage"))], OVERRIDES_SCHEMA)


_FIX = "array<struct<file_name: string, field_name: string, from_type: string, to_type: string, reason: string, confidence: double>>"


def read_fix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Fix-rule document (four pattern lists) -> one table with a pattern column; a missing file gives no rows."""
    doc = _read_json_doc(spark, path, "fix_rules struct<" + ", ".join(f"{p}_fixes: {_FIX}" for p in K.FIX_PATTERNS) + ">")
    if doc is None:
        return spark.createDataFrame([], FIX_RULES_SCHEMA)
    return _union(spark, [doc.select(F.explode(f"fix_rules.{p}_fixes").alias("r")).select(F.lit(p).alias("pattern"), "r.*")
                          for p in K.FIX_PATTERNS], FIX_RULES_SCHEMA)


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
