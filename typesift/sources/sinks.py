"""Sinks: reports to CSV (K05), rules and overrides to JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typesift.functions import constants as K
from typesift.sources import rules as RULES


def write_report_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """A report as CSV with a header (a folder of part files; UTF-8, no BOM).

    ``single_file`` writes one part; use it only for reports whose size is
    bounded (per-file or per-column summaries), never for cell-level data.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_fix_rules(rules: DataFrame, path: str) -> None:
    """Fix rules as JSON lines in one folder per pattern, and their counts.

    Any number of rules is written by as many tasks as hold them.
    ``read_fix_rule_lines`` reads them back.
    """
    root = path.rstrip("/")
    rules.write.mode("overwrite").partitionBy("pattern").json(f"{root}/fix_rules")
    counts = rules.groupBy("pattern").agg(F.count(F.lit(1)).alias("fixes"))
    counts.withColumn("generated_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{root}/summary")


def read_fix_rule_lines(spark, path: str) -> DataFrame:
    """What ``write_fix_rules`` wrote."""
    return spark.read.schema(RULES.FIX_RULES_SCHEMA).json(f"{path.rstrip('/')}/fix_rules")


def fix_rules_document(rules: DataFrame) -> DataFrame:
    """The fix-rule document of the original tool as one JSON string:
    {"summary": {...}, "fix_rules": {"pattern1_fixes": [...], ...}}.

    One document is one value, so this form is for rule sets that a person
    reads; ``write_fix_rules`` has no such bound.
    """
    entry = F.struct("file_name", "field_name", "from_type", "to_type", "reason", "confidence")
    per = rules.groupBy("pattern").agg(F.collect_list(entry).alias("fixes"), F.count(F.lit(1)).alias("n"))
    lists = [F.coalesce(F.max(F.when(F.col("pattern") == p, F.col("fixes"))),
                        F.array().cast(per.schema["fixes"].dataType)).alias(f"{p}_fixes")
             for p in K.FIX_PATTERNS]
    counts = [F.coalesce(F.max(F.when(F.col("pattern") == p, F.col("n"))), F.lit(0)).alias(f"{p}_fixes")
              for p in K.FIX_PATTERNS]
    doc = per.agg(F.struct(F.current_timestamp().cast("string").alias("generated_at"),
                           F.coalesce(F.sum("n"), F.lit(0)).alias("total_fixes"),
                           F.struct(*counts).alias("pattern_counts")).alias("summary"),
                  F.struct(*lists).alias("fix_rules"))
    return doc.select(F.to_json(F.struct("summary", "fix_rules")).alias("json"))


def overrides_document(overrides: DataFrame) -> DataFrame:
    """The load-override document as one JSON string."""
    entry = F.struct("file", "field", "action")
    d = overrides.agg(
        F.collect_list(F.when(F.col("kind") == "datetime", entry)).alias("datetime_override_fields"),
        F.collect_list(F.when(F.col("kind") == "storage", entry)).alias("storage_code_fields"),
        F.count(F.lit(1)).alias("total_overrides"))
    return d.select(F.to_json(F.struct("datetime_override_fields", "storage_code_fields", "total_overrides")).alias("json"))


def write_document(doc: DataFrame, path: str) -> None:
    """Write a one-row JSON document column as a text file folder."""
    doc.coalesce(1).write.mode("overwrite").text(path)
