"""Fix rules and load overrides.

Input is the registry seen as a comparison view (``File, Column,
Inferred_Type, Actual_Type``; see ``registry.as_compare_view``).  One pass
tests every field against the four patterns; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typesift.functions import constants as K
from typesift.operators import registry as R
from typesift.operators.reports import is_unregistered

FIX_COLUMNS = ["pattern", "file_name", "field_name", "from_type", "to_type", "reason", "confidence"]


def suggested_type(actual: Column) -> Column:
    """Actual type -> suggested type, TEXT by default."""
    return F.when(actual.isin(K.TEXT, K.INTEGER, K.REAL), actual).otherwise(F.lit(K.TEXT))


def _because(template: str) -> Column:
    before, after = template.split("{actual}")
    return F.concat(F.lit(before), F.col("Actual_Type"), F.lit(after))


def _conditions(storage_file: str, storage_field: str) -> dict[str, Column]:
    """Which fields each pattern takes.

    X01 unregistered fields; X02 DATETIME inferred but TEXT registered; X03
    INTEGER inferred, TEXT registered, price-like name; X04 storage-location
    fields of the storage file (no type check).
    """
    inferred, text = F.col("Inferred_Type"), F.col("Actual_Type") == K.TEXT
    return {"pattern1": is_unregistered("Inferred_Type"),
            "pattern2": (inferred == K.DATETIME) & text,
            "pattern3": (inferred == K.INTEGER) & text & F.col("Column").rlike(K.PRICE_NAME_REGEX),
            "pattern4": (F.col("File") == storage_file) & F.col("Column").contains(storage_field)}


def fix_rules(view: DataFrame, *, storage_file: str = K.STORAGE_FILE,
              storage_field: str = K.STORAGE_FIELD) -> DataFrame:
    """X05 + U02: all four fix lists as one table with a pattern column, from one pass."""
    none = F.lit(None).cast("string")
    fixes = {  # pattern: (from_type, to_type, reason, confidence)
        "pattern1": (F.lit("Unknown"), suggested_type(F.col("Actual_Type")), none, F.lit(1.0)),
        "pattern2": (F.lit(K.DATETIME), F.lit(K.TEXT), _because(K.REASON_DATETIME), F.lit(None).cast("double")),
        "pattern3": (F.lit(K.INTEGER), F.lit(K.TEXT), _because(K.REASON_PRICE), F.lit(None).cast("double")),
        "pattern4": (F.lit(K.INTEGER), F.lit(K.TEXT), F.lit(K.REASON_STORAGE), F.lit(None).cast("double"))}
    hits = [F.when(cond, F.struct(F.lit(p).alias("pattern"), *[c.alias(n) for c, n in zip(fixes[p], FIX_COLUMNS[3:])]))
            for p, cond in _conditions(storage_file, storage_field).items()]
    hit = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r")
    return (view.select(F.col("File").alias("file_name"), F.col("Column").alias("field_name"), hit)
            .select("r.pattern", "file_name", "field_name", *[f"r.{c}" for c in FIX_COLUMNS[3:]]))


def fix_summary(rules: DataFrame) -> DataFrame:
    """Fixes per pattern (all four listed, zero included) plus the total, from one aggregate."""
    counts = rules.agg(*[F.count(F.when(F.col("pattern") == p, 1)).alias(p) for p in K.FIX_PATTERNS], F.count(F.lit(1)).alias("total"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(p).alias("fixes"))
                                             for p in (*K.FIX_PATTERNS, "total")])).alias("r")).select("r.pattern", "r.fixes")


def unregistered_by_file(view: DataFrame) -> DataFrame:
    """Unregistered fields per file: count and TEXT share (rounded to 3)."""
    u = view.filter(is_unregistered("Inferred_Type"))
    return u.groupBy("File").agg(
        F.count(F.lit(1)).alias("fields"),
        F.round(F.avg(F.when(F.col("Actual_Type") == K.TEXT, 1.0).otherwise(0.0)), 3).alias("text_ratio"))


# --------------------------------------------------------------------------
# Load overrides
# --------------------------------------------------------------------------

def overrides_from_fixes(rules: DataFrame) -> DataFrame:
    """Patterns 2 and 4 become force_text overrides."""
    kind = F.when(F.col("pattern") == "pattern2", "datetime").otherwise("storage")
    return (rules.filter(F.col("pattern").isin("pattern2", "pattern4"))
            .select(F.col("file_name").alias("file"), F.col("field_name").alias("field"),
                    F.lit(K.FORCE_TEXT).alias("action"), kind.alias("kind")))


def overrides_from_rules(registry: DataFrame, code_keywords=K.DEFAULT_CODE_KEYWORDS) -> DataFrame:
    """When the storage-location token is a code keyword, every file that
    has that column; plus the known DATETIME fields."""
    spark: SparkSession = registry.sparkSession
    known = spark.createDataFrame(
        [(f, c, K.FORCE_TEXT, "datetime") for f, c in K.KNOWN_DATETIME_OVERRIDES],
        "file string, field string, action string, kind string")
    if K.STORAGE_FIELD not in code_keywords:
        return known
    files = R.files_with_field(registry, K.STORAGE_FIELD)
    storage = files.select(F.col("file_name").alias("file"), F.lit(K.STORAGE_FIELD).alias("field"),
                           F.lit(K.FORCE_TEXT).alias("action"), F.lit("storage").alias("kind"))
    return known.unionByName(storage)


def rule_status(spark: SparkSession, *, file_rules: DataFrame, datetime_patterns: DataFrame,
                keywords: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Rule-table counts, override counts and whether a sync is needed."""
    def n(df: DataFrame, cond: Column | None = None) -> Column:
        d = df if cond is None else df.filter(cond)
        return d.agg(F.count(F.lit(1))).scalar()

    ov = overrides if overrides is not None else \
        spark.createDataFrame([], "file string, field string, action string, kind string")
    o = ov.agg(F.count(F.lit(1)).alias("total_overrides"),
               F.count(F.when(F.col("kind") == "datetime", 1)).alias("datetime_overrides"),
               F.count(F.when(F.col("kind") == "storage", 1)).alias("storage_overrides"))
    return o.select(
        n(file_rules).alias("unregistered_files"),
        n(datetime_patterns).alias("datetime_patterns"),
        *[n(keywords, F.col("category") == c).alias(f"{c}_fields") for c in K.KEYWORD_CATEGORIES],
        F.lit(overrides is not None).alias("overrides_exist"),
        "total_overrides", "datetime_overrides", "storage_overrides",
        (F.lit(overrides is None) | (F.col("total_overrides") == 0)).alias("sync_required"))


def default_template(spark: SparkSession) -> dict[str, DataFrame]:
    """The default rule template an analysis starts from (files, four date
    patterns, code and price keyword lists)."""
    return {
        "unregistered_files": spark.createDataFrame([(f,) for f, _, _ in K.DEFAULT_FILE_RULES], "file_name string"),
        "datetime_patterns": spark.createDataFrame(list(enumerate(K.TEMPLATE_DATETIME_PATTERNS, 1)), "seq int, pattern string"),
        "code_fields": spark.createDataFrame([(k,) for k in K.TEMPLATE_CODE_FIELDS], "keyword string"),
        "price_fields": spark.createDataFrame([(k,) for k in K.TEMPLATE_PRICE_FIELDS], "keyword string"),
    }


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` fix candidates in key order, for display."""
    keys = [c for c in ("file_name", "field_name", "File", "Column") if c in df.columns]
    return df.orderBy(*keys).limit(n)
