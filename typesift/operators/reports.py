"""Field-diagnosis reports over a comparison report.

Input is a comparison report with the columns ``File, Column,
Inferred_Type, Actual_Type, Match, Encoding, Delimiter`` (one row per field).
Every report is one grouped aggregate (partial aggregation map-side, a
shuffle of at most one row per group per task) followed, for the top-k
reports, by a ``limit`` over the small aggregated result.  Ties are broken
by the key so results are deterministic.

Percentages are rendered with one decimal, rounded half up, by integer
arithmetic (``pct1``) so they are exact on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typesift.functions import constants as K


def pct1(num, den) -> Column:
    """``num/den*100`` with one decimal, half up, as text; null when den is 0."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    permille = F.floor((num * 2000 + den) / (den * 2)).cast("long")
    txt = F.concat((permille / 10).cast("long").cast("string"), F.lit("."), (permille % 10).cast("string"))
    return F.when(den > 0, txt)


def is_unregistered(c) -> Column:
    """Every spelling of 'not registered', and null."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.isin(list(K.UNREGISTERED_SPELLINGS))


def matched(rep: DataFrame) -> Column:
    return F.col("Match") == K.MATCH_YES


# --------------------------------------------------------------------------
# T001
# --------------------------------------------------------------------------

def totals(rep: DataFrame) -> DataFrame:
    """A04 + A18: one row of field / file / column counts and match rates."""
    t = rep.agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.countDistinct("File").alias("file_count"),
        F.countDistinct("Column").alias("distinct_columns"),
        F.count(F.when(matched(rep), 1)).alias("matched_fields"),
        F.count(F.when(F.col("Match") != K.MATCH_YES, 1)).alias("mismatched_fields"),
        F.count(F.when(F.col("Inferred_Type") != F.col("Actual_Type"), 1)).alias("type_mismatches"),
        F.countDistinct("Actual_Type").alias("_n_actual"),
        F.count(F.when(F.col("Actual_Type") == K.TEXT, 1)).alias("_n_text"),
    )
    return t.select(
        "total_fields", "file_count", "distinct_columns", "matched_fields", "mismatched_fields",
        pct1("matched_fields", "total_fields").alias("match_rate_pct"),
        "type_mismatches", pct1("type_mismatches", "total_fields").alias("type_mismatch_pct"),
        ((F.col("_n_actual") == 1) & (F.col("_n_text") == F.col("total_fields"))).alias("all_actual_text"))


def type_distribution(rep: DataFrame) -> DataFrame:
    """Distribution of Actual_Type, Match and Inferred_Type with shares."""
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))
                     for d in ("Actual_Type", "Match", "Inferred_Type")])
    g = (rep.select(F.explode(dims).alias("d")).select("d.dimension", "d.value")
         .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("fields")))
    # The total per dimension is summed over the small aggregated result.
    total = F.sum("fields").over(Window.partitionBy("dimension"))
    return g.select("dimension", "value", "fields", pct1(F.col("fields"), total).alias("pct"))


def per_file(rep: DataFrame) -> DataFrame:
    """Per file: fields, matched, match rate, encoding, delimiter."""
    return (rep.groupBy("File")
            .agg(F.count(F.lit(1)).alias("total_fields"),
                 F.count(F.when(matched(rep), 1)).alias("matched_fields"),
                 F.min("Encoding").alias("Encoding"), F.min("Delimiter").alias("Delimiter"))
            .select("File", "total_fields", "matched_fields",
                    pct1("matched_fields", "total_fields").alias("match_rate_pct"),
                    (F.col("matched_fields") / F.col("total_fields")).alias("_rate"),
                    "Encoding", "Delimiter"))


def worst_files(rep: DataFrame, k: int = 10) -> DataFrame:
    """The k files with the lowest match rate (File breaks ties)."""
    return per_file(rep).orderBy("_rate", "File").limit(k).drop("_rate")


def mismatch_patterns(rep: DataFrame, k: int = 15) -> DataFrame:
    """A07 + T02: (Inferred_Type, Actual_Type) pairs among mismatches, top k."""
    mm = rep.filter(F.col("Match") != K.MATCH_YES)
    g = mm.groupBy("Inferred_Type", "Actual_Type").agg(F.count(F.lit(1)).alias("fields"))
    total = mm.agg(F.count(F.lit(1))).scalar()
    return (g.select("Inferred_Type", "Actual_Type", "fields", pct1(F.col("fields"), total).alias("pct"))
            .orderBy(F.desc("fields"), "Inferred_Type", "Actual_Type").limit(k))


def formats(rep: DataFrame) -> DataFrame:
    """Fields and distinct files per encoding and per delimiter."""
    enc = rep.groupBy(F.col("Encoding").alias("value")).agg(
        F.count(F.lit(1)).alias("fields"), F.countDistinct("File").alias("files"))
    dl = rep.filter(F.col("Delimiter").isNotNull()).groupBy(F.col("Delimiter").alias("value")).agg(
        F.count(F.lit(1)).alias("fields"), F.countDistinct("File").alias("files"))
    return (enc.select(F.lit("encoding").alias("dimension"), "value", "fields", "files")
            .unionByName(dl.select(F.lit("delimiter").alias("dimension"), "value", "fields", "files")))


def duplicates(rep: DataFrame, k: int = 10) -> DataFrame:
    """A09 + T02: column names that occur more than once, top k."""
    return (rep.groupBy("Column")
            .agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("File").alias("files"))
            .filter(F.col("occurrences") > 1)
            .orderBy(F.desc("occurrences"), "Column").limit(k))


def candidates(rep: DataFrame) -> DataFrame:
    """P08 + A09 count: zero-padding and trailing-minus candidates, duplicate names."""
    zp = F.col("Column").rlike(K.ZERO_PAD_NAME_REGEX) & (F.col("Inferred_Type") == K.TEXT)
    mc = (F.col("Inferred_Type") != K.TEXT) & (F.col("Actual_Type") == K.TEXT)
    dup = (rep.groupBy("Column").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
           .agg(F.count(F.lit(1)))).scalar()
    return rep.agg(F.count(F.when(zp, 1)).alias("zero_padding_candidates"),
                   F.count(F.when(mc, 1)).alias("trailing_minus_candidates"),
                   F.first(dup).alias("duplicate_names"))


# --------------------------------------------------------------------------
# T002
# --------------------------------------------------------------------------

def _pair(i: str, a: str) -> Column:
    return (F.col("Inferred_Type") == i) & (F.col("Actual_Type") == a)


def datetime_accuracy(rep: DataFrame) -> DataFrame:
    """DATETIME->DATETIME over all DATETIME inferences; N/A when none."""
    c = rep.agg(F.count(F.when(_pair(K.DATETIME, K.TEXT), 1)).alias("datetime_to_text"),
                F.count(F.when(_pair(K.DATETIME, K.DATETIME), 1)).alias("datetime_to_datetime"))
    tot = F.col("datetime_to_text") + F.col("datetime_to_datetime")
    return c.select("datetime_to_text", "datetime_to_datetime",
                    F.coalesce(pct1("datetime_to_datetime", tot), F.lit("N/A")).alias("accuracy_pct"))


def datetime_text_files(rep: DataFrame, k: int = 5) -> DataFrame:
    """The k files with the most DATETIME fields stored as TEXT."""
    return (rep.filter(_pair(K.DATETIME, K.TEXT)).groupBy("File").agg(F.count(F.lit(1)).alias("fields"))
            .orderBy(F.desc("fields"), "File").limit(k))


def integer_confusion(rep: DataFrame) -> DataFrame:
    """INTEGER->TEXT, INTEGER->INTEGER, TEXT->INTEGER counts."""
    return rep.agg(F.count(F.when(_pair(K.INTEGER, K.TEXT), 1)).alias("integer_to_text"),
                   F.count(F.when(_pair(K.INTEGER, K.INTEGER), 1)).alias("integer_to_integer"),
                   F.count(F.when(_pair(K.TEXT, K.INTEGER), 1)).alias("text_to_integer"))


def price_columns(rep: DataFrame, k: int = 5) -> DataFrame:
    """INTEGER->TEXT columns with a price keyword, most common first."""
    low = F.lower(F.col("Column"))
    hit = None
    for kw in K.PRICE_SUSPECT_KEYWORDS:
        hit = low.contains(kw) if hit is None else (hit | low.contains(kw))
    return (rep.filter(_pair(K.INTEGER, K.TEXT) & hit)
            .groupBy("Column").agg(F.count(F.lit(1)).alias("fields"))
            .orderBy(F.desc("fields"), "Column").limit(k))


def unregistered(rep: DataFrame, k: int = 10) -> DataFrame:
    """Unregistered fields by file (all) and by column (top k)."""
    u = rep.filter(is_unregistered("Inferred_Type"))
    by_file = u.groupBy(F.col("File").alias("value")).agg(F.count(F.lit(1)).alias("fields"))
    by_col = (u.groupBy(F.col("Column").alias("value")).agg(F.count(F.lit(1)).alias("fields"))
              .orderBy(F.desc("fields"), "value").limit(k))
    return (by_file.select(F.lit("file").alias("dimension"), "value", "fields")
            .unionByName(by_col.select(F.lit("column").alias("dimension"), "value", "fields")))


def storage_issues(rep: DataFrame, file_token: str = "zm114", field: str = K.STORAGE_FIELD) -> DataFrame:
    """Fields of the storage file whose name has the storage token, inferred INTEGER."""
    return rep.filter(F.lower(F.col("File")).contains(file_token.lower())
                      & F.col("Column").contains(field)
                      & (F.col("Inferred_Type") == K.INTEGER))


def t002_summary(rep: DataFrame, file_token: str = "zm114") -> DataFrame:
    """The six analysis metrics in one row."""
    st = (F.lower(F.col("File")).contains(file_token.lower()) & F.col("Column").contains(K.STORAGE_FIELD)
          & (F.col("Inferred_Type") == K.INTEGER))
    return rep.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(F.col("Inferred_Type") != F.col("Actual_Type"), 1)).alias("mismatch_count"),
        F.count(F.when(is_unregistered("Inferred_Type"), 1)).alias("unregistered_count"),
        F.count(F.when(_pair(K.DATETIME, K.TEXT), 1)).alias("datetime_text_count"),
        F.count(F.when(_pair(K.INTEGER, K.TEXT), 1)).alias("integer_text_count"),
        F.count(F.when(st, 1)).alias("storage_issues_count"))


# --------------------------------------------------------------------------
# Named report sets sharing one input
# --------------------------------------------------------------------------

def t001_report(rep: DataFrame) -> dict[str, DataFrame]:
    return {"totals": totals(rep), "type_distribution": type_distribution(rep),
            "worst_files": worst_files(rep), "mismatch_patterns": mismatch_patterns(rep),
            "candidates": candidates(rep), "formats": formats(rep), "duplicates": duplicates(rep)}


def t002_report(rep: DataFrame) -> dict[str, DataFrame]:
    return {"summary": t002_summary(rep), "unregistered": unregistered(rep),
            "datetime_accuracy": datetime_accuracy(rep), "datetime_text_files": datetime_text_files(rep), "integer_confusion": integer_confusion(rep),
            "price_columns": price_columns(rep), "storage_issues": storage_issues(rep)}


def registry_type_summary(registry: DataFrame) -> DataFrame:
    """A10 + T03: fields and distinct files per registered type, largest first."""
    return (registry.groupBy("data_type")
            .agg(F.count(F.lit(1)).alias("field_count"), F.countDistinct("file_name").alias("file_count"))
            .orderBy(F.desc("field_count"), "data_type"))


def actual_type_histogram(schemas: DataFrame) -> DataFrame:
    """Upper-cased stored type counts over all tables (S14 input)."""
    return schemas.groupBy(F.upper(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("columns"))
