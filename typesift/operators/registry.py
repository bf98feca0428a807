"""Field registry: scan, upsert, append, diff, fix application, align
(S11, K02-K04, K07, J01-J03, J08, U03).

The registry has one row per (file_name, column_name) with data_type,
initial_inferred_type, encoding and delimiter, all strings.  Spark has no
primary key, so uniqueness is kept by the operators themselves: every write
path deduplicates the incoming rows by key first (a partial aggregate, so a
key repeated many times collapses map-side) and replaces by key with an
anti join + union, which shuffles both sides on the key once.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typesift.functions import constants as K
from typesift.session import materialize
from typesift.sources.versioned import VersionedTable

KEYS = ["file_name", "column_name"]
REGISTRY_COLUMNS = ["file_name", "column_name", "data_type", "initial_inferred_type", "encoding", "delimiter"]
REGISTRY_SCHEMA = ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def align(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Bring any older registry form to the six-column schema (missing -> NULL)."""
    cols = []
    for c in REGISTRY_COLUMNS:
        cols.append((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c))
    return df.select(*cols, *(keep or []))


def dedupe_last(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row per key; with ``order`` the row with the largest order value wins
    (the last of duplicates).  Runs as a partial + final aggregate."""
    rows = align(rows, [order] if order else None)
    attrs = [c for c in REGISTRY_COLUMNS if c not in KEYS]
    if order is None:
        # No order given: duplicates must not exist, pick deterministically.
        pick = F.max(F.struct(*attrs)).alias("_r")
    else:
        pick = F.max_by(F.struct(*attrs), F.col(order)).alias("_r")
    return rows.groupBy(*KEYS).agg(pick).select(*KEYS, *[F.col(f"_r.{a}").alias(a) for a in attrs])


def upsert(base: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Insert new keys, overwrite the four attributes of existing keys."""
    new1 = dedupe_last(new, order)
    return align(base).join(new1.select(*KEYS), KEYS, "left_anti").unionByName(new1)


def append(base: DataFrame, candidates: DataFrame, repeats: bool = False) -> DataFrame:
    """Append candidate rows; a key that exists, or comes twice, is an error.

    The check is part of the plan: reading the result fails on a collision.
    ``repeats``: the registry has no primary key, so rows of either side that share a
    key are all kept; a candidate whose key the registry holds is still an error.
    """
    if repeats:
        held = base.select(*KEYS).distinct().withColumn("_held", F.lit(True))
        clash = F.raise_error(F.concat(F.lit("append: the registry has "), F.to_json(F.struct(*KEYS))))
        new = align(candidates).join(held, KEYS, "left").withColumn("file_name", F.when(F.col("_held"), clash.cast("string")).otherwise(F.col("file_name")))
        return align(base).unionByName(align(new))
    rows = align(base).withColumn("_new", F.lit(0)).unionByName(align(candidates).withColumn("_new", F.lit(1)))
    attrs = [c for c in REGISTRY_COLUMNS if c not in KEYS]
    one = rows.groupBy(*KEYS).agg(F.count("*").alias("_n"), F.max("_new").alias("_new"),
                                  F.max(F.struct(*attrs)).alias("_r"))
    clash = F.raise_error(F.concat(F.lit("append: the registry has, or the candidates repeat, "), F.to_json(F.struct(*KEYS))))
    checked = F.when((F.col("_n") > 1) & (F.col("_new") == 1), clash.cast("string")).otherwise(F.col("file_name"))
    return one.select(checked.alias("file_name"), "column_name", *[F.col(f"_r.{a}").alias(a) for a in attrs])


def compare_with_master(analyzed: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new columns, type mismatches) of an analysis against the registry.

    ``analyzed`` has file_name, column_name, data_type.  A key whose master
    type is NULL counts as new.
    """
    m = master.select(*KEYS, F.col("data_type").alias("data_type_master"))
    merged = analyzed.select(*KEYS, "data_type").join(m, KEYS, "left")
    new_cols = merged.filter(F.col("data_type_master").isNull()).select(*KEYS, "data_type")
    mismatch = merged.filter(F.col("data_type_master").isNotNull()
                             & (F.col("data_type") != F.col("data_type_master"))) \
        .select(*KEYS, "data_type", "data_type_master")
    return new_cols, mismatch


def files_with_field(registry: DataFrame, field: str) -> DataFrame:
    """J08 + U03: distinct files that have a column of this name."""
    return registry.filter(F.col("column_name") == field).select("file_name").distinct()


def inferred_schema(registry: DataFrame, file_name: str | Column | None = None) -> DataFrame:
    """(column_name, data_type) of one file, or of all files."""
    r = registry if file_name is None else registry.filter(F.col("file_name") == file_name)
    return r.select(*KEYS, "data_type")


def as_compare_view(registry: DataFrame) -> DataFrame:
    """Registry seen as a comparison report (initial -> Inferred_Type,
    registered type -> Actual_Type), as the fix generator reads it."""
    return registry.select(F.col("file_name").alias("File"), F.col("column_name").alias("Column"),
                           F.col("initial_inferred_type").alias("Inferred_Type"),
                           F.col("data_type").alias("Actual_Type"))


# Application order of fix patterns: 2, then 4, then 1 (so 1 wins); 3 is never applied.
FIX_APPLY_ORDER = {"pattern2": 1, "pattern4": 2, "pattern1": 3}


def apply_fixes(registry: DataFrame, fixes: DataFrame) -> DataFrame:
    """Registry with fix rules applied (pattern2 -> TEXT, pattern4/pattern1 -> to_type).

    Rules collapse to one row per key first (the highest application order
    wins), then one left join updates data_type.
    """
    order = F.lit(None).cast("int")
    for p, i in FIX_APPLY_ORDER.items():
        order = F.when(F.col("pattern") == p, F.lit(i)).otherwise(order)
    to = F.when(F.col("pattern") == "pattern2", F.lit(K.TEXT)).otherwise(F.col("to_type"))
    r = (fixes.select(F.col("file_name"), F.col("field_name").alias("column_name"),
                      order.alias("_o"), to.alias("_to"))
         .filter(F.col("_o").isNotNull())
         .groupBy(*KEYS).agg(F.max_by("_to", "_o").alias("_fix")))
    reg = align(registry)
    j = reg.join(r, KEYS, "left")
    return j.select(*KEYS, F.coalesce(F.col("_fix"), F.col("data_type")).alias("data_type"),
                    *[c for c in REGISTRY_COLUMNS[3:]])


def fix_application_counts(registry: DataFrame, fixes: DataFrame) -> DataFrame:
    """K04 tally: per applied pattern, rules requested and rules that matched a key."""
    applied = fixes.filter(F.col("pattern").isin(list(FIX_APPLY_ORDER)))
    keys = registry.select(*KEYS).withColumn("_hit", F.lit(True))
    j = applied.join(keys, (applied.file_name == keys.file_name) & (applied.field_name == keys.column_name), "left")
    return j.groupBy("pattern").agg(F.count(F.lit(1)).alias("requested"),
                                    F.count("_hit").alias("matched"))


def ensure_table(spark: SparkSession, name: str, location: str | None = None) -> DataFrame:
    """Create the registry table when missing and add any of the six
    columns an older table lacks (migration); returns the table."""
    cols = ", ".join(f"`{c}` STRING" for c in REGISTRY_COLUMNS)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}")
    have = set(spark.table(name).columns)
    missing = [c for c in REGISTRY_COLUMNS if c not in have]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c}` STRING' for c in missing)})")
    return spark.table(name)


def store(spark: SparkSession, root: str) -> VersionedTable:
    """A registry kept as versions under ``root``; see ``sources.versioned``."""
    return VersionedTable(spark, root, REGISTRY_SCHEMA)


def upsert_into(kept: VersionedTable, new: DataFrame, order: str | None = None) -> int:
    """K02 on a stored registry: upserts of several writers at once are all kept."""
    fresh = materialize(dedupe_last(new, order), "registry-new")
    return kept.update(lambda base: upsert(base, fresh))


def save(registry: DataFrame, name: str) -> DataFrame:
    """Replace the registry table's content with ``registry`` (six columns).

    The new content is written to a folder of its own, to which the table then
    points: one change in the catalog.  A failure before it leaves the table as it
    was.
    """
    spark = registry.sparkSession
    place = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    fresh = f"{re.sub('-[0-9a-f]{32}$', '', place.rstrip('/'))}-{uuid.uuid4().hex}"
    align(registry).write.parquet(fresh)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{fresh}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)
