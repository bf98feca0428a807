"""End-to-end jobs over a folder of extract files.

* ``analyze_folder`` (E1): list -> probe -> one scan per format group ->
  profile -> initial + corrected types -> analysis rows and registry upsert.
* ``load_folder`` (E2): scan in the registered formats -> load decisions from
  the registry and the overrides -> typed tables, one job for all layouts (K01)
  -> comparison report (J04); ``readback`` holds the stored tables to the files.
* ``fix_cycle`` (E3): registry -> fix rules -> updated registry + overrides.
* ``master_diff`` (E4): analysis against a registry snapshot taken *before*
  the upsert, so new columns and type changes are visible (D13).

Each step is a lazy DataFrame; nothing of the files or tables is kept by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typesift.functions import constants as K
from typesift.functions import text as X
from typesift.operators import fixes as FIX
from typesift.operators import load as L
from typesift.operators import profile as P
from typesift.operators import registry as R
from typesift.session import materialize
from typesift.sources import files as S
from typesift.sources import rules as RULES
from typesift.sources import typed_tables as TT


@dataclass
class Analysis:
    files: DataFrame        # probe result per file (encoding, delimiter, status)
    types: DataFrame        # per column: initial/corrected type and the deciding rules
    analysis: DataFrame     # file_name, column_name, Inferred_Type, Initial_Inferred_Type, Encoding, Delimiter
    registry: DataFrame     # registry after the upsert
    quarantine: DataFrame   # cells of rows longer than their header


def analyze_folder(spark: SparkSession, path: str, *, registry: DataFrame | None = None,
                   rules: dict[str, DataFrame] | None = None, delimiter_variant: str = "load",
                   encodings: tuple[str, ...] = K.ENCODINGS) -> Analysis:
    """Analyze every extract file in ``path`` and upsert the registry.

    rules: rule tables by name (file_rules, datetime_patterns, keywords), as
    ``sources.rules.read_rule_document`` returns them.
    """
    return analyze_files(spark, S.list_files(spark, path), registry=registry, rules=rules,
                         delimiter_variant=delimiter_variant, encodings=encodings)


def analyze_files(spark: SparkSession, files: DataFrame, *, registry: DataFrame | None = None,
                  rules: dict[str, DataFrame] | None = None, delimiter_variant: str = "load",
                  encodings: tuple[str, ...] = K.ENCODINGS) -> Analysis:
    """``analyze_folder`` for listed files."""
    rules = rules or {}
    file_rules = rules.get("file_rules")
    if file_rules is None:
        file_rules = RULES.default_file_rules(spark)
    probed = S.probe(files, delimiter_variant=delimiter_variant, file_rules=file_rules, encodings=encodings)
    cells, quarantine = S.read_cells(probed)
    patterns = RULES.patterns_of(rules.get("datetime_patterns"))
    prof = P.profile_cells(cells.select("file_name", "column_name", "value"), date_patterns=patterns)
    types = P.infer_corrected(prof, file_rules=file_rules, keywords=rules.get("keywords"))
    fmt = probed.select("file_name", F.col("encoding").alias("Encoding"), F.col("delimiter").alias("Delimiter"))
    analysis = types.join(fmt, "file_name", "left").select(
        "file_name", "column_name", F.col("corrected_type").alias("Inferred_Type"),
        F.col("initial_type").alias("Initial_Inferred_Type"), "Encoding", "Delimiter")
    new_rows = analysis.select("file_name", "column_name", F.col("Inferred_Type").alias("data_type"),
                               F.col("Initial_Inferred_Type").alias("initial_inferred_type"),
                               F.col("Encoding").alias("encoding"), F.col("Delimiter").alias("delimiter"))
    base = registry if registry is not None else R.empty_registry(spark)
    return Analysis(probed, types, analysis, R.upsert(base, new_rows), quarantine)


@dataclass
class Load:
    report: DataFrame       # File, Column, Inferred_Type, Actual_Type, Match, Encoding, Delimiter
    decisions: DataFrame    # per column: registered type, load type, date format, overridden
    tables: DataFrame       # per file: table, layout, path, status, problem, rows, files
    tally: DataFrame        # status -> files (A19)


def registered_formats(registry: DataFrame) -> DataFrame:
    """The encoding and delimiter that the analysis found, as file rules."""
    return (registry.where("encoding is not null or delimiter is not null").groupBy("file_name")
            .agg(F.max("encoding").alias("encoding"), F.max("delimiter").alias("separator")))


def load_folder(spark: SparkSession, path: str, registry: DataFrame, *, overrides: DataFrame | None = None,
                out_dir: str | None = None, normalize: bool = False, parity: bool = True) -> Load:
    """Typed tables for every readable file and the comparison report.

    Files are read in the format the registry holds for them.  With
    ``out_dir`` each file's typed table is written (see ``write_typed_tables``).
    Files whose names give the same table name are not loaded but reported
    with the status ``collision``; a file that fails is reported as ``failed``.
    """
    probed = S.probe(S.list_files(spark, path), file_rules=registered_formats(registry))
    cells, _ = S.read_cells(probed)
    types = registry.select("file_name", "column_name", "data_type")
    names = probed.where("status = 'ok'").select("file_name", F.explode("names").alias("column_name"))
    # One row per column, used by the report, the layouts and the conversion.
    dec = materialize(L.load_decisions(cells.select("file_name", "column_name", "value"), types, overrides, normalize,
                                       columns=names), "load-decisions")
    fmt = probed.select(F.col("file_name").alias("File"), F.col("encoding").alias("Encoding"), F.col("delimiter").alias("Delimiter"))
    report = L.compare_report(L.actual_types(dec, parity), types).drop("Encoding", "Delimiter").join(fmt, "File", "left")
    tables = table_plan(probed, dec)
    if out_dir:
        tables = write_typed_tables(spark, probed, tables, out_dir, normalize=normalize, parity=parity)
    tally = tables.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    return Load(report, dec, tables, tally)


def table_plan(probed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per file: table name (K08), layout (its columns with their conversions) and status."""
    at = probed.where("status = 'ok'").select("file_name", F.posexplode("names").alias("pos", "column_name"))
    out = probed.select("file_name", "path", "status").join(L.layouts(at, decisions), "file_name", "left")
    out = out.withColumn("table_name", X.sanitize_table_name(F.col("file_name")))
    shared = out.where("status = 'ok'").groupBy("table_name").agg(F.count("*").alias("files"))
    out = out.join(shared, "table_name", "left")
    status = F.when((F.col("status") == "ok") & (F.col("files") > 1), "collision").otherwise(F.col("status"))
    return materialize(out.select("table_name", "file_name", "path", status.alias("status"), "layout", "load_types", "date_formats"), "table-plan")


def _written_cells(probed: DataFrame, tables: DataFrame, normalize: bool) -> DataFrame:
    """The converted cells of the files of ``tables``, in order."""
    own = tables.select("path", F.col("table_name").alias("table"), "layout", "load_types", "date_formats")
    chunks = S.read_chunks(probed.join(own, "path"), ("table", "layout", "load_types", "date_formats"))
    rows = chunks.select("table", "layout", "load_types", "date_formats", "delimiter", F.posexplode("record").alias("k", "record"))
    rows = rows.withColumn("first", F.col("k") == 0).withColumn("fields", S.fields_of(F.col("record"), F.col("delimiter")))
    return L.written_cells(rows, normalize)


def write_typed_tables(spark: SparkSession, probed: DataFrame, tables: DataFrame, out_dir: str, *, normalize: bool = False,
                       parity: bool = True) -> DataFrame:
    """The files' typed tables below ``out_dir/tables``, in one job whatever their layouts.

    Nothing is shuffled but byte ranges: a task reads a range, converts its cells
    and writes them to its file's table (``sources.typed_tables``).  The returned
    manifest (also written to ``out_dir/_tables``) has each file's status and, for
    loaded ones, the files and rows of its table; a file whose data can't be stored
    is ``failed``, with the problem, and leaves the others.
    """
    root = out_dir.rstrip("/")
    done = TT.write_cells(_written_cells(probed, tables.where("status = 'ok'"), normalize), root, parity)
    done = done.groupBy(F.col("table").alias("table_name")).agg(
        F.min("problem").alias("problem"), F.sum("rows").alias("rows"), F.array_sort(F.collect_list("file")).alias("files"))  # the files of one table
    found = tables.drop("load_types", "date_formats").join(done, "table_name", "left")
    status = (F.when((F.col("status") == "ok") & F.col("problem").isNotNull(), "failed")
              .when((F.col("status") == "ok") & F.col("files").isNull(), "empty").when(F.col("status") == "ok", "loaded").otherwise(F.col("status")))
    loaded = status == "loaded"
    found = found.select("table_name", "file_name", "path", "layout", status.alias("status"), F.when(F.col("status") == "ok", F.col("problem")).alias("problem"),
                         F.when(loaded, F.col("rows")).alias("rows"), F.when(loaded, F.col("files")).alias("files"))
    found.write.mode("overwrite").parquet(f"{root}/_tables")
    return spark.read.parquet(f"{root}/_tables")


def stored_files(manifest: DataFrame) -> DataFrame:
    """(table, file) of the loaded tables of a manifest."""
    return manifest.where("status = 'loaded'").select(F.col("table_name").alias("table"), F.explode("files").alias("file"))


def readback(probed: DataFrame, manifest: DataFrame, decisions: DataFrame, *, normalize: bool = False) -> DataFrame:
    """What the files' converted cells and the stored tables have in common, per column (``typed_tables.readback``)."""
    at = probed.where("status = 'ok'").select("file_name", F.posexplode("names").alias("pos", "column_name"))
    plan = manifest.where("status = 'loaded'").drop("layout").join(L.layouts(at, decisions), "file_name")
    own = plan.select("path", F.col("table_name").alias("table"), "load_types", "date_formats")
    chunks = S.read_chunks(probed.join(own, "path"), ("table", "names", "load_types", "date_formats"))
    rows = chunks.select("table", "names", "load_types", "date_formats", "delimiter", F.explode("record").alias("record"))
    rows = rows.withColumn("fields", S.fields_of(F.col("record"), F.col("delimiter")))
    return TT.readback(L.source_cells(rows, normalize), TT.stored_cells(stored_files(manifest)))


def read_typed_table(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """A table that ``write_typed_tables`` has written."""
    row = spark.read.parquet(f"{out_dir.rstrip('/')}/_tables").where((F.col("table_name") == table) & (F.col("status") == "loaded")).first()
    if row is None:
        raise ValueError(f"no loaded table {table}")
    return spark.read.parquet(*[S.literal_path(f) for f in row["files"]])


def stored_consistency(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """X11: the stored types of a load, from its files' footers, against the registry."""
    return L.consistency(TT.stored_schemas(stored_files(manifest)), registry)


@dataclass
class FixCycle:
    rules: DataFrame
    summary: DataFrame
    registry: DataFrame
    overrides: DataFrame


def fix_cycle(registry: DataFrame) -> FixCycle:
    """Fix rules from the registry, the registry with them applied, and the overrides."""
    rules = FIX.fix_rules(R.as_compare_view(registry))
    return FixCycle(rules, FIX.fix_summary(rules), R.apply_fixes(registry, rules), FIX.overrides_from_fixes(rules))


def master_diff(analysis: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new columns, type mismatches) of an analysis against a registry snapshot."""
    a = analysis.select("file_name", "column_name", F.col("Inferred_Type").alias("data_type"))
    return R.compare_with_master(a, snapshot)
