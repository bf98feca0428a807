"""Profiles that are kept per file and merged.

A column's profile is masks and counts: masks merge by ``bit_and`` and ``bit_or``,
counts by sums.  So the profile of a folder is the merge of its files' profiles, and
a run over a folder reads only files that are new or have changed (by path, length
and time), drops what deleted files added, and merges the rest from the stored state.
The result is that of a full run.

State: one row per (file, column), and one per file without a readable column.  It is
kept as a versioned table; a state made with other rules is not used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typesift.functions import constants as K
from typesift.operators import profile as P
from typesift.session import materialize
from typesift.sources import files as S
from typesift.sources.versioned import VersionedTable

COUNTS = ["n_values", "n_nonblank", "n_datepat", "n_rows"]
FILE = ["path", "length", "modified"]
STATE_SCHEMA = ("path string, length long, modified timestamp, file_name string, status string, encoding string, delimiter string, rules string, "
                "column_name string, n_values long, mask_all long, mask_any long, n_nonblank long, n_datepat long, n_rows long")


def rules_key(*parts) -> str:
    """What a state depends on besides the files."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def merge(states: DataFrame, by: str = "file_name") -> DataFrame:
    """The profile (P.PROFILE_SCHEMA) of all files that share ``by``, a column or expression, from their states."""
    rows = states.where("column_name is not null").withColumn("file_name", F.expr(by))
    return rows.groupBy("file_name", "column_name").agg(
        F.sum("n_values").alias("n_values"), F.bit_and("mask_all").alias("mask_all"), F.bit_or("mask_any").alias("mask_any"),
        *[F.sum(c).alias(c) for c in COUNTS[1:]])


def file_states(files: DataFrame, rules: str, *, file_rules: DataFrame | None = None, delimiter_variant: str = "load",
                date_patterns=K.DEFAULT_DATETIME_PATTERNS) -> DataFrame:
    """The states of listed files (``sources.files``), by reading them."""
    probed = S.probe(files, delimiter_variant=delimiter_variant, file_rules=file_rules)
    cells, _ = S.read_cells(probed)
    found = P.profile_cells(cells.select(F.col("path").alias("file_name"), "column_name", "value"), date_patterns=date_patterns)
    about = files.where("kind in ('text', 'excel')").select("path", "length", F.col("modificationTime").alias("modified"))
    about = about.join(probed.select("path", "file_name", "status", "encoding", "delimiter"), "path").withColumn("rules", F.lit(rules))
    return about.join(found.withColumnRenamed("file_name", "path"), "path", "left").select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")])


def changes(files: DataFrame, state: DataFrame, rules: str) -> tuple[DataFrame, DataFrame]:
    """(files to read, states to keep): files with the same path, length and time, and a state by the same rules, are kept."""
    here = files.select("path", F.col("length").alias("l"), F.col("modificationTime").alias("t"))
    same = (F.col("length") == F.col("l")) & F.col("modified").eqNullSafe(F.col("t"))
    kept = state.where(F.col("rules") == rules).join(here, "path").where(same).select(state.columns)
    return files.join(kept.select("path").distinct(), "path", "left_anti"), kept


def refresh(spark: SparkSession, folder: str, store: str, *, file_rules: DataFrame | None = None, delimiter_variant: str = "load",
            date_patterns=K.DEFAULT_DATETIME_PATTERNS) -> DataFrame:
    """Bring the state at ``store`` to what ``folder`` holds now, reading only what has changed; returns the state."""
    table = VersionedTable(spark, store, STATE_SCHEMA)
    hints = None if file_rules is None else sorted(map(tuple, file_rules.select("file_name", "encoding", "separator").collect()), key=str)
    rules = rules_key(tuple(date_patterns or ()), delimiter_variant, hints, P.FORMAT_BITS)
    files = materialize(S.list_files(spark, folder), "listing")

    def change(state: DataFrame) -> DataFrame:
        todo, kept = changes(files, state, rules)
        todo = materialize(todo, "changed-files")
        if todo.isEmpty():
            return kept
        new = file_states(todo, rules, file_rules=file_rules, delimiter_variant=delimiter_variant, date_patterns=date_patterns)
        return kept.unionByName(new)

    return table.read(table.update(change))
