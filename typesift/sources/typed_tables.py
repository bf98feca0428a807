"""Typed tables of any number of layouts, written by one job and read back in one.

Spark's own sinks write one schema a job.  ``TypedTables`` is a data source whose
writer takes converted cells, in rows, of any tables: a task keeps the cells of one
range of one file, cuts them into columns by their position, and writes Parquet
files with the table's own columns, by row groups of bounded size: that is all it
holds, however many cells its range has.  Each task leaves a fragment of the manifest; the
commit step names the fragments that count, so a table is the files that the commit
names, whatever a lost or repeated task has left beside them.

A table whose data can't be stored (two columns of one name, a value that is no
number of its column's type) is told in the manifest and leaves the others; an error
of the store fails the task.

``stored_schemas`` and ``stored_cells`` read the files that way round: footers and
cells in tasks, one job for all tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from typesift.functions import constants as K
from typesift.sources.ranges import located

#: What the writer takes: the cells of whole rows, in order; table and layout at the first cell of a chunk, else null.
CELL_SCHEMA = "table string, layout string, pos int, int_value long, real_value double, text_value string"
FRAGMENT_SCHEMA = "table string, file string, rows long, problem string, fragment string"
#: Cells of a file; a task begins another one beyond them.
FILE_CELLS = 4 << 20
#: Bytes of cells that a task holds before it writes them as a row group.
HELD_BYTES = 32 << 20

KINDS = {K.INTEGER: ("int_value", pa.int64()), K.REAL: ("real_value", pa.float64()), K.TEXT: ("text_value", pa.string()),
         K.DATETIME: ("text_value", pa.string())}


def as_table(layout: list, cells: dict[str, pa.Array], parity: bool) -> pa.Table:
    """Cells of whole rows as a table; layout: [name, load type, date format] of each column."""
    names = [c[0] for c in layout]
    if len(set(names)) < len(names):
        raise ValueError("columns share a name: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    columns = []
    for j, (_, kind, _) in enumerate(layout):
        source, stored = KINDS[kind or K.TEXT]
        column = cells[source].take(pa.array(np.arange(j, len(cells[source]), len(layout))))
        if kind == K.DATETIME and not parity:
            column = pa.compute.strptime(column, format="%Y-%m-%d %H:%M:%S", unit="us")
        columns.append(column.cast(stored) if column.type != stored and not pa.types.is_timestamp(column.type) else column)
    return pa.table(columns, names=names)


@dataclass
class Fragment(WriterCommitMessage):
    name: str | None


def _turns(tables: pa.Array) -> list[int]:
    """Where another table is told than the one before; most rows tell the same again."""
    told = np.flatnonzero(tables.is_valid().to_numpy(zero_copy_only=False))
    names = tables.take(pa.array(told)).dictionary_encode().indices.to_numpy()
    return told[np.flatnonzero(np.diff(names, prepend=-1))].tolist()


class _File:
    """Files of one table, one after the other, each written by row groups: held is what one group takes, however many cells there are."""

    def __init__(self, root: str, table: str, layout: list, parity: bool):
        self.root, self.table, self.layout, self.parity = root, table, layout, parity
        self.held: list[pa.RecordBatch] = []
        self.cells = self.bytes = 0
        self._begin()

    def _begin(self) -> None:
        self.rows, self.name, self.writer, self.problem = 0, None, None, None

    def hold(self, batch: pa.RecordBatch) -> None:
        # Copied, as a column or a slice of a batch keeps all of it in memory, with the layouts that its rows tell.
        own = {c: pa.concat_arrays([batch.column(c)]) for c in ("int_value", "real_value", "text_value")}
        self.held.append(pa.RecordBatch.from_pydict(own))
        self.cells += batch.num_rows
        self.bytes += self.held[-1].nbytes
        if self.bytes > HELD_BYTES:
            self._group()

    def _group(self) -> None:
        """Write the whole rows that are held as a row group; what is left of a row stays."""
        n = self.cells - self.cells % len(self.layout)
        if not n:
            return
        cells = pa.Table.from_batches(self.held)
        self.held, self.cells, self.bytes = cells.slice(n).to_batches(), self.cells - n, 0
        self.rows += n // len(self.layout)
        if self.problem:
            return
        try:
            found = as_table(self.layout, {c: cells.column(c).slice(0, n).combine_chunks() for c in cells.column_names}, self.parity)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ValueError) as e:
            self.problem = str(e).partition("\n")[0][:500]
            return
        if self.writer is None:  # an error of the store is the task's
            import pyarrow.parquet as pq
            self.name = f"{self.root}/tables/{self.table}/{uuid.uuid4().hex}.parquet"
            fs, inner = located(self.name)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            self.writer = pq.ParquetWriter(inner, found.schema, filesystem=fs)
        self.writer.write_table(found)

    def end(self) -> list[dict]:
        """End the file with the whole rows that are held; its line of the manifest, if it has rows."""
        self._group()
        if self.writer:
            self.writer.close()
        if self.writer and self.problem:  # of a later group: the file does not count
            fs, inner = located(self.name)
            fs.delete_file(inner)
        line = {"table": self.table, "file": None if self.problem else self.name, "rows": self.rows, "problem": self.problem}
        lines = [line] if self.rows else []
        self._begin()
        return lines


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.job, self.parity = options["path"].rstrip("/"), options["job"], options.get("parity", "true") == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Fragment:
        rows: list[dict] = []
        file: _File | None = None
        for b in batches:
            cuts = [0, *_turns(b.column("table")), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                name = b.column("table")[lo].as_py()
                if name is not None and (file is None or name != file.table):
                    rows += file.end() if file else []
                    file = _File(self.root, name, json.loads(b.column("layout")[lo].as_py()), self.parity)
                if file:
                    file.hold(b.slice(lo, hi - lo))
            if file and file.rows * len(file.layout) + file.cells > FILE_CELLS:
                rows += file.end()
        rows += file.end() if file else []
        if not rows:
            return Fragment(None)
        name = uuid.uuid4().hex
        fs, folder = located(f"{self.root}/_commits/{self.job}")
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}.json") as f:
            f.write("".join(json.dumps(r | {"fragment": name}) + "\n" for r in rows).encode())
        return Fragment(name)

    def commit(self, messages: list[Fragment | None]) -> None:
        fs, folder = located(f"{self.root}/_commits")
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{self.job}.json") as f:  # one line a task
            f.write("".join(json.dumps({"fragment": m.name}) + "\n" for m in messages if m and m.name).encode())

    def abort(self, messages: list[Fragment | None]) -> None:
        """Nothing is named, so nothing counts."""


class TypedTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "typed_tables"

    def schema(self) -> str:
        return CELL_SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write_cells(cells: DataFrame, root: str, parity: bool = True) -> DataFrame:
    """Write the tables of ``cells`` (CELL_SCHEMA) below ``root`` in one job; (table, file, rows, problem) of what was written."""
    spark, job = cells.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(TypedTables)
    cells.write.format("typed_tables").mode("append").option("path", root).option("job", job).option("parity", str(parity).lower()).save()
    counted = spark.read.schema("fragment string").json(f"{root.rstrip('/')}/_commits/{job}.json")
    if counted.isEmpty():
        return spark.createDataFrame([], FRAGMENT_SCHEMA).drop("fragment")
    rows = spark.read.schema(FRAGMENT_SCHEMA).json(f"{root.rstrip('/')}/_commits/{job}")
    return rows.join(counted, "fragment", "left_semi").drop("fragment")


# ---- reading back ---------------------------------------------------------

def _kind(t: pa.DataType) -> str:
    if pa.types.is_integer(t):
        return K.INTEGER
    if pa.types.is_floating(t):
        return K.REAL
    return K.DATETIME if pa.types.is_timestamp(t) or pa.types.is_date(t) else K.TEXT


def _spread(files: DataFrame) -> DataFrame:
    return files.select("table", "file").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "file")


def stored_schemas(files: DataFrame) -> DataFrame:
    """(table, column, pos, type, rows, nulls) from the footers of files(table, file); nulls is null where a footer doesn't tell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        for b in batches:
            for r in b.to_pylist():
                fs, inner = located(r["file"])
                with pq.ParquetFile(inner, filesystem=fs) as f:
                    meta = f.metadata
                    schema = f.schema_arrow
                    groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                    at = {groups[0].column(k).path_in_schema.partition(".")[0]: k for k in range(meta.num_columns - 1, -1, -1)} if groups else {}
                    rows = []
                    for pos, c in enumerate(schema):
                        stats = [g.column(at[c.name]).statistics for g in groups] if c.name in at and not pa.types.is_nested(c.type) else [None]
                        known = groups and all(s is not None and s.has_null_count for s in stats)
                        rows.append((r["table"], c.name, pos, _kind(c.type), meta.num_rows, sum(s.null_count for s in stats) if known else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                                                     names=["table", "column", "pos", "type", "rows", "nulls"])

    found = _spread(files).mapInArrow(run, "table string, column string, pos int, type string, rows long, nulls long")
    return found.groupBy("table", "column").agg(
        F.min("pos").alias("pos"), F.when(F.min("type") == F.max("type"), F.min("type")).otherwise(F.lit(K.TEXT)).alias("type"), F.sum("rows").alias("rows"),
        F.when(F.count("nulls") == F.count("*"), F.sum("nulls")).alias("nulls"))


def stored_cells(files: DataFrame, batch_rows: int = 4096) -> DataFrame:
    """(table, column, int_value, real_value, text_value) of every cell of files(table, file)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        for b in batches:
            for r in b.to_pylist():
                fs, inner = located(r["file"])
                with pq.ParquetFile(inner, filesystem=fs) as f:
                    for rows in f.iter_batches(batch_rows):
                        for c in rows.schema:
                            n, kind, values = rows.num_rows, _kind(c.type), rows.column(c.name)
                            if kind == K.DATETIME:
                                values = pa.compute.strftime(values.cast(pa.timestamp("s"), safe=False), format="%Y-%m-%d %H:%M:%S")
                            own = {"int_value": pa.nulls(n, pa.int64()), "real_value": pa.nulls(n, pa.float64()), "text_value": pa.nulls(n, pa.string())}
                            source, stored = KINDS[kind]
                            own[source] = values.cast(stored)
                            yield pa.RecordBatch.from_arrays([pa.array([r["table"]] * n, pa.string()), pa.array([c.name] * n, pa.string()), *own.values()],
                                                             names=["table", "column", *own])

    return _spread(files).mapInArrow(run, "table string, column string, int_value long, real_value double, text_value string")


def column_sums(cells: DataFrame) -> DataFrame:
    """Per (table, column): rows, nulls and an order-free checksum of the values, in two lanes that copies don't cancel."""
    value = F.coalesce(F.col("int_value").cast("string"), F.col("real_value").cast("string"), F.col("text_value"))
    hashed = cells.select("table", "column", value.alias("v")).select(
        "table", "column", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(k))).alias(f"h{k}") for k in (1, 2)])
    # Each lane is three sums of 21 or 22 bits: a long holds those of 2^41 rows, and needs no decimals.
    sums = [F.sum(part).alias(f"sum{k}{i}") for k in (1, 2) for i, part in enumerate(
        (F.shiftrightunsigned(f"h{k}", 42), F.shiftrightunsigned(f"h{k}", 21).bitwiseAND(F.lit(0x1FFFFF)), F.col(f"h{k}").bitwiseAND(F.lit(0x1FFFFF))))]
    found = hashed.groupBy("table", "column").agg(F.count("*").alias("rows"), F.sum(F.col("v").isNull().cast("long")).alias("nulls"), *sums)
    return found.select("table", "column", "rows", "nulls", *[F.struct(*[f"sum{k}{i}" for i in range(3)]).alias(f"sum{k}") for k in (1, 2)])


def readback(source: DataFrame, stored: DataFrame) -> DataFrame:
    """C05's check: (table, column, rows, nulls, stored_rows, stored_nulls, same) of converted source cells against the stored tables.

    Each side is read once.  same: equal numbers and equal checksums; a column
    that one side lacks is not the same.
    """
    a, b = column_sums(source), column_sums(stored)
    for old, new in (("rows", "stored_rows"), ("nulls", "stored_nulls"), ("sum1", "s1"), ("sum2", "s2")):
        b = b.withColumnRenamed(old, new)
    same = ((F.col("rows") == F.col("stored_rows")) & (F.col("nulls") == F.col("stored_nulls"))
            & F.col("sum1").eqNullSafe(F.col("s1")) & F.col("sum2").eqNullSafe(F.col("s2")))
    return a.join(b, ["table", "column"], "full").select(
        "table", "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "nulls", "stored_rows", "stored_nulls")], F.coalesce(same, F.lit(False)).alias("same"))
