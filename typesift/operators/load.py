"""Typed loading and the inferred/actual comparison.

Conversion rules per registered type:

* TEXT      - value kept as is.
* INTEGER   - parsed by the numeric grammar; unparseable -> NULL.  If any
              parsed value is fractional or outside int64 the *whole column*
              stays TEXT (one aggregate decides this per column).
* REAL      - parsed by the numeric grammar; unparseable -> NULL.
* DATETIME  - parsed with the format profiling chose (the first format that
              parses every value, else the first that parses any); rendered
              ``yyyy-MM-dd HH:mm:ss`` (``parity=True``, stored as text the
              way the original tool stores it) or as a timestamp.
* An override (file, field) keeps the column TEXT.

The per-column decision is a small table (one row per column).  The wide
typed table needs static column types, so that table is brought to the
driver (its size is the column count, not the data); the long-form variant
joins it back to the cells and stays fully distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typesift.functions import constants as K
from typesift.functions import text as X
from typesift.operators import profile as P

INT64_MAX = 9.223372036854775807e18
LOAD_NA_TOKENS: tuple[str, ...] = ()      # the load path reads with NA filtering off


def _num(v: Column, normalize: bool) -> Column:
    return X.trailing_minus_to_leading(v) if normalize else v


def integer_value(v: Column, normalize: bool = False) -> Column:
    """C01 per value: long, or NULL when the grammar rejects it."""
    n = _num(v, normalize)
    plain = n.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.when(plain, X.pystrip(n).try_cast("long")).when(
        X.is_numeric(n), X.pystrip(n).try_cast("double").try_cast("long"))


def integer_blocker(v: Column, normalize: bool = False) -> Column:
    """True when a parseable value makes an INTEGER column fall back to TEXT."""
    x = F.when(X.is_numeric(_num(v, normalize)), X.pystrip(_num(v, normalize)).try_cast("double"))
    return x.isNotNull() & (~X.is_integral(x) | (F.abs(x) >= F.lit(INT64_MAX)))


def real_value(v: Column, normalize: bool = False) -> Column:
    """C02 per value."""
    n = _num(v, normalize)
    return F.when(X.is_numeric(n), X.pystrip(n).try_cast("double"))


def datetime_text(v: Column, fmt: str | None) -> Column:
    """C03 per value: ``yyyy-MM-dd HH:mm:ss`` under ``fmt``, NULL when it does not parse.

    A time-only format gets the date 1900-01-01.
    """
    if not fmt:
        return F.lit(None).cast("string")
    ok = X.parses_as(v, fmt, K.INFER_YEAR_MIN, K.INFER_YEAR_MAX)
    p = X._parts(v, fmt)
    y, m, d = p.get("Y", F.lit(1900)), p.get("m", F.lit(1)), p.get("d", F.lit(1))
    hh, mi, ss = p.get("H", F.lit(0)), p.get("M", F.lit(0)), p.get("S", F.lit(0))
    txt = _stamp(y, m, d, hh, mi, ss)
    return F.when(ok, txt)


def _stamp(y: Column, m: Column, d: Column, hh: Column, mi: Column, ss: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of parts that are valid."""
    def two(c):
        return F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), two(m), F.lit("-"), two(d), F.lit(" "), two(hh), F.lit(":"), two(mi), F.lit(":"), two(ss))


def first_format(mask: Column) -> Column:
    """Name of the first strict format whose bit is set in ``mask``."""
    out = None
    for fmt, bit in P.FORMAT_BITS.items():
        out = F.when(P.has_bit(mask, bit), F.lit(fmt)) if out is None else out.when(P.has_bit(mask, bit), F.lit(fmt))
    return out


# --------------------------------------------------------------------------
# Decisions
# --------------------------------------------------------------------------

def load_decisions(cells: DataFrame, types: DataFrame, overrides: DataFrame | None = None, normalize: bool = False, *,
                   columns: DataFrame) -> DataFrame:
    """One row per (file_name, column_name): registered type, load type, date format.

    ``cells``: (file_name, column_name, value); ``types``: registry rows
    (file_name, column_name, data_type); ``columns``: the (file_name,
    column_name) of all columns, known from the headers or a schema.  Columns
    without a registry entry load as TEXT.
    """
    keys = ["file_name", "column_name"]
    reg = types.select(*keys, "data_type")
    # Only cells of INTEGER columns (fallback check) and DATETIME columns
    # (format choice) need classifying; the registry is one row per column.
    needs = reg.filter(F.col("data_type").isin(K.INTEGER, K.DATETIME)).select(*keys)
    c = P.classify(cells.join(needs, keys, "left_semi")
                   .withColumn("value", X.null_tokens(F.col("value"), ("",))), na_tokens=())
    stats = (c.groupBy(*keys)
             .agg(F.bit_and("m").alias("mask_all"), F.bit_or("m").alias("mask_any"),
                  F.max(F.when(integer_blocker(F.col("v"), normalize), 1).otherwise(0)).alias("_blocked")))
    # Every column gets a decision (unregistered ones load as TEXT).
    d = columns.select(*keys).distinct().join(reg, keys, "left").join(stats, keys, "left")
    if overrides is not None:
        ov = overrides.select(F.col("file").alias("file_name"), F.col("field").alias("column_name"),
                              F.lit(True).alias("_forced")).distinct()
        d = d.join(ov, ["file_name", "column_name"], "left")
    else:
        d = d.withColumn("_forced", F.lit(None).cast("boolean"))
    reg = F.col("data_type")
    load_type = (F.when(F.coalesce(F.col("_forced"), F.lit(False)), K.TEXT)
                 .when(reg == K.INTEGER, F.when(F.col("_blocked") == 1, K.TEXT).otherwise(K.INTEGER))
                 .when(reg.isin(K.REAL, K.DATETIME), reg)
                 .otherwise(K.TEXT))
    fmt = F.coalesce(first_format(F.col("mask_all")), first_format(F.col("mask_any")))
    return d.select("file_name", "column_name", reg.alias("registered_type"), load_type.alias("load_type"),
                    F.when(load_type == K.DATETIME, fmt).alias("date_format"),
                    F.coalesce(F.col("_forced"), F.lit(False)).alias("overridden"))


# --------------------------------------------------------------------------
# Typed table (wide) and typed cells (long)
# --------------------------------------------------------------------------

def typed_value(v: Column, load_type: str, date_format: str | None, normalize: bool = False, parity: bool = True) -> Column:
    """One column's conversion."""
    if load_type == K.INTEGER:
        return integer_value(v, normalize)
    if load_type == K.REAL:
        return real_value(v, normalize)
    if load_type == K.DATETIME:
        text = datetime_text(v, date_format)
        return text if parity else text.try_cast("timestamp_ntz")
    return v


def load_typed(df: DataFrame, file_name: str, types: DataFrame, *, overrides: DataFrame | None = None,
               normalize: bool = False, parity: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The extract as a typed table (K01 writes it).

    One decision per column comes to the driver, because a table's schema does.
    """
    cols = columns or df.columns
    names = df.sparkSession.createDataFrame([(file_name, c) for c in cols], "file_name string, column_name string")
    dec = {r["column_name"]: r for r in
           load_decisions(P.to_cells(df, file_name, columns=cols), types.filter(F.col("file_name") == file_name),
                          overrides, normalize, columns=names).collect()}
    return df.select(*[typed_value(F.col(f"`{c}`").cast("string"), dec[c]["load_type"], dec[c]["date_format"], normalize, parity)
                       .alias(c) for c in cols])


def with_datetime_text(df: DataFrame, value: str, fmt: str, out: str) -> DataFrame:
    """Add ``out`` = ``value`` parsed under the per-row format name in ``fmt``,
    rendered ``yyyy-MM-dd HH:mm:ss`` (NULL when it does not parse).

    The value is split once, only when its format's regex takes it; the format
    only selects which parts are year, month, day and time.
    """
    v, f = F.col(value), F.col(fmt)
    ok, roles = F.lit(False), {}
    for fm in K.INFER_DATE_FORMATS:
        roles.setdefault("time" if len(X.format_fields(fm)) == 6 else P._role(fm), []).append(fm)
        ok = F.when(f == fm, v.rlike(X.valid_date_regex([fm], K.INFER_YEAR_MIN, K.INFER_YEAR_MAX))).otherwise(ok)
    dashed = v
    for c in "/.: ":
        dashed = F.replace(dashed, F.lit(c), F.lit("-"))
    eight = F.array(v.substr(1, 4), v.substr(5, 2), v.substr(7, 2))
    d = df.select("*", F.when(ok, F.when(f.isin(roles["packed"]), eight).otherwise(F.split(dashed, "-"))).alias("_parts"))
    p = [None, *[F.try_element_at(F.col("_parts"), F.lit(i)) for i in range(1, 7)]]
    dmy, mdy, hms, time = (f.isin(roles[r]) for r in ("dmy", "mdy", "hms", "time"))
    d = d.select("*", F.when(hms, "1900").when(dmy | mdy, p[3]).otherwise(p[1]).alias("_y"),
                 F.when(hms, "1").when(mdy, p[1]).otherwise(p[2]).alias("_m"), F.when(hms, "1").when(dmy, p[1]).when(mdy, p[2]).otherwise(p[3]).alias("_d"),
                 *[F.when(hms, p[i]).when(time, p[i + 3]).otherwise("0").alias(f"_t{i}") for i in (1, 2, 3)])
    txt = _stamp(*[F.col(c) for c in ("_y", "_m", "_d", "_t1", "_t2", "_t3")])
    return d.select("*", F.when(F.col("_parts").isNotNull(), txt).alias(out)).drop("_parts", "_y", "_m", "_d", "_t1", "_t2", "_t3")


def load_typed_cells(cells: DataFrame, decisions: DataFrame, normalize: bool = False) -> DataFrame:
    """C05 in long form: (…, column_name, load_type, int_value, real_value, text_value).

    The decision table has one row per column; each cell is converted by its
    column's load type.
    """
    j = cells.join(decisions.select("file_name", "column_name", "load_type", "date_format"), ["file_name", "column_name"], "left")
    j = with_datetime_text(j, "value", "date_format", "_dt")
    v, lt = F.col("value"), F.coalesce(F.col("load_type"), F.lit(K.TEXT))
    keep = [c for c in cells.columns if c != "value"]
    return j.select(*keep, lt.alias("load_type"),
                    F.when(lt == K.INTEGER, integer_value(v, normalize)).alias("int_value"),
                    F.when(lt == K.REAL, real_value(v, normalize)).alias("real_value"),
                    F.when(lt == K.TEXT, v).when(lt == K.DATETIME, F.col("_dt")).alias("text_value"))


def _converted(rows: DataFrame, normalize: bool) -> DataFrame:
    """Cells of rows(..., fields, load_types, date_formats), cut or filled to the width of their layout, in order: pos, int_value, real_value, text_value."""
    keep = [c for c in rows.columns if c not in ("fields", "load_types", "date_formats", "record", "delimiter", "k")]
    width = F.size("load_types")
    filled = F.slice(F.concat("fields", F.array_repeat(F.lit(None).cast("string"), width)), F.lit(1), width)
    cells = rows.select(*keep, "load_types", "date_formats", F.posexplode(filled).alias("pos", "value"))
    cells = cells.select(*keep, "pos", "value", F.coalesce(F.element_at("load_types", F.col("pos") + 1), F.lit(K.TEXT)).alias("load_type"),
                         F.element_at("date_formats", F.col("pos") + 1).alias("date_format"))
    cells = with_datetime_text(cells, "value", "date_format", "_dt")
    v, lt = F.col("value"), F.col("load_type")
    return cells.select(*keep, "pos", F.when(lt == K.INTEGER, integer_value(v, normalize)).alias("int_value"),
                        F.when(lt == K.REAL, real_value(v, normalize)).alias("real_value"),
                        F.when(lt == K.TEXT, v).when(lt == K.DATETIME, F.col("_dt")).alias("text_value"))


def written_cells(rows: DataFrame, normalize: bool = False) -> DataFrame:
    """Converted cells of rows(table, layout, first, fields, load_types, date_formats), as the writer of typed tables takes them.

    first: whether the row tells its table and layout to the writer.
    """
    cells, tells = _converted(rows, normalize), F.col("first") & (F.col("pos") == 0)
    return cells.select(F.when(tells, F.col("table")).alias("table"), F.when(tells, F.col("layout")).alias("layout"), "pos", "int_value", "real_value", "text_value")


def source_cells(rows: DataFrame, normalize: bool = False) -> DataFrame:
    """(table, column, int_value, real_value, text_value) of rows(table, names, fields, load_types, date_formats)."""
    cells = _converted(rows, normalize)
    return cells.select("table", F.element_at("names", F.col("pos") + 1).alias("column"), "int_value", "real_value", "text_value")


def layouts(columns: DataFrame, decisions: DataFrame) -> DataFrame:
    """(file_name, layout, load_types, date_formats) from columns(file_name, pos, column_name); layout: JSON [name, load type, date format] of each column."""
    cols = columns.join(decisions.select("file_name", "column_name", "load_type", "date_format"), ["file_name", "column_name"], "left")
    one = cols.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct(  # the columns of one file
        "pos", "column_name", F.coalesce("load_type", F.lit(K.TEXT)).alias("load_type"), "date_format"))).alias("c"))
    return one.select("file_name", F.to_json(F.transform("c", lambda c: F.array(c["column_name"], c["load_type"], c["date_format"]))).alias("layout"),
                      F.col("c.load_type").alias("load_types"), F.col("c.date_format").alias("date_formats"))


# --------------------------------------------------------------------------
# S14 schema scan and J04 comparison
# --------------------------------------------------------------------------

def stored_type(dt: T.DataType) -> str:
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return K.INTEGER
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return K.REAL
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return K.DATETIME
    return K.TEXT


def schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type) of typed tables, from their schemas (metadata only)."""
    rows = [(t, f.name, stored_type(f.dataType)) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string")


def actual_types(decisions: DataFrame, parity: bool = True) -> DataFrame:
    """Stored type of each loaded column from the decisions (DATETIME is text under parity)."""
    t = F.when(F.col("load_type") == K.DATETIME, F.lit(K.TEXT if parity else K.DATETIME)) \
        .otherwise(F.col("load_type"))
    return decisions.select("file_name", "column_name", t.alias("actual_type"))


def compare_report(actual: DataFrame, types: DataFrame, encoding: Column | str | None = None,
                   delimiter: Column | str | None = None) -> DataFrame:
    """J04 + P09: stored columns ⟕ registry -> File, Column, Inferred_Type,
    Actual_Type, Match, Encoding, Delimiter."""
    j = actual.join(types.select("file_name", "column_name", "data_type"), ["file_name", "column_name"], "left")
    inferred = F.coalesce(F.col("data_type"), F.lit(K.UNREGISTERED_LABEL))
    match = F.when(F.col("data_type").isNotNull() & (F.upper(F.col("actual_type")) == F.upper(F.col("data_type"))),
                   K.MATCH_YES).otherwise(K.MATCH_NO)

    def lit_or(c):
        return c if isinstance(c, Column) else F.lit(c).cast("string")
    return j.select(F.col("file_name").alias("File"), F.col("column_name").alias("Column"),
                    inferred.alias("Inferred_Type"), F.col("actual_type").alias("Actual_Type"),
                    match.alias("Match"), lit_or(encoding).alias("Encoding"), lit_or(delimiter).alias("Delimiter"))


def consistency(schemas: DataFrame, registry: DataFrame) -> DataFrame:
    """X11: stored column types of all typed tables against the registry.

    ``schemas``: (table, column, type) from ``schema_table``; registry rows are
    matched to tables through the sanitised file name (K08).
    """
    reg = registry.select(X.sanitize_table_name(F.col("file_name")).alias("table"), "file_name",
                          F.col("column_name").alias("column"), "data_type")
    j = schemas.join(reg, ["table", "column"], "left")
    match = F.when(F.col("data_type").isNotNull() & (F.upper(F.col("type")) == F.upper(F.col("data_type"))),
                   K.MATCH_YES).otherwise(K.MATCH_NO)
    return j.select("table", "file_name", "column",
                    F.coalesce(F.col("data_type"), F.lit(K.UNREGISTERED_LABEL)).alias("Inferred_Type"),
                    F.col("type").alias("Actual_Type"), match.alias("Match"))
