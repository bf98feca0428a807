"""Registered queries for branches the basic fixtures leave empty, and for file operators on table texts.

Like the others they read whole driver tables.  Lines of ``documents.text``
and ``pages.html`` stand for the lines of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typesift.functions import constants as K
from typesift.functions import text as X
from typesift.operators import fixes as FIX
from typesift.operators import keyword_index as KI
from typesift.operators import load as L
from typesift.operators import profile as P
from typesift.operators import registry as R
from typesift.operators import reports as RP
from typesift.plans import fixtures as FX
from typesift.plans import oracle as O
from typesift.sources import dialect as DI
from typesift.sources import files as S

STORAGE_FILE = "file_00001.txt"

# --- registry, fixes and reports --------------------------------------------


def registry_upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K02 with keys that only the base has."""
    return R.upsert(FX.registry_snapshot(spark, sf_dir), FX.registry(spark, sf_dir).where("file_name like '%.csv'"))


def registry_upsert_partial_sql() -> str:
    return O.with_f3(f"""n AS (SELECT * FROM registry WHERE file_name LIKE '%.csv')
SELECT {O.REG_COLS} FROM snapshot s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.file_name = s.file_name AND n.column_name = s.column_name)
UNION ALL SELECT {O.REG_COLS} FROM n""")


def _view(spark, sf_dir):
    return R.as_compare_view(FX.registry(spark, sf_dir))


def fix_rules_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X04 with the storage file among the registered files."""
    return FIX.fix_rules(_view(spark, sf_dir), storage_file=STORAGE_FILE)


def _fix_cte() -> str:
    return O.FIX_CTE.replace(O.q(K.STORAGE_FILE), O.q(STORAGE_FILE))


def fix_rules_storage_sql() -> str:
    return O.with_f3(f"{_fix_cte()}\nSELECT * FROM fr")


def fix_application_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K04's tally: rules requested and rules that met a key."""
    return R.fix_application_counts(FX.registry_snapshot(spark, sf_dir), fix_rules_storage(spark, sf_dir))


def fix_application_counts_sql() -> str:
    return O.with_f3(f"""{_fix_cte()}
SELECT pattern, count(*) AS requested, count(s.file_name) AS matched
FROM fr LEFT JOIN snapshot s ON fr.file_name = s.file_name AND fr.field_name = s.column_name
WHERE pattern IN ('pattern1', 'pattern2', 'pattern4') GROUP BY pattern""")


def fix_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fix candidates in key order."""
    return FIX.preview(fix_rules_storage(spark, sf_dir).where("pattern = 'pattern2'"))


def fix_preview_sql() -> str:
    return O.with_f3(f"{_fix_cte()},\nx AS (SELECT * FROM fr WHERE pattern = 'pattern2' ORDER BY file_name, field_name LIMIT 10)\nSELECT * FROM x")


def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08 with the overrides that the registry's fixes give."""
    from typesift.sources import rules as RU
    return FIX.rule_status(spark, file_rules=RU.default_file_rules(spark), datetime_patterns=RU.default_datetime_patterns(spark),
                           keywords=RU.default_keywords(spark), overrides=FIX.overrides_from_fixes(fix_rules_storage(spark, sf_dir)))


def rule_status_sql() -> str:
    return O.with_f3(f"""{_fix_cte()},
o AS (SELECT CASE pattern WHEN 'pattern2' THEN 'datetime' ELSE 'storage' END AS kind FROM fr WHERE pattern IN ('pattern2', 'pattern4'))
SELECT CAST({len(K.DEFAULT_FILE_RULES)} AS BIGINT) AS unregistered_files, CAST({len(K.DEFAULT_DATETIME_PATTERNS)} AS BIGINT) AS datetime_patterns,
  CAST({len(K.DEFAULT_CODE_KEYWORDS)} AS BIGINT) AS code_fields, CAST({len(K.DEFAULT_AMOUNT_KEYWORDS)} AS BIGINT) AS amount_fields,
  CAST({len(K.DEFAULT_QUANTITY_KEYWORDS)} AS BIGINT) AS quantity_fields, true AS overrides_exist, count(*) AS total_overrides,
  count(*) FILTER (kind = 'datetime') AS datetime_overrides, count(*) FILTER (kind = 'storage') AS storage_overrides,
  count(*) = 0 AS sync_required FROM o""")


def _stored_dates(rep: DataFrame) -> DataFrame:
    """The comparison report with REAL columns stored as DATETIME instead."""
    return rep.withColumn("Actual_Type", F.when(F.col("Actual_Type") == K.REAL, K.DATETIME).otherwise(F.col("Actual_Type")))


def report_datetime_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 where DATETIME columns are stored as such."""
    return RP.datetime_accuracy(_stored_dates(FX.compare_report(spark, sf_dir)))


def report_datetime_stored_sql() -> str:
    return O.report_datetime_accuracy_sql().replace(
        "FROM compare_report)\nSELECT", "FROM (SELECT * REPLACE (CASE WHEN \"Actual_Type\" = 'REAL' THEN 'DATETIME' ELSE \"Actual_Type\" END AS \"Actual_Type\") "
        "FROM compare_report))\nSELECT")


def report_totals_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm that every stored column is TEXT."""
    return RP.totals(FX.compare_report(spark, sf_dir).where(F.col("Actual_Type") == K.TEXT))


def report_totals_text_sql() -> str:
    return O.report_totals_sql().replace("AS n_text FROM compare_report)", "AS n_text FROM compare_report WHERE \"Actual_Type\" = 'TEXT')")


def report_storage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 with the storage token that the report's files have."""
    return RP.storage_issues(FX.compare_report(spark, sf_dir), file_token="FILE_")


def report_storage_issues_sql() -> str:
    return O.with_f2(f"""x AS (SELECT * FROM compare_report WHERE contains(lower("File"), 'file_')
  AND contains("Column", {O.q(K.STORAGE_FIELD)}) AND "Inferred_Type" = 'INTEGER') SELECT * FROM x""")


def report_datetime_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with the most DATETIME fields stored as TEXT."""
    return RP.datetime_text_files(FX.compare_report(spark, sf_dir))


def report_datetime_files_sql() -> str:
    return O.with_f2("""x AS (SELECT "File", count(*) AS fields FROM compare_report WHERE "Inferred_Type" = 'DATETIME' AND "Actual_Type" = 'TEXT'
  GROUP BY "File" ORDER BY fields DESC, "File" LIMIT 5) SELECT * FROM x""")


# --- inference and load ------------------------------------------------------


def infer_file_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract's file is in the rule list."""
    rules = spark.createDataFrame([(FX.EXTRACT_FILE, "utf-8", ",")], "file_name string, encoding string, separator string")
    cells = P.to_cells(FX.extract_orders(spark, sf_dir), FX.EXTRACT_FILE, columns=FX.EXTRACT_COLUMNS)
    return P.infer_corrected(P.profile_cells(cells), file_rules=rules)


def infer_file_rule_sql() -> str:
    cols = O.CORRECTED_COLS.replace("corrected_type, corrected_rule", "'TEXT' AS corrected_type, 'file_rule' AS corrected_rule")
    return O.infer_corrected_sql().replace(f"SELECT {O.CORRECTED_COLS} FROM corr2", f"SELECT {cols} FROM corr2")


def load_decisions_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column registered INTEGER; those with fractions fall back to TEXT."""
    f1 = FX.extract_orders(spark, sf_dir)
    cells = P.to_cells(f1, FX.EXTRACT_FILE, columns=FX.EXTRACT_COLUMNS)
    types = spark.createDataFrame([(FX.EXTRACT_FILE, c, K.INTEGER) for c in FX.EXTRACT_COLUMNS], "file_name string, column_name string, data_type string")
    return L.load_decisions(cells, types, columns=types).select("column_name", "registered_type", "load_type")


def load_decisions_integer_sql() -> str:
    return f"""WITH {O._load_ctes()}
SELECT column_name, 'INTEGER' AS registered_type, CASE WHEN blocked = 1 THEN 'TEXT' ELSE 'INTEGER' END AS load_type FROM dec0"""


def scan_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract written as CSV files, then listed, probed, scanned, profiled and typed."""
    from typesift.session import scratch_dir
    folder = scratch_dir(spark, "extract-csv")
    (FX.extract_orders(spark, sf_dir).select(*FX.EXTRACT_COLUMNS)
     .write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(folder))
    probed = S.probe(S.list_files(spark, folder))
    # the parts are one extract
    cells, _ = S.read_cells(probed)
    return P.infer_corrected(P.profile_cells(cells.select(F.lit(FX.EXTRACT_FILE).alias("file_name"), "column_name", "value")))


# --- the chained product -----------------------------------------------------


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(registry, fix rules) of all driver tables as extracts."""
    from typesift.plans.catalog import PROFILE_TABLES
    from typesift.session import materialize
    parts = None  # each table's profile is aggregated on its own; the union holds one row per column
    for name, cols in PROFILE_TABLES.items():
        one = P.profile_cells(P.to_cells(FX.table(spark, sf_dir, name), f"{name}.parquet", columns=cols))
        parts = one if parts is None else parts.unionByName(one)
    types = P.infer_corrected(parts)
    new = types.select("file_name", "column_name", F.col("corrected_type").alias("data_type"), F.col("initial_type").alias("initial_inferred_type"),
                       F.lit("utf-8").alias("encoding"), F.lit(",").alias("delimiter"))
    registry = materialize(R.upsert(R.empty_registry(spark), new), "chain-registry")
    return registry, FIX.fix_rules(R.as_compare_view(registry), storage_file="orders.parquet")


def chain_fixed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 to E3 over all tables: profile -> registry -> fix rules -> registry, with the forced overrides."""
    registry, rules = _chain(spark, sf_dir)
    overrides = FIX.overrides_from_fixes(rules).select(F.col("file").alias("file_name"), F.col("field").alias("column_name"), F.lit(True).alias("o"))
    return R.apply_fixes(registry, rules).join(overrides, R.KEYS, "left").select(
        "file_name", "column_name", "data_type", "initial_inferred_type", F.coalesce("o", F.lit(False)).alias("forced_text"))


def chain_fixed_registry_sql() -> str:
    from typesift.plans.catalog import PROFILE_TABLES
    cells = "\nUNION ALL\n".join(O.cells_sql(t, cols, f"{t}.parquet") for t, cols in PROFILE_TABLES.items())
    return f"""WITH {O.profile_sql(cells)},
{O.initial_sql()},
{O.corrected_sql()}
SELECT file_name, column_name,
  CASE WHEN initial_type = 'DATETIME' AND corrected_type = 'TEXT' THEN 'TEXT' ELSE corrected_type END AS data_type,
  initial_type AS initial_inferred_type, initial_type = 'DATETIME' AND corrected_type = 'TEXT' AS forced_text FROM corr2"""


def catalog_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 + X11: the stored types of the driver tables against the registry that profiling gives."""
    from typesift.plans.catalog import PROFILE_TABLES
    registry, _ = _chain(spark, sf_dir)
    schemas = L.schema_table(spark, {t: FX.table(spark, sf_dir, t).select(*cols) for t, cols in PROFILE_TABLES.items()})
    return L.consistency(schemas, registry)


def _stored_sql() -> str:
    from typesift.plans.catalog import PROFILE_TABLES
    pairs = ", ".join(f"({O.q(t)}, {O.q(c)})" for t, cols in PROFILE_TABLES.items() for c in cols)
    return f"""st AS (SELECT table_name AS "table", column_name AS "column",
  CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'INTEGER' WHEN data_type IN ('FLOAT', 'DOUBLE') THEN 'REAL'
       WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'DATETIME' ELSE 'TEXT' END AS type
  FROM information_schema.columns WHERE (table_name, column_name) IN (VALUES {pairs}))"""


def catalog_consistency_sql() -> str:
    from typesift.plans.catalog import PROFILE_TABLES
    cells = "\nUNION ALL\n".join(O.cells_sql(t, cols, f"{t}.parquet") for t, cols in PROFILE_TABLES.items())
    return f"""WITH {O.profile_sql(cells)},
{O.initial_sql()},
{O.corrected_sql()},
{_stored_sql()}
SELECT st."table", c.file_name, st."column", c.corrected_type AS "Inferred_Type", st.type AS "Actual_Type",
  CASE WHEN st.type = c.corrected_type THEN '○' ELSE '×' END AS "Match"
FROM st JOIN corr2 c ON c.file_name = st."table" || '.parquet' AND c.column_name = st."column" """


def stored_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 over the schemas of the driver tables, with their numbers of rows."""
    from typesift.plans.catalog import PROFILE_TABLES
    tables = {t: FX.table(spark, sf_dir, t).select(*cols) for t, cols in PROFILE_TABLES.items()}
    schemas = L.schema_table(spark, tables)
    counts = None
    for t, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n")
        counts = one if counts is None else counts.unionByName(one)
    cells = schemas.join(counts, "table").groupBy("type").agg(F.sum("n").alias("cells"))
    return RP.actual_type_histogram(schemas).join(cells, "type")


def stored_type_histogram_sql() -> str:
    from typesift.plans.catalog import PROFILE_TABLES
    counts = " UNION ALL ".join(f"SELECT {O.q(t)} AS t, count(*) AS n FROM {t}" for t in PROFILE_TABLES)
    return f"""WITH {_stored_sql()},
n AS ({counts})
SELECT type, count(*) AS columns, CAST(sum(n) AS BIGINT) AS cells FROM st JOIN n ON n.t = st."table" GROUP BY type"""


def load_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract written as typed tables of several layouts in one job, read back and held to its source, with the footers' types."""
    from typesift.plans import catalog
    from typesift.session import materialize, scratch_dir
    from typesift.sources import typed_tables as TT
    _, _, dec = catalog._load_inputs(spark, sf_dir)
    dec = materialize(dec, "load-decisions")
    columns = {"extract_a": FX.EXTRACT_COLUMNS, "extract_b": FX.EXTRACT_COLUMNS[::-1], "extract_c": FX.EXTRACT_COLUMNS[3:9]}
    at = spark.createDataFrame([(FX.EXTRACT_FILE, t, i, c) for t, cols in columns.items() for i, c in enumerate(cols)],
                               "file_name string, table string, pos int, column_name string")
    plan = L.layouts(at.select(F.col("table").alias("file_name"), "pos", "column_name"),
                     at.join(dec, ["file_name", "column_name"]).select(F.col("table").alias("file_name"), "column_name", "load_type", "date_format"))
    plan = {r["file_name"]: r for r in plan.collect()}  # three layouts
    f1, rows = FX.extract_orders(spark, sf_dir, spread=True), None
    for t, cols in columns.items():
        def strings(values):
            return F.array(*[F.lit(v).cast("string") for v in values])
        one = f1.select(F.lit(t).alias("table"), F.lit(plan[t]["layout"]).alias("layout"), F.array(*cols).alias("fields"),
                        strings(plan[t]["load_types"]).alias("load_types"), strings(plan[t]["date_formats"]).alias("date_formats"), strings(cols).alias("names"))
        rows = one if rows is None else rows.unionByName(one)
    telling = rows.withColumn("first", F.lit(True))
    written = TT.write_cells(L.written_cells(telling.drop("names")), scratch_dir(spark, "typed"))
    files = materialize(written.select("table", "file"), "typed-files")
    checked = TT.readback(L.source_cells(rows.drop("layout")), TT.stored_cells(files))
    schemas = TT.stored_schemas(files).select("table", "column", "pos", "type", F.col("nulls").alias("footer_nulls"))
    return checked.join(schemas, ["table", "column"]).select(
        "table", "column", "pos", "type", "rows", "nulls", "stored_rows", "stored_nulls", "footer_nulls", "same")


def load_readback_sql() -> str:
    lists = {"extract_a": FX.EXTRACT_COLUMNS, "extract_b": FX.EXTRACT_COLUMNS[::-1], "extract_c": FX.EXTRACT_COLUMNS[3:9]}
    at = ", ".join(f"({O.q(t)}, {i}, {O.q(c)})" for t, cols in lists.items() for i, c in enumerate(cols))
    return f"""WITH cells AS ({O.load_typed_sql()}),
n AS (SELECT column_name, any_value(load_type) AS load_type, count(*) AS n,
        count(*) FILTER (int_value IS NULL AND real_value IS NULL AND text_value IS NULL) AS nulls FROM cells GROUP BY column_name),
placed(t, pos, column_name) AS (VALUES {at})
SELECT t AS "table", column_name AS "column", pos, CASE WHEN load_type = 'DATETIME' THEN 'TEXT' ELSE load_type END AS type,
  n AS rows, nulls, n AS stored_rows, nulls AS stored_nulls, nulls AS footer_nulls, true AS same FROM placed JOIN n USING (column_name)"""


# --- file operators on table texts -------------------------------------------


def line_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S03, both variants, and S10's choice on the first lines of each document."""
    docs = FX.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    head = S.first_lines(F.col("text"), K.DELIMITER_SAMPLE_LINES)
    ten = F.slice(F.split(F.col("text"), "\n"), 1, 10)
    return docs.select("doc_id", S.pick_delimiter(head, K.LOAD_DELIMITERS, "\t").alias("load_delimiter"),
                       S.pick_delimiter(head, K.ANALYZE_DELIMITERS, ",").alias("analyze_delimiter"),
                       S.first_splitting(ten).alias("headerless_delimiter"))


def _pick_sql(text: str, candidates, fallback: str) -> str:
    def count(d):
        return f"(length({text}) - length(replace({text}, {O.q(d)}, '')))"
    most = f"greatest({', '.join(count(d) for d in candidates)})"
    return "CASE WHEN " + most + f" = 0 THEN {O.q(fallback)} " + " ".join(f"WHEN {count(d)} = {most} THEN {O.q(d)}" for d in candidates) + " END"


def line_delimiters_sql() -> str:
    first = " ".join(f"WHEN contains(ten, {O.q(d)}) THEN {O.q(d)}" for d in S.HEADERLESS_CANDIDATES)
    return f"""WITH d AS (SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[1:5], chr(10)) AS h,
  array_to_string(string_split(coalesce(text, ''), chr(10))[1:10], chr(10)) AS ten FROM documents)
SELECT doc_id, {_pick_sql('h', K.LOAD_DELIMITERS, chr(9))} AS load_delimiter, {_pick_sql('h', K.ANALYZE_DELIMITERS, ',')} AS analyze_delimiter,
  CASE {first} ELSE 'N/A' END AS headerless_delimiter FROM d"""


def layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S07 and S08 on the lines of each document, with and without an expected number of columns."""
    docs = FX.table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce(F.regexp_replace("text", "\\. ", "\n"), F.lit("")), "\n")
    d = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 60).cast("int")).alias("expected"),
                    F.element_at(lines, 1).alias("head"), F.slice(lines, 2, 5).alias("body"))
    return d.select("doc_id", "expected", S.header_columns(F.col("head"), F.col("expected")).alias("header_columns"),
                    S.body_columns(F.col("body"), F.col("expected")).alias("body_columns"))


def layout_counts_sql() -> str:
    def parts(line, splitter):
        split = f"string_split_regex({line}, '\\s+')" if splitter == r"\s+" else f"string_split({line}, {O.q(splitter)})"
        return f"len([x for x in {split} if trim(x) <> ''])"

    head = "[" + ", ".join(parts("head", s) for s in K.HEADER_SPLITTERS) + "]"
    wide = "coalesce(list_max([{e} for l in body]), 0)"
    space = wide.replace("{e}", parts("l", r"\s+"))
    body = f"[{space}, {wide.replace('{e}', 'len(string_split(l, chr(9)))')}, {space}, {wide.replace('{e}', 'len(string_split(l, chr(44)))')}]"

    def choose(c, least):
        big = f"[{{'d': coalesce(abs({c}[i] - expected), 0), 'i': i, 'n': {c}[i]}} for i in range(1, len({c}) + 1) if {c}[i] > {least}]"
        return f"list_sort({big})[1].n"
    return f"""WITH s AS (SELECT doc_id, string_split(coalesce(regexp_replace(text, '\\. ', chr(10), 'g'), ''), chr(10)) AS l FROM documents),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 60 AS INTEGER) END AS expected, l[1] AS head, l[2:6] AS body FROM s),
c AS (SELECT doc_id, expected, {head} AS hc, {body} AS bc FROM d)
SELECT doc_id, expected, CAST({choose('hc', K.HEADER_MIN_COLUMNS)} AS INTEGER) AS header_columns,
  CAST({choose('bc', K.BODY_MIN_COLUMNS)} AS INTEGER) AS body_columns FROM c"""


def dialect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter and quote of every document, by all its lines."""
    docs = FX.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return DI.detect(lines, "doc_id", "line")


def dialect_scores_sql() -> str:
    bare = {q: f"regexp_replace(line, {O.q(f'{q}[^{q}]*{q}')}, '', 'g')" if q else "line" for q in DI.QUOTES}
    width = [f"length({bare[q]}) - length(replace({bare[q]}, {O.q(d)}, '')) + 1" for d, q in DI.DIALECTS]
    names = "[" + ", ".join("{'d': " + O.q(d) + ", 'q': " + O.q(q) + "}" for d, q in DI.DIALECTS) + "]"
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
w AS (SELECT doc_id, [{", ".join(width)}] AS w FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
p AS (SELECT doc_id, i, w[i] AS width, count(*) AS n FROM w, unnest(range(1, {len(width) + 1})) AS r(i) GROUP BY doc_id, i, w[i]),
s AS (SELECT doc_id, i, CAST(CAST(sum(CASE WHEN width = 1 THEN n * {DI.SCALE // 1000} ELSE n * {DI.SCALE} * (width - 1) // width END) AS BIGINT) // count(*) AS BIGINT) AS score,
        max(width) AS widest, CAST(sum(n) AS BIGINT) AS lines FROM p GROUP BY doc_id, i),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM s)
SELECT doc_id, CASE WHEN widest > 1 THEN {names}[i].d ELSE 'N/A' END AS delimiter, CASE WHEN widest > 1 THEN {names}[i].q ELSE '' END AS quote, score, lines
FROM b WHERE r = 1"""


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J07 with a keyword table that grows with the data: the words of the benchmark looked for in the addresses of all pages."""
    words = FX.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("keyword")).distinct()
    n = F.length("keyword")
    table = words.select("keyword", (-n).alias("seq"), F.when(n % 3 == 0, "code").when(n % 3 == 1, "amount").otherwise("quantity").alias("category"))
    return KI.match(FX.table(spark, sf_dir, "pages"), "url", table)


def keyword_index_sql() -> str:
    return """WITH n AS (SELECT DISTINCT url FROM pages),
k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS keyword FROM benchmark),
h AS (SELECT url, keyword, length(keyword) AS len,
        row_number() OVER (PARTITION BY url ORDER BY length(keyword) % 3, length(keyword) DESC, keyword) AS r
      FROM n JOIN k ON contains(lower(url), keyword))
SELECT n.url, CASE len % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'amount' WHEN 2 THEN 'quantity' END AS category, keyword
FROM n LEFT JOIN h ON h.url = n.url AND h.r = 1"""


def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last component and extension of each page's address."""
    p = FX.table(spark, sf_dir, "pages")
    return p.select("page_id", X.base_name(F.col("url")).alias("file_name"), X.extension(F.col("url")).alias("extension"))


def url_names_sql() -> str:
    return """WITH b AS (SELECT page_id, regexp_extract(url, '[^/\\\\]+$') AS f FROM pages)
SELECT page_id, f AS file_name, lower(regexp_extract(f, '^.+(\\.[^.]*)$', 1)) AS extension FROM b"""


QUERIES = {
    f.__name__: (f, sql()) for f, sql in (
        (registry_upsert_partial, registry_upsert_partial_sql), (fix_rules_storage, fix_rules_storage_sql),
        (fix_application_counts, fix_application_counts_sql), (fix_preview, fix_preview_sql), (rule_status, rule_status_sql),
        (report_datetime_stored, report_datetime_stored_sql), (report_totals_text, report_totals_text_sql),
        (report_storage_issues, report_storage_issues_sql), (report_datetime_files, report_datetime_files_sql),
        (infer_file_rule, infer_file_rule_sql), (load_decisions_integer, load_decisions_integer_sql),
        (scan_extract, O.infer_corrected_sql), (line_delimiters, line_delimiters_sql), (layout_counts, layout_counts_sql),
        (url_names, url_names_sql), (dialect_scores, dialect_scores_sql), (keyword_index, keyword_index_sql))}


def registry() -> dict:
    """All of them; the last need the catalog's table list."""
    return QUERIES | {f.__name__: (f, sql()) for f, sql in (
        (chain_fixed_registry, chain_fixed_registry_sql), (catalog_consistency, catalog_consistency_sql),
        (stored_type_histogram, stored_type_histogram_sql), (load_readback, load_readback_sql))}
