"""DuckDB SQL for the correctness gate.

Each function returns a DuckDB SQL string over the pre-registered driver
views (``orders`` etc.) that must give the same rows as the matching Spark
query.  The oracle is written independently of the Spark operators: it
aggregates one boolean per rule with ``bool_and`` / ``bool_or`` and checks
calendar validity with DuckDB's own ``try_strptime``, where the Spark side
uses a bit mask and digit-shape arithmetic.
"""

from __future__ import annotations

from typesift.functions import constants as K


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(xs) -> str:
    return ", ".join(q(x) for x in xs)


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

# --------------------------------------------------------------------------
# Fixtures (same derivations as typesift.plans.fixtures)
# --------------------------------------------------------------------------

F1 = """extract_orders AS (
SELECT o_orderkey AS row_idx,
  CAST(o_orderkey AS VARCHAR) AS order_no,
  lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS partner,
  replace(substr(CAST(o_orderdate AS VARCHAR), 1, 10), '-', '') AS posted,
  substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS due_iso,
  concat(substr(CAST(o_orderdate AS VARCHAR), 9, 2), '.', substr(CAST(o_orderdate AS VARCHAR), 6, 2), '.', substr(CAST(o_orderdate AS VARCHAR), 1, 4)) AS due_de,
  concat(substr(CAST(o_orderdate AS VARCHAR), 6, 2), '/', substr(CAST(o_orderdate AS VARCHAR), 9, 2), '/', substr(CAST(o_orderdate AS VARCHAR), 1, 4)) AS due_us,
  CASE WHEN o_orderstatus = 'F' THEN concat(CAST(o_totalprice AS VARCHAR), '-') ELSE CAST(o_totalprice AS VARCHAR) END AS balance,
  CASE WHEN o_orderstatus = 'F' THEN concat(CAST(o_custkey + 1 AS VARCHAR), '-') ELSE CAST(o_custkey + 1 AS VARCHAR) END AS delta,
  CAST(o_totalprice AS VARCHAR) AS total_price,
  replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS eur,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_custkey + 1 AS VARCHAR) END AS sparse,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n.a.' ELSE replace(substr(CAST(o_orderdate AS VARCHAR), 1, 10), '-', '') END AS mostly_date,
  CASE WHEN o_orderkey % 4 = 0 THEN 'n.a.' ELSE replace(substr(CAST(o_orderdate AS VARCHAR), 1, 10), '-', '') END AS half_date,
  CAST(o_custkey % 5 + 1 AS VARCHAR) AS storage_location,
  CAST(o_custkey % 9 + 1 AS VARCHAR) AS stock_qty,
  o_orderpriority AS memo,
  o_orderpriority AS note,
  CAST(NULL AS VARCHAR) AS all_null
FROM orders)"""

F2 = """compare_report AS (
SELECT concat('file_', lpad(CAST(fno AS VARCHAR), 5, '0'), CASE WHEN fno % 3 = 0 THEN '.csv' ELSE '.txt' END) AS "File",
  CASE k % 12 WHEN 0 THEN concat('品目コード', sfx) WHEN 1 THEN concat('保管場所', sfx) WHEN 2 THEN concat('製品原価', sfx)
    WHEN 3 THEN concat('売上日', sfx) WHEN 4 THEN concat('数量', sfx) WHEN 5 THEN concat('PLANT_CD', sfx)
    WHEN 6 THEN concat('ITEM_NO', sfx) WHEN 7 THEN concat('UNIT_PRICE', sfx) WHEN 8 THEN concat('STOCK_QTY', sfx)
    WHEN 9 THEN concat('LOCATION', sfx) WHEN 10 THEN concat('MEMO', sfx) ELSE concat('単価', sfx) END AS "Column",
  inferred AS "Inferred_Type", actual AS "Actual_Type",
  CASE WHEN inferred = actual THEN '○' ELSE '×' END AS "Match",
  CASE fno % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'cp932' ELSE 'cp932' END AS "Encoding",
  CASE fno % 5 WHEN 0 THEN ',' ELSE '|' END AS "Delimiter"
FROM (
  SELECT o_orderkey AS k, CAST(floor(o_orderkey / 60) AS BIGINT) AS fno,
    CASE WHEN o_orderkey % 60 < 12 THEN '' ELSE concat('_', CAST(CAST(floor(o_orderkey % 60 / 12) AS BIGINT) AS VARCHAR)) END AS sfx,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'INTEGER' WHEN '2' THEN 'REAL' WHEN '3' THEN 'DATETIME' WHEN '4' THEN 'TEXT' ELSE '（未登録）' END AS inferred,
    CASE o_orderstatus WHEN 'F' THEN 'TEXT' WHEN 'O' THEN 'INTEGER' ELSE 'REAL' END AS actual
  FROM orders) t)"""

F3 = """registry AS (
SELECT "File" AS file_name, "Column" AS column_name, "Actual_Type" AS data_type,
  CASE WHEN "Inferred_Type" = '（未登録）' THEN NULL ELSE "Inferred_Type" END AS initial_inferred_type,
  "Encoding" AS encoding, "Delimiter" AS delimiter FROM compare_report),
snapshot AS (
SELECT file_name, column_name,
  CASE WHEN ascii(right(file_name, 5)) % 2 = 1 THEN 'TEXT' ELSE data_type END AS data_type,
  initial_inferred_type, encoding, delimiter
FROM registry WHERE column_name NOT LIKE '%_3')"""

EXTRACT_COLUMNS = ["order_no", "partner", "posted", "due_iso", "due_de", "due_us", "balance", "delta",
                   "total_price", "eur", "sparse", "mostly_date", "half_date", "storage_location",
                   "stock_qty", "memo", "note", "all_null"]

# --------------------------------------------------------------------------
# Type inference
# --------------------------------------------------------------------------

# Digit-count gates of the strict formats, written out per format.
INFER_GATES = {
    "%Y-%m-%d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "%Y/%m/%d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
    "%Y%m%d": r"^[0-9]{8}$",
    "%Y-%m-%d %H:%M:%S": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
    "%H:%M:%S": r"^[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
    "%d.%m.%Y": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$",
    "%d/%m/%Y": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "%m/%d/%Y": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
}
RATIO_GATES = {
    "%Y%m%d": r"^[0-9]{8}$",
    "%Y/%m/%d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
    "%Y-%m-%d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "%d.%m.%Y": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$",
    "%m/%d/%Y": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "%Y.%m.%d": r"^[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}$",
}
NUMERIC = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _parses(v: str, fmt: str, gate: str, ylo: int, yhi: int) -> str:
    ts = f"try_strptime({v}, {q(fmt)})"
    ycheck = "" if "%Y" not in fmt else f" AND year({ts}) BETWEEN {ylo} AND {yhi}"
    return f"(regexp_matches({v}, {q(gate)}) AND {ts} IS NOT NULL{ycheck})"


def cells_sql(source: str, columns: list[str], file_name: str, extra: str = "") -> str:
    """UNION ALL per column: (file_name, column_name, value)."""
    parts = [f"SELECT {q(file_name)} AS file_name, {q(c)} AS column_name, CAST(\"{c}\" AS VARCHAR) AS value{extra} FROM {source}"
             for c in columns]
    return "\nUNION ALL\n".join(parts)


def profile_sql(cells: str, sampled: bool = False) -> str:
    """CTE text ``prof`` over a cells CTE: per-column rule booleans.

    ``sampled``: first 200 rows per file by row_idx; date ratio over the
    first 100 non-blank and the decimal flag over the first 50 non-null
    values of each column."""
    v = "v"
    t = f"trim(v, {WS})"
    body = f"left({t}, length({t}) - 1)"
    norm = (f"CASE WHEN ends_with({t}, '-') AND regexp_matches(replace({body}, '.', ''), '^\\p{{Nd}}+$') "
            f"THEN '-' || {body} ELSE v END")
    fmt_cols = ",\n  ".join(
        f"bool_and({_parses(v, f, INFER_GATES[f], K.INFER_YEAR_MIN, K.INFER_YEAR_MAX)}) FILTER (WHERE v IS NOT NULL) AS fmt{i}"
        for i, f in enumerate(K.INFER_DATE_FORMATS))
    pat = "|".join(f"(?:{p})" for p in K.DEFAULT_DATETIME_PATTERNS)
    ratio_valid = " OR ".join(_parses("tv", f, RATIO_GATES[f], K.RATIO_YEAR_MIN, K.RATIO_YEAR_MAX)
                              for f in K.RATIO_DATE_FORMATS)
    if sampled:
        c0 = f"""c00 AS ({cells}),
rr AS (SELECT file_name, row_idx, row_number() OVER (PARTITION BY file_name ORDER BY row_idx) AS rn
  FROM (SELECT DISTINCT file_name, row_idx FROM c00)),
c0 AS (SELECT c.* FROM c00 c JOIN rr ON c.file_name = rr.file_name AND c.row_idx = rr.row_idx WHERE rr.rn <= 200)"""
        ranks = (", row_number() OVER (PARTITION BY file_name, column_name, v IS NOT NULL ORDER BY row_idx) AS rn_nn, "
                 "row_number() OVER (PARTITION BY file_name, column_name, (v IS NOT NULL AND tv <> '') ORDER BY row_idx) AS rn_nb")
        dec_f, nb_f = "v IS NOT NULL AND rn_nn <= 50", "rn_nb <= 100"
        keep = ", row_idx"
    else:
        c0 = f"c0 AS ({cells})"
        ranks, dec_f, nb_f, keep = "", "v IS NOT NULL", "TRUE", ""
    return f"""{c0},
c1 AS (SELECT file_name, column_name{keep},
  CASE WHEN value IN ({qlist(K.PANDAS_NA_TOKENS)}) THEN NULL ELSE value END AS v FROM c0),
c2 AS (SELECT *, {norm} AS nv, {t} AS tv FROM c1),
c3 AS (SELECT *, TRY_CAST(trim(nv, {WS}) AS DOUBLE) AS x, regexp_matches(nv, {q(NUMERIC)}) AS isnum{ranks} FROM c2),
prof AS (SELECT file_name, column_name, count(v) AS n_values,
  bool_and(regexp_matches(v, '^\\p{{Nd}}+$')) FILTER (WHERE v IS NOT NULL) AS all_digits,
  bool_or(starts_with(v, '0') AND length(v) > 1) FILTER (WHERE v IS NOT NULL) AS any_zpad,
  bool_and(isnum) FILTER (WHERE v IS NOT NULL) AS all_num, count(*) AS n_rows,
  bool_and(v IN ({qlist(K.BOOLEAN_SPELLINGS)})) FILTER (WHERE v IS NOT NULL) AS all_bool,
  bool_and(isnum AND abs(x) < 'inf'::DOUBLE AND x % 1 = 0) FILTER (WHERE v IS NOT NULL) AS all_int,
  coalesce(bool_or(contains(v, '.') OR contains(v, ',')) FILTER (WHERE {dec_f}), false) AS has_decimal,
  {fmt_cols},
  count(*) FILTER (WHERE v IS NOT NULL AND tv <> '' AND {nb_f}) AS n_nonblank,
  count(*) FILTER (WHERE v IS NOT NULL AND tv <> '' AND {nb_f} AND regexp_matches(tv, {q(pat)}) AND ({ratio_valid})) AS n_datepat
FROM c3 GROUP BY file_name, column_name)"""


def initial_sql() -> str:
    """CTE ``init`` over ``prof``."""
    code = " OR ".join(f"contains(upper(column_name), {q(tok)})" for tok in K.CODE_NAME_TOKENS)
    fmt_case = " ".join(f"WHEN fmt{i} THEN {q(f)}" for i, f in enumerate(K.INFER_DATE_FORMATS))
    return f"""p1 AS (SELECT *, CASE {fmt_case} END AS fmt_hit FROM prof),
init AS (SELECT *,
  CASE WHEN n_values = 0 THEN 'empty'
       WHEN {code} THEN 'code_name'
       WHEN all_digits AND any_zpad THEN 'zero_padded'
       WHEN fmt_hit IS NOT NULL THEN 'date_format'
       WHEN all_int THEN 'integral'
       WHEN all_num THEN 'numeric'
       ELSE 'fallback' END AS initial_rule FROM p1),
init2 AS (SELECT *,
  CASE WHEN initial_rule IN ('empty', 'code_name', 'zero_padded', 'fallback') THEN 'TEXT'
       WHEN initial_rule = 'date_format' THEN 'DATETIME'
       WHEN initial_rule = 'integral' THEN 'INTEGER' ELSE 'REAL' END AS initial_type,
  CASE WHEN initial_rule = 'date_format' THEN fmt_hit END AS date_format FROM init)"""


def keyword_case(name: str) -> tuple[str, str]:
    kws = ([("code", k) for k in K.DEFAULT_CODE_KEYWORDS] + [("amount", k) for k in K.DEFAULT_AMOUNT_KEYWORDS]
           + [("quantity", k) for k in K.DEFAULT_QUANTITY_KEYWORDS])
    cat = "CASE " + " ".join(f"WHEN contains(lower({name}), {q(k)}) THEN {q(c)}" for c, k in kws) + " END"
    kw = "CASE " + " ".join(f"WHEN contains(lower({name}), {q(k)}) THEN {q(k)}" for c, k in kws) + " END"
    return cat, kw


def corrected_sql() -> str:
    """CTE ``corr`` over ``init2``."""
    cat, kw = keyword_case("column_name")
    files = qlist([f for f, _, _ in K.DEFAULT_FILE_RULES])
    return f"""k1 AS (SELECT *, {cat} AS kw_cat, {kw} AS keyword FROM init2),
corr AS (SELECT *,
  CASE WHEN file_name IN ({files}) THEN 'file_rule'
       WHEN kw_cat = 'code' THEN 'code_keyword'
       WHEN kw_cat IN ('amount', 'quantity') THEN kw_cat || '_keyword'
       WHEN n_nonblank > 0 AND n_datepat / n_nonblank >= {K.DATE_RATIO_THRESHOLD} AND initial_type <> 'DATETIME' THEN 'date_ratio'
       ELSE 'initial' END AS corrected_rule FROM k1),
corr2 AS (SELECT *,
  CASE WHEN corrected_rule IN ('file_rule', 'code_keyword') THEN 'TEXT'
       WHEN corrected_rule IN ('amount_keyword', 'quantity_keyword') THEN CASE WHEN has_decimal THEN 'REAL' ELSE 'INTEGER' END
       WHEN corrected_rule = 'date_ratio' THEN 'DATETIME'
       ELSE initial_type END AS corrected_type FROM corr)"""


INITIAL_COLS = "file_name, column_name, n_values, initial_type, initial_rule, date_format"
CORRECTED_COLS = ("file_name, column_name, n_values, initial_type, initial_rule, date_format, corrected_type, "
                  "corrected_rule, keyword, n_nonblank, n_datepat, has_decimal")


def infer_initial_sql() -> str:
    cells = cells_sql("extract_orders", EXTRACT_COLUMNS, "extract_orders.txt")
    return f"WITH {F1},\n{profile_sql(cells)},\n{initial_sql()}\nSELECT {INITIAL_COLS} FROM init2"


def infer_corrected_sql() -> str:
    cells = cells_sql("extract_orders", EXTRACT_COLUMNS, "extract_orders.txt")
    return f"WITH {F1},\n{profile_sql(cells)},\n{initial_sql()},\n{corrected_sql()}\nSELECT {CORRECTED_COLS} FROM corr2"


def profile_table_sql(table: str, columns: list[str]) -> str:
    cells = cells_sql(table, columns, f"{table}.parquet")
    return f"WITH {profile_sql(cells)},\n{initial_sql()},\n{corrected_sql()}\nSELECT {CORRECTED_COLS} FROM corr2"


# --------------------------------------------------------------------------
# Reports on the comparison report (F2) and the registry
# --------------------------------------------------------------------------

def pct1(num: str, den: str) -> str:
    p = f"(({num}) * 2000 + ({den})) // (({den}) * 2)"
    return f"CASE WHEN ({den}) > 0 THEN CAST({p} // 10 AS VARCHAR) || '.' || CAST({p} % 10 AS VARCHAR) END"


def with_f2(body: str) -> str:
    return f"WITH {F2},\n{body}"


def with_f3(body: str) -> str:
    return f"WITH {F2},\n{F3},\n{body}"


UNREG = f"(\"Inferred_Type\" IS NULL OR \"Inferred_Type\" IN ({qlist(K.UNREGISTERED_SPELLINGS)}))"


def report_totals_sql() -> str:
    return with_f2(f"""t AS (SELECT count(*) AS total_fields, count(DISTINCT "File") AS file_count,
  count(DISTINCT "Column") AS distinct_columns,
  count(*) FILTER (WHERE "Match" = '○') AS matched_fields,
  count(*) FILTER (WHERE "Match" <> '○') AS mismatched_fields,
  count(*) FILTER (WHERE "Inferred_Type" <> "Actual_Type") AS type_mismatches,
  count(DISTINCT "Actual_Type") AS n_actual,
  count(*) FILTER (WHERE "Actual_Type" = 'TEXT') AS n_text FROM compare_report)
SELECT total_fields, file_count, distinct_columns, matched_fields, mismatched_fields,
  {pct1('matched_fields', 'total_fields')} AS match_rate_pct, type_mismatches,
  {pct1('type_mismatches', 'total_fields')} AS type_mismatch_pct,
  (n_actual = 1 AND n_text = total_fields) AS all_actual_text FROM t""")


def report_type_distribution_sql() -> str:
    return with_f2(f"""d AS (SELECT 'Actual_Type' AS dimension, "Actual_Type" AS value FROM compare_report
  UNION ALL SELECT 'Match', "Match" FROM compare_report
  UNION ALL SELECT 'Inferred_Type', "Inferred_Type" FROM compare_report),
g AS (SELECT dimension, value, count(*) AS fields FROM d GROUP BY dimension, value),
h AS (SELECT *, sum(fields) OVER (PARTITION BY dimension) AS total FROM g)
SELECT dimension, value, fields, {pct1('fields', 'total')} AS pct FROM h""")


def report_worst_files_sql() -> str:
    return with_f2(f"""f AS (SELECT "File", count(*) AS total_fields, count(*) FILTER (WHERE "Match" = '○') AS matched_fields,
  min("Encoding") AS "Encoding", min("Delimiter") AS "Delimiter" FROM compare_report GROUP BY "File")
SELECT "File", total_fields, matched_fields, {pct1('matched_fields', 'total_fields')} AS match_rate_pct,
  "Encoding", "Delimiter" FROM f ORDER BY matched_fields / total_fields, "File" LIMIT 10""")


def report_mismatch_patterns_sql() -> str:
    return with_f2(f"""m AS (SELECT * FROM compare_report WHERE "Match" <> '○'),
g AS (SELECT "Inferred_Type", "Actual_Type", count(*) AS fields FROM m GROUP BY ALL),
h AS (SELECT *, (SELECT count(*) FROM m) AS total FROM g)
SELECT "Inferred_Type", "Actual_Type", fields, {pct1('fields', 'total')} AS pct FROM h
ORDER BY fields DESC, "Inferred_Type", "Actual_Type" LIMIT 15""")


def report_formats_sql() -> str:
    return with_f2("""x AS (SELECT 'encoding' AS dimension, "Encoding" AS value, count(*) AS fields, count(DISTINCT "File") AS files
  FROM compare_report GROUP BY "Encoding"
  UNION ALL SELECT 'delimiter', "Delimiter", count(*), count(DISTINCT "File") FROM compare_report
  WHERE "Delimiter" IS NOT NULL GROUP BY "Delimiter")
SELECT * FROM x""")


def report_duplicates_sql() -> str:
    return with_f2("""g AS (SELECT "Column", count(*) AS occurrences, count(DISTINCT "File") AS files FROM compare_report GROUP BY "Column")
SELECT * FROM g WHERE occurrences > 1 ORDER BY occurrences DESC, "Column" LIMIT 10""")


def report_candidates_sql() -> str:
    return with_f2(f"""d AS (SELECT count(*) AS n FROM (SELECT "Column" FROM compare_report GROUP BY "Column" HAVING count(*) > 1))
SELECT count(*) FILTER (WHERE regexp_matches("Column", {q(K.ZERO_PAD_NAME_REGEX)}) AND "Inferred_Type" = 'TEXT') AS zero_padding_candidates,
  count(*) FILTER (WHERE "Inferred_Type" <> 'TEXT' AND "Actual_Type" = 'TEXT') AS trailing_minus_candidates,
  (SELECT n FROM d) AS duplicate_names FROM compare_report""")


def report_datetime_accuracy_sql() -> str:
    return with_f2(f"""c AS (SELECT count(*) FILTER (WHERE "Inferred_Type" = 'DATETIME' AND "Actual_Type" = 'TEXT') AS datetime_to_text,
  count(*) FILTER (WHERE "Inferred_Type" = 'DATETIME' AND "Actual_Type" = 'DATETIME') AS datetime_to_datetime FROM compare_report)
SELECT datetime_to_text, datetime_to_datetime,
  coalesce({pct1('datetime_to_datetime', 'datetime_to_text + datetime_to_datetime')}, 'N/A') AS accuracy_pct FROM c""")


def report_integer_confusion_sql() -> str:
    return with_f2("""x AS (SELECT count(*) FILTER (WHERE "Inferred_Type" = 'INTEGER' AND "Actual_Type" = 'TEXT') AS integer_to_text,
  count(*) FILTER (WHERE "Inferred_Type" = 'INTEGER' AND "Actual_Type" = 'INTEGER') AS integer_to_integer,
  count(*) FILTER (WHERE "Inferred_Type" = 'TEXT' AND "Actual_Type" = 'INTEGER') AS text_to_integer FROM compare_report)
SELECT * FROM x""")


def report_price_columns_sql() -> str:
    hit = " OR ".join(f"contains(lower(\"Column\"), {q(k)})" for k in K.PRICE_SUSPECT_KEYWORDS)
    return with_f2(f"""g AS (SELECT "Column", count(*) AS fields FROM compare_report
  WHERE "Inferred_Type" = 'INTEGER' AND "Actual_Type" = 'TEXT' AND ({hit}) GROUP BY "Column")
SELECT * FROM g ORDER BY fields DESC, "Column" LIMIT 5""")


def report_unregistered_sql() -> str:
    return with_f2(f"""u AS (SELECT * FROM compare_report WHERE {UNREG}),
bf AS (SELECT 'file' AS dimension, "File" AS value, count(*) AS fields FROM u GROUP BY "File"),
bc AS (SELECT 'column' AS dimension, "Column" AS value, count(*) AS fields FROM u GROUP BY "Column"
  ORDER BY fields DESC, value LIMIT 10)
SELECT * FROM bf UNION ALL SELECT * FROM bc""")


def report_t002_summary_sql() -> str:
    st = f"contains(lower(\"File\"), 'zm114') AND contains(\"Column\", {q(K.STORAGE_FIELD)}) AND \"Inferred_Type\" = 'INTEGER'"
    return with_f2(f"""x AS (SELECT count(*) AS total_records,
  count(*) FILTER (WHERE "Inferred_Type" <> "Actual_Type") AS mismatch_count,
  count(*) FILTER (WHERE {UNREG}) AS unregistered_count,
  count(*) FILTER (WHERE "Inferred_Type" = 'DATETIME' AND "Actual_Type" = 'TEXT') AS datetime_text_count,
  count(*) FILTER (WHERE "Inferred_Type" = 'INTEGER' AND "Actual_Type" = 'TEXT') AS integer_text_count,
  count(*) FILTER (WHERE {st}) AS storage_issues_count FROM compare_report)
SELECT * FROM x""")


def registry_type_summary_sql() -> str:
    return with_f3("""x AS (SELECT data_type, count(*) AS field_count, count(DISTINCT file_name) AS file_count
  FROM registry GROUP BY data_type ORDER BY field_count DESC, data_type)
SELECT * FROM x""")


REG_COLS = "file_name, column_name, data_type, initial_inferred_type, encoding, delimiter"


def registry_upsert_sql() -> str:
    return with_f3(f"""x AS (SELECT {REG_COLS} FROM snapshot s WHERE NOT EXISTS
  (SELECT 1 FROM registry r WHERE r.file_name = s.file_name AND r.column_name = s.column_name)
  UNION ALL SELECT {REG_COLS} FROM registry)
SELECT * FROM x""")


def master_new_columns_sql() -> str:
    return with_f3("""x AS (SELECT r.file_name, r.column_name, r.data_type FROM registry r
  LEFT JOIN snapshot s ON r.file_name = s.file_name AND r.column_name = s.column_name WHERE s.data_type IS NULL)
SELECT * FROM x""")


def master_type_mismatch_sql() -> str:
    return with_f3("""x AS (SELECT r.file_name, r.column_name, r.data_type, s.data_type AS data_type_master FROM registry r
  JOIN snapshot s ON r.file_name = s.file_name AND r.column_name = s.column_name
  WHERE s.data_type IS NOT NULL AND r.data_type <> s.data_type)
SELECT * FROM x""")


def registry_append_sql() -> str:
    return with_f3(f"""n AS (SELECT r.file_name, r.column_name, r.data_type FROM registry r
  LEFT JOIN snapshot s ON r.file_name = s.file_name AND r.column_name = s.column_name WHERE s.data_type IS NULL),
x AS (SELECT {REG_COLS} FROM snapshot
  UNION ALL SELECT file_name, column_name, data_type, NULL, NULL, NULL FROM n)
SELECT * FROM x""")


def registry_align_sql() -> str:
    return with_f3("""x AS (SELECT file_name, column_name, data_type, CAST(NULL AS VARCHAR) AS initial_inferred_type,
  CAST(NULL AS VARCHAR) AS encoding, CAST(NULL AS VARCHAR) AS delimiter FROM snapshot)
SELECT * FROM x""")


FIX_CTE = f"""view AS (SELECT file_name AS "File", column_name AS "Column", initial_inferred_type AS "Inferred_Type",
  data_type AS "Actual_Type" FROM registry),
fr AS (
  SELECT 'pattern1' AS pattern, "File" AS file_name, "Column" AS field_name, 'Unknown' AS from_type,
    CASE WHEN "Actual_Type" IN ('TEXT', 'INTEGER', 'REAL') THEN "Actual_Type" ELSE 'TEXT' END AS to_type,
    CAST(NULL AS VARCHAR) AS reason, 1.0::DOUBLE AS confidence FROM view WHERE {UNREG}
  UNION ALL
  SELECT 'pattern2', "File", "Column", 'DATETIME', 'TEXT', 'DATETIME推論エラー (実際は' || "Actual_Type" || ')', NULL
    FROM view WHERE "Inferred_Type" = 'DATETIME' AND "Actual_Type" = 'TEXT'
  UNION ALL
  SELECT 'pattern3', "File", "Column", 'INTEGER', 'TEXT', '価格関連フィールド (実際は' || "Actual_Type" || ')', NULL
    FROM view WHERE "Inferred_Type" = 'INTEGER' AND "Actual_Type" = 'TEXT' AND regexp_matches("Column", {q(K.PRICE_NAME_REGEX)})
  UNION ALL
  SELECT 'pattern4', "File", "Column", 'INTEGER', 'TEXT', {q(K.REASON_STORAGE)}, NULL
    FROM view WHERE "File" = {q(K.STORAGE_FILE)} AND contains("Column", {q(K.STORAGE_FIELD)}))"""


def fix_rules_sql() -> str:
    return with_f3(f"{FIX_CTE}\nSELECT * FROM fr")


def fix_summary_sql() -> str:
    pats = " UNION ALL ".join(f"SELECT {q(p)} AS pattern" for p in K.FIX_PATTERNS)
    return with_f3(f"""{FIX_CTE},
p AS ({pats}),
c AS (SELECT pattern, count(*) AS fixes FROM fr GROUP BY pattern),
x AS (SELECT p.pattern, coalesce(c.fixes, 0) AS fixes FROM p LEFT JOIN c USING (pattern)
  UNION ALL SELECT 'total', (SELECT count(*) FROM fr))
SELECT * FROM x""")


def registry_apply_fixes_sql() -> str:
    return with_f3(f"""{FIX_CTE},
fx AS (SELECT file_name, field_name AS column_name,
  arg_max(CASE WHEN pattern = 'pattern2' THEN 'TEXT' ELSE to_type END,
          CASE pattern WHEN 'pattern2' THEN 1 WHEN 'pattern4' THEN 2 ELSE 3 END) AS fix
  FROM fr WHERE pattern IN ('pattern1', 'pattern2', 'pattern4') GROUP BY file_name, field_name),
x AS (SELECT s.file_name, s.column_name, coalesce(fx.fix, s.data_type) AS data_type, s.initial_inferred_type,
  s.encoding, s.delimiter FROM snapshot s LEFT JOIN fx ON s.file_name = fx.file_name AND s.column_name = fx.column_name)
SELECT * FROM x""")


def overrides_from_fixes_sql() -> str:
    return with_f3(f"""{FIX_CTE}
SELECT file_name AS file, field_name AS field, 'force_text' AS action,
  CASE WHEN pattern = 'pattern2' THEN 'datetime' ELSE 'storage' END AS kind
FROM fr WHERE pattern IN ('pattern2', 'pattern4')""")


def overrides_from_rules_sql() -> str:
    known = " UNION ALL ".join(f"SELECT {q(f)} AS file, {q(c)} AS field, 'force_text' AS action, 'datetime' AS kind"
                               for f, c in K.KNOWN_DATETIME_OVERRIDES)
    return with_f3(f"""x AS ({known}
  UNION ALL SELECT DISTINCT file_name, {q(K.STORAGE_FIELD)}, 'force_text', 'storage' FROM registry
  WHERE column_name = {q(K.STORAGE_FIELD)})
SELECT * FROM x""")


def unregistered_by_file_sql() -> str:
    return with_f3(f"""view AS (SELECT file_name AS "File", initial_inferred_type AS "Inferred_Type", data_type AS "Actual_Type" FROM registry),
x AS (SELECT "File", count(*) AS fields, round(avg(CASE WHEN "Actual_Type" = 'TEXT' THEN 1.0 ELSE 0.0 END), 3) AS text_ratio
  FROM view WHERE {UNREG} GROUP BY "File")
SELECT * FROM x""")


def keyword_match_sql() -> str:
    cat, kw = keyword_case("column_name")
    f1 = " UNION ALL ".join(f"SELECT {q(c)} AS column_name" for c in EXTRACT_COLUMNS)
    return with_f2(f"""n AS (SELECT DISTINCT "Column" AS column_name FROM compare_report UNION {f1}),
x AS (SELECT column_name, {cat} AS category, {kw} AS keyword FROM n)
SELECT * FROM x""")


def sanitize_names_sql() -> str:
    rest = "substr(name, length(lead) + 1)"
    base = f"CASE WHEN contains({rest}, '.') THEN lead || regexp_extract({rest}, '^(.*)\\.[^.]*$', 1) ELSE name END"
    return with_f2(f"""n AS (SELECT DISTINCT "File" AS name FROM compare_report
  UNION SELECT DISTINCT o_orderpriority || '（' || o_orderstatus || '）.csv' FROM orders),
b AS (SELECT name, regexp_extract(name, '^(\\.*)', 1) AS lead FROM n),
c AS (SELECT name, regexp_replace({base}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g') AS clean FROM b)
SELECT name AS file_name, CASE WHEN clean = '' THEN 'unnamed_table'
  WHEN regexp_matches(clean, '^\\p{{Nd}}') THEN 'table_' || clean ELSE clean END AS table_name FROM c""")


def normalize_values_sql() -> str:
    cols = EXTRACT_COLUMNS
    parts = " UNION ALL ".join(f"SELECT row_idx, {q(c)} AS column_name, {c} AS value FROM extract_orders" for c in cols)
    t = f"trim(value, {WS})"
    return f"""WITH {F1},
c AS ({parts}),
x AS (SELECT row_idx, column_name, value, CASE WHEN value IS NULL THEN NULL
  WHEN regexp_matches({t}, '^(\\d+)-$') THEN '-' || regexp_extract({t}, '^(\\d+)-$', 1)
  WHEN regexp_matches({t}, '^0+(\\d+)$') AND length({t}) >= {K.ZERO_PADDING_MIN_LENGTH} THEN regexp_extract({t}, '^0+(\\d+)$', 1)
  WHEN regexp_matches({t}, '^(\\d+),(\\d+)$') THEN regexp_extract({t}, '^(\\d+),(\\d+)$', 1) || '.' || regexp_extract({t}, '^(\\d+),(\\d+)$', 2)
  ELSE {t} END AS normalized FROM c)
SELECT * FROM x"""


# --------------------------------------------------------------------------
# Typed load of the F1 extract
# --------------------------------------------------------------------------

# Test override list: the shipped overrides plus one field of the F1 extract.
LOAD_TEST_OVERRIDES = list(K.DEFAULT_OVERRIDES) + [("extract_orders.txt", "due_us", "test")]


def _load_ctes() -> str:
    cells = cells_sql("extract_orders", EXTRACT_COLUMNS, "extract_orders.txt", extra=", row_idx")
    ov = " UNION ALL ".join(f"SELECT {q(f)} AS file, {q(c)} AS field" for f, c, _ in LOAD_TEST_OVERRIDES)
    fmt_all = " ".join(f"WHEN bool_and({_parses('value', f, INFER_GATES[f], K.INFER_YEAR_MIN, K.INFER_YEAR_MAX)}) "
                       f"FILTER (WHERE value IS NOT NULL AND value <> '') THEN {q(f)}" for f in K.INFER_DATE_FORMATS)
    fmt_any = " ".join(f"WHEN bool_or({_parses('value', f, INFER_GATES[f], K.INFER_YEAR_MIN, K.INFER_YEAR_MAX)}) "
                       f"FILTER (WHERE value IS NOT NULL AND value <> '') THEN {q(f)}" for f in K.INFER_DATE_FORMATS)
    return f"""{F1},
{profile_sql(cells_sql("extract_orders", EXTRACT_COLUMNS, "extract_orders.txt"))},
{initial_sql()},
{corrected_sql()},
types AS (SELECT file_name, column_name, corrected_type AS data_type FROM corr2),
lc AS ({cells}),
lc2 AS (SELECT *, regexp_matches(value, {q(NUMERIC)}) AS isnum, TRY_CAST(trim(value, {WS}) AS DOUBLE) AS lx FROM lc),
ov AS ({ov}),
dec0 AS (SELECT file_name, column_name,
  max(CASE WHEN isnum AND lx IS NOT NULL AND (NOT (abs(lx) < 'inf'::DOUBLE AND lx % 1 = 0) OR abs(lx) >= 9.223372036854775807e18)
      THEN 1 ELSE 0 END) AS blocked,
  CASE {fmt_all} END AS fmt_all, CASE {fmt_any} END AS fmt_any
  FROM lc2 GROUP BY file_name, column_name),
dec AS (SELECT d.file_name, d.column_name, t.data_type AS registered_type,
  CASE WHEN EXISTS (SELECT 1 FROM ov WHERE ov.file = d.file_name AND ov.field = d.column_name) THEN 'TEXT'
       WHEN t.data_type = 'INTEGER' THEN CASE WHEN blocked = 1 THEN 'TEXT' ELSE 'INTEGER' END
       WHEN t.data_type IN ('REAL', 'DATETIME') THEN t.data_type ELSE 'TEXT' END AS load_type,
  coalesce(fmt_all, fmt_any) AS fmt
  FROM dec0 d LEFT JOIN types t ON d.file_name = t.file_name AND d.column_name = t.column_name)"""


def load_typed_sql() -> str:
    dt = "CASE " + " ".join(
        f"WHEN d.fmt = {q(f)} AND {_parses('c.value', f, INFER_GATES[f], K.INFER_YEAR_MIN, K.INFER_YEAR_MAX)} "
        f"THEN strftime(try_strptime(c.value, {q(f)}), '%Y-%m-%d %H:%M:%S')" for f in K.INFER_DATE_FORMATS) + " END"
    return f"""WITH {_load_ctes()}
SELECT c.file_name, c.row_idx, c.column_name, d.load_type,
  CASE WHEN d.load_type = 'INTEGER' THEN
    CASE WHEN regexp_matches(c.value, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(trim(c.value, {WS}) AS BIGINT)
         WHEN c.isnum THEN TRY_CAST(c.lx AS BIGINT) END END AS int_value,
  CASE WHEN d.load_type = 'REAL' AND c.isnum THEN c.lx END AS real_value,
  CASE WHEN d.load_type = 'TEXT' THEN c.value WHEN d.load_type = 'DATETIME' THEN {dt} END AS text_value
FROM lc2 c JOIN dec d ON c.file_name = d.file_name AND c.column_name = d.column_name"""


def compare_inferred_actual_sql() -> str:
    return f"""WITH {_load_ctes()},
act AS (SELECT file_name, column_name, CASE WHEN load_type = 'DATETIME' THEN 'TEXT' ELSE load_type END AS actual_type FROM dec)
SELECT a.file_name AS "File", a.column_name AS "Column", coalesce(t.data_type, {q(K.UNREGISTERED_LABEL)}) AS "Inferred_Type",
  a.actual_type AS "Actual_Type",
  CASE WHEN t.data_type IS NOT NULL AND upper(a.actual_type) = upper(t.data_type) THEN '○' ELSE '×' END AS "Match",
  'utf-8' AS "Encoding", ',' AS "Delimiter"
FROM act a LEFT JOIN types t ON a.file_name = t.file_name AND a.column_name = t.column_name"""


def infer_sampled_sql() -> str:
    cells = cells_sql("extract_orders", EXTRACT_COLUMNS, "extract_orders.txt", extra=", row_idx")
    return f"WITH {F1},\n{profile_sql(cells, sampled=True)},\n{initial_sql()},\n{corrected_sql()}\nSELECT {CORRECTED_COLS} FROM corr2"


def dtype_label_counts_sql(tables: dict[str, list[str]]) -> str:
    cells = "\nUNION ALL\n".join(cells_sql(t, cols, f"{t}.parquet") for t, cols in tables.items())
    return f"""WITH {profile_sql(cells)},
lab AS (SELECT file_name, CASE WHEN n_values = 0 THEN 'empty' WHEN all_bool THEN 'boolean'
  WHEN all_int AND NOT has_decimal AND n_rows = n_values THEN 'integer'
  WHEN all_num THEN 'floating' ELSE 'string' END AS dtype FROM prof)
SELECT file_name, dtype, count(*) AS columns FROM lab GROUP BY file_name, dtype"""
