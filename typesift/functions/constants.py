"""Fixed values the results depend on.

Everything in this module is a FIXED VALUE: the token lists, rule lists,
formats and labels below must stay exactly as written for the inferred
types, reports and fix rules to agree with the behaviour being rebuilt.
They are stated here once, in their natural order, and every operator and
the DuckDB oracle read them from here.
"""

from __future__ import annotations

# --- FIXED VALUES: logical type labels --------------------------------------
TEXT = "TEXT"
INTEGER = "INTEGER"
REAL = "REAL"
DATETIME = "DATETIME"
LOGICAL_TYPES = (TEXT, INTEGER, REAL, DATETIME)

# --- FIXED VALUES: report labels ---------------------------------------------
MATCH_YES = "○"
MATCH_NO = "×"
# Label written for a stored column that has no registry entry.
UNREGISTERED_LABEL = "（未登録）"
# Every spelling of "not registered" that the report and fix steps look for.
UNREGISTERED_SPELLINGS = ("", "Unknown", "未登録", "（未登録）")

# --- FIXED VALUES: pandas' default NA tokens (read_csv na_values) ------------
# Applied on the analyze path: a cell equal to one of these is a null.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- FIXED VALUES: spellings that pandas reads as booleans -------------------
BOOLEAN_SPELLINGS = ("True", "TRUE", "true", "False", "FALSE", "false")

# --- FIXED VALUES: column-name tokens that make a column a code (TEXT) ------
# Matched as substrings of the upper-cased column name.
CODE_NAME_TOKENS = ("CD", "コード", "ID", "NO", "番号", "指図", "ネットワーク")

# --- FIXED VALUES: strict date formats tried by the initial inference --------
# In this order; the first format that parses every value wins.
INFER_DATE_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d",
    "%Y-%m-%d %H:%M:%S", "%H:%M:%S",
    "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y",
)
# Year window of the initial inference (the nanosecond timestamp range of
# the original tool, in whole years).
INFER_YEAR_MIN = 1678
INFER_YEAR_MAX = 2261

# --- FIXED VALUES: date validity formats of the date-ratio rule -------------
# A value that matches a date pattern also has to parse under one of these.
RATIO_DATE_FORMATS = ("%Y%m%d", "%Y/%m/%d", "%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%Y.%m.%d")
RATIO_YEAR_MIN = 1
RATIO_YEAR_MAX = 9999
DATE_RATIO_THRESHOLD = 0.8
DATE_RATIO_SAMPLE = 100       # first N non-blank values, sampled mode only
DECIMAL_SAMPLE = 50           # first N non-null values, sampled mode only

# --- FIXED VALUES: default rule data ----------------------------------------
# Files whose columns are all TEXT, with their encoding and separator hints.
DEFAULT_FILE_RULES = (
    ("払出明細（大阪）_ZPR01201.txt", "shift_jis", "\t"),
    ("払出明細（滋賀）_ZPR01201.txt", "shift_jis", "\t"),
    ("zs65.txt", "utf-8", "\t"),
    ("zs65_sss.txt", "utf-8", "\t"),
)
# Date patterns of the date-ratio rule (Python regex syntax, in order).
DEFAULT_DATETIME_PATTERNS = (
    r"^\d{8}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{2}\.\d{2}\.\d{4}$",
    r"^\d{4}\d{2}\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{4}\.\d{2}\.\d{2}$",
)
# Business keywords, matched as substrings of the lower-cased column name.
# Category priority is code, then amount, then quantity; then list order.
DEFAULT_CODE_KEYWORDS = (
    "保管場所", "warehouse", "storage", "location",
    "得意先", "customer", "client", "shop",
    "品目", "item", "material", "product",
    "工場", "plant", "factory", "site",
    "会社", "company", "comp",
)
DEFAULT_AMOUNT_KEYWORDS = (
    "原価", "単価", "genka", "tanka", "price", "cost", "amount",
    "金額", "kingaku", "価格", "kakaku", "値段", "nedan",
    "料金", "ryoukin", "fee", "charge",
)
DEFAULT_QUANTITY_KEYWORDS = (
    "数量", "suuryou", "qty", "quantity", "amount",
    "個数", "kosuu", "count", "number",
    "重量", "juuryou", "weight", "wt",
)
KEYWORD_CATEGORIES = ("code", "amount", "quantity")

# ERP value patterns (anchored set): trailing minus, zero padding, decimal comma.
DEFAULT_ERP_PATTERNS = (
    ("trailing_minus", r"^(\d+)-$"),
    ("zero_padding", r"^0+(\d+)$"),
    ("decimal_comma", r"^(\d+),(\d+)$"),
)
ZERO_PADDING_MIN_LENGTH = 4   # strip zero padding only when the value is longer than 3

# --- FIXED VALUES: fix-rule generation ---------------------------------------
FIX_PATTERNS = ("pattern1", "pattern2", "pattern3", "pattern4")
PRICE_NAME_REGEX = "原価|単価|金額|価格|料金|費用"
PRICE_SUSPECT_KEYWORDS = ("原価", "単価", "genka", "tanka", "price", "cost", "amount")
ZERO_PAD_NAME_REGEX = "(?i)CODE|CD|NO|NUM"
STORAGE_FILE = "zm114.txt"
STORAGE_FIELD = "保管場所"
REASON_DATETIME = "DATETIME推論エラー (実際は{actual})"
REASON_PRICE = "価格関連フィールド (実際は{actual})"
REASON_STORAGE = "保管場所コードは文字列として扱う"
FORCE_TEXT = "force_text"
# Known DATETIME fields that are always forced to TEXT by the rule-table sync.
KNOWN_DATETIME_OVERRIDES = (
    ("GetSekkeiWBSJisseki.txt", "COMP_SCH_DT"),
    ("zs45.txt", "TecComp"),
    ("ZS61KDAY.csv", "工場出庫可能日"),
    ("ZS61KDAY.csv", "工場回答日"),
)
# Shipped load overrides (file, field, kind).
DEFAULT_OVERRIDES = (
    ("GetSekkeiWBSJisseki.txt", "COMP_SCH_DT", "datetime"),
    ("zs45.txt", "TecComp", "datetime"),
    ("ZS61KDAY.csv", "工場出庫可能日", "datetime"),
    ("ZS61KDAY.csv", "工場回答日", "datetime"),
    ("zm114.txt", "保管場所", "storage"),
)

# --- FIXED VALUES: file handling ---------------------------------------------
SKIP_EXTENSIONS = (".py", ".log", ".bak", ".db")
EXCEL_EXTENSIONS = (".xls", ".xlsx")
# Encodings tried in order (Python names, with the JVM charset used for each).
ENCODINGS = ("utf-8", "cp932", "shift_jis", "utf-16")
# Delimiter candidates: analyze-time list (fallback ",") and load-time list (fallback tab).
ANALYZE_DELIMITERS = (",", "\t", ";", "|", " ")
LOAD_DELIMITERS = ("\t", ",", "|", ";")
DELIMITER_SAMPLE_LINES = 5
# Layout scoring.
KNOWN_IRREGULAR_FILES = (("ZS58MONTH.csv", 38), ("ZS61KDAY.csv", 68))
HEADER_SPLITTERS = ("\t", " ", r"\s+", ",", ";")
HEADER_MIN_COLUMNS = 10
BODY_MIN_COLUMNS = 5
LAYOUT_DIFF_LIMIT = 5

# --- FIXED VALUES: the rule template an analysis starts from -----------------
TEMPLATE_DATETIME_PATTERNS = (
    r"^\d{8}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}\.\d{2}\.\d{4}$",
)
TEMPLATE_CODE_FIELDS = ("保管場所", "warehouse", "storage", "location")
TEMPLATE_PRICE_FIELDS = ("原価", "単価", "genka", "tanka", "price", "cost", "amount")
