"""Column profiling and type inference.

Shape of the job
----------------
Input is the long *cell* form ``(file_name, column_name, value)``; a wide
DataFrame is turned into it by ``unpivot`` (an ``Expand`` node, no array is
materialised).  Each cell is classified once into an integer bit mask by
cheap built-in expressions, and one grouped aggregate per
``(file_name, column_name)`` folds the masks with ``bit_and`` / ``bit_or``
plus three counts.  Partial aggregation runs map-side, so the shuffle carries
one small row per column per task, whatever the row count; a column holding a
third of all cells is no hotter than any other, because no value-level key
is ever shuffled.

The decision rules then run on that small per-column result.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typesift.functions import constants as K
from typesift.functions import text as X
from typesift.operators import keyword_index as KI

# Bit layout of the per-value mask.
BIT_DIGITS = 1 << 0       # str.isdigit()
BIT_ZPAD = 1 << 1         # leading zero, length > 1
BIT_NUM = 1 << 2          # float() succeeds after trailing-minus normalisation
BIT_INT = 1 << 3          # ... and the value is integral
BIT_DEC = 1 << 4          # contains '.' or ','
FORMAT_BITS = {fmt: 1 << (5 + i) for i, fmt in enumerate(K.INFER_DATE_FORMATS)}
BIT_BOOL = 1 << (5 + len(K.INFER_DATE_FORMATS))   # a spelling of true or false

PROFILE_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("n_values", T.LongType()),
    T.StructField("mask_all", T.LongType()),
    T.StructField("mask_any", T.LongType()),
    T.StructField("n_nonblank", T.LongType()),
    T.StructField("n_datepat", T.LongType()),
    T.StructField("n_rows", T.LongType()),
])


# --------------------------------------------------------------------------
# Cells
# --------------------------------------------------------------------------

def to_cells(df: DataFrame, file_name: str | None = None, *, file_col: str | None = None,
             columns: list[str] | None = None) -> DataFrame:
    """Wide -> long ``(file_name, column_name, value)`` with string values.

    ``file_name`` gives a literal file name; ``file_col`` names a column of
    ``df`` that already holds it.  Non-string columns are cast to string.
    """
    if (file_name is None) == (file_col is None):
        raise ValueError("give exactly one of file_name or file_col")
    cols = [c for c in (columns or df.columns) if c != file_col]
    if not cols:
        raise ValueError("no columns to profile")
    fcol = F.lit(file_name) if file_col is None else F.col(file_col)
    wide = df.select(fcol.alias("file_name"),
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    return wide.unpivot(["file_name"], cols, "column_name", "value")


def cells_of(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Cells of several extracts (U01: UNION ALL of per-file results)."""
    parts = [to_cells(df, name) for name, df in tables]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --------------------------------------------------------------------------
# Per-value mask and per-column profile
# --------------------------------------------------------------------------

def _role(fmt: str) -> str:
    """Which numeric parts hold year/month/day for a strict format."""
    fields = X.format_fields(fmt)
    if X._packed(fmt):
        return "packed"
    head = "".join(fields[:3])
    return {"Ymd": "ymd", "dmY": "dmy", "mdY": "mdy", "HMS": "hms"}[head]


_UNSIGNED, _EXPONENT = r"(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)", r"(?:[eE][+-]?+[0-9]++)?+\s*+$"
#: A stripped value that is a number, or one with a trailing minus.
NUMBER_REGEX = rf"^(?:{_UNSIGNED}(?:-\z|{_EXPONENT})|[+-]{_UNSIGNED}{_EXPONENT})"
#: Digits of which a double is finite, whatever they are.
FINITE_DIGITS = 300


def _classify_stages(na_tokens: tuple, date_patterns: tuple, keep: tuple) -> list[list]:
    """The select-argument lists of ``classify``, stage by stage."""
    # All of a stage's code ends in one generated method, and the JIT compiles none
    # above 8,000 bytes.  So a cell's first character sorts out what can be a number
    # or a date, digits need one regex, and a format is one regex that knows the calendar.
    stages: list[list] = []
    own = ["file_name", "column_name", *keep, "v"]
    stages.append([*own[:-1], X.null_tokens(F.col("value"), na_tokens).alias("v")])
    v, t, a = F.col("v"), F.col("t"), F.col("a")
    stages.append(["*", F.ascii(v).alias("a")])
    stages.append(["*", F.when(a.between(48, 57), v.rlike(r"\A[0-9]+\z")).otherwise(False).alias("plain")])
    plain, odd = F.col("plain"), F.col("odd")
    # odd: not ASCII digits, but white space, a sign, a mark, a digit or no ASCII in front
    stages.append(["*", F.when((a < 58) | (a > 127), ~plain).otherwise(False).alias("odd")])
    edge = reduce(lambda x, y: x | y, [v.endswith(c) for c in X.PY_WHITESPACE], a <= 32)
    wide = F.octet_length(v) != F.length(v)
    stages.append(["*", F.when(odd & edge, X.pystrip(v)).otherwise(v).alias("t"),
                   F.when(odd & (a >= 48) & wide, X.is_all_digits(v)).otherwise(plain).alias("digits")])
    stages.append(["*", F.when(odd, ~t.contains("/") & ~t.contains(":") & t.rlike(NUMBER_REGEX)).otherwise(plain).alias("isnum")])
    isnum = F.col("isnum")
    sizes = [len(s) for f in K.INFER_DATE_FORMATS + K.RATIO_DATE_FORMATS for s in X.format_shapes(f)]
    # A date is no number, but for eight digits.
    maybe = odd & F.octet_length(t).between(min(sizes), max(sizes)) & (~isnum | (v != t)) & F.ascii(t).between(48, 57)
    number = F.when(t.endswith("-"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    stages.append(["*", F.when(plain, F.octet_length(v) == 8).when(maybe, True).otherwise(False).alias("datey"),
                   F.when(isnum & (odd | (F.octet_length(v) > FINITE_DIGITS)), number.try_cast("double")).alias("x")])
    datey = F.col("datey")

    def strict(formats):
        bits = [F.when(v.rlike(X.valid_date_regex([f], K.INFER_YEAR_MIN, K.INFER_YEAR_MAX)), FORMAT_BITS[f]).otherwise(0) for f in formats]
        return reduce(lambda p, q: p + q, bits, F.lit(0))

    # A value's mark tells which formats can fit.  They see the raw value: surrounding whitespace fails them.
    packed, rest = [f for f in K.INFER_DATE_FORMATS if X._packed(f)], [f for f in K.INFER_DATE_FORMATS if not X._packed(f)]
    fits = F.when(isnum, strict(packed))
    for mark in ":/.-":
        fits, rest = fits.when(t.contains(mark), strict([f for f in rest if mark in f])), [f for f in rest if mark not in f]
    stages.append(["*", F.when(datey & (v == t), fits.otherwise(strict(rest))).otherwise(0).alias("fb")])
    fmt_bits = F.col("fb")
    # The ratio's years include those of the initial formats, so what fits one that both have is a date.
    both = sum(FORMAT_BITS[f] for f in K.INFER_DATE_FORMATS if f in K.RATIO_DATE_FORMATS)
    least = min(len(s) for f in K.RATIO_DATE_FORMATS for s in X.format_shapes(f))
    pat = t.rlike(X.fold_patterns(date_patterns)) if date_patterns else F.lit(False)
    ratio_hit = (datey & (F.octet_length(t) >= least) & pat
                 & (has_bit(fmt_bits, both) | t.rlike(X.valid_date_regex(K.RATIO_DATE_FORMATS, K.RATIO_YEAR_MIN, K.RATIO_YEAR_MAX))))
    whole = F.when(odd | (F.octet_length(v) > FINITE_DIGITS), F.coalesce(X.is_integral(F.col("x")), F.lit(False))).otherwise(True)
    mask = (F.when(F.col("digits"), BIT_DIGITS).otherwise(0)
            + F.when((a == 48) & (F.octet_length(v) > 1), BIT_ZPAD).otherwise(0)
            + F.when(isnum, F.when(whole, BIT_NUM + BIT_INT).otherwise(BIT_NUM)).otherwise(0)
            + F.when(~plain & X.has_decimal_mark(v), BIT_DEC).otherwise(0)
            + F.when(~plain & v.isin(*K.BOOLEAN_SPELLINGS), BIT_BOOL).otherwise(0)
            + fmt_bits)
    nonblank = v.isNotNull() & (t != "")
    stages.append([*own, F.when(v.isNotNull(), mask.cast("long")).alias("m"), nonblank.alias("nb"), (nonblank & ratio_hit).alias("dp")])
    return stages


# Column expressions here refer to columns by name only, so one built list
# serves every DataFrame of a session; building it costs ~1 s of py4j calls.
@lru_cache(maxsize=16)
def _stages(session: str, na_tokens: tuple, date_patterns: tuple, keep: tuple) -> list[list]:
    return _classify_stages(na_tokens, date_patterns, keep)


def classify(cells: DataFrame, *, na_tokens=K.PANDAS_NA_TOKENS,
             date_patterns=K.DEFAULT_DATETIME_PATTERNS, keep: list[str] | None = None) -> DataFrame:
    """Per cell: ``v`` (NA tokens nulled), mask ``m``, non-blank ``nb``, date-pattern hit ``dp``.

    Built as a few narrow projections so the generated code stays small:
    the value is stripped, shaped and split once; calendar validity is
    computed once per part order (y-m-d, d-m-y, m-d-y, packed, h:m:s) and
    combined with the formats its digit shape allows.
    """
    sc_id = cells.sparkSession.sparkContext.applicationId
    c = cells
    for args in _stages(sc_id, tuple(na_tokens or ()), tuple(date_patterns or ()), tuple(keep or ())):
        c = c.select(*args)
    return c




def profile_cells(cells: DataFrame, *, na_tokens=K.PANDAS_NA_TOKENS,
                  date_patterns=K.DEFAULT_DATETIME_PATTERNS,
                  sample_rows: int | None = None, row_idx: str | None = None) -> DataFrame:
    """One row per (file_name, column_name) with the aggregates R01-R03 need.

    ``sample_rows`` (with an explicit ``row_idx`` column in ``cells``)
    restricts each file to its first N rows (W01); off by default.
    """
    if sample_rows is not None:
        cells = first_rows(cells, sample_rows, row_idx)
    c = classify(cells, na_tokens=na_tokens, date_patterns=date_patterns)
    return (c.groupBy("file_name", "column_name")
            .agg(F.count("v").alias("n_values"),
                 F.bit_and("m").alias("mask_all"),
                 F.bit_or("m").alias("mask_any"),
                 F.count(F.when(F.col("nb"), 1)).alias("n_nonblank"),
                 F.count(F.when(F.col("dp"), 1)).alias("n_datepat"),
                 F.count(F.lit(1)).alias("n_rows")))


def profile_cells_sampled(cells: DataFrame, *, row_idx: str = "row_idx", rows: int = 200,
                          ratio_sample: int = K.DATE_RATIO_SAMPLE, decimal_sample: int = K.DECIMAL_SAMPLE,
                          na_tokens=K.PANDAS_NA_TOKENS,
                          date_patterns=K.DEFAULT_DATETIME_PATTERNS) -> DataFrame:
    """Parity mode of the original analysis: first ``rows`` rows of each file
    (W01); the date ratio over the first ``ratio_sample`` non-blank values and
    the decimal flag over the first ``decimal_sample`` non-null values of each
    column (W02), all in ``row_idx`` order.  Same output as ``profile_cells``.

    Every window here works on at most ``rows`` cells per (file, column), so
    no group grows with the data.
    """
    from pyspark.sql import Window
    capped = first_rows(cells, rows, row_idx)
    c = classify(capped.select("file_name", "column_name", "value", row_idx),
                 na_tokens=na_tokens, date_patterns=date_patterns, keep=[row_idx])
    nn = F.col("v").isNotNull()
    w_nn = Window.partitionBy("file_name", "column_name", nn).orderBy(row_idx)
    w_nb = Window.partitionBy("file_name", "column_name", F.col("nb")).orderBy(row_idx)
    c = c.select("*", F.row_number().over(w_nn).alias("_rn_nn"), F.row_number().over(w_nb).alias("_rn_nb"))
    dec = nn & (F.col("_rn_nn") <= decimal_sample) & has_bit(F.col("m"), BIT_DEC)
    in_ratio = F.col("nb") & (F.col("_rn_nb") <= ratio_sample)
    agg = (c.groupBy("file_name", "column_name")
           .agg(F.count("v").alias("n_values"), F.bit_and("m").alias("mask_all"),
                F.bit_or("m").alias("_any"), F.max(F.when(dec, 1).otherwise(0)).alias("_dec"),
                F.count(F.when(in_ratio, 1)).alias("n_nonblank"),
                F.count(F.when(in_ratio & F.col("dp"), 1)).alias("n_datepat"),
                F.count(F.lit(1)).alias("n_rows")))
    any_ = (F.col("_any").bitwiseAND(F.lit(~BIT_DEC)) + F.when(F.col("_dec") == 1, BIT_DEC).otherwise(0))
    return agg.select("file_name", "column_name", "n_values", "mask_all", any_.cast("long").alias("mask_any"),
                      "n_nonblank", "n_datepat", "n_rows")


def first_rows(cells: DataFrame, n: int, row_idx: str | None) -> DataFrame:
    """Keep the first ``n`` rows of each file by an explicit row index.

    A ``dense_rank`` over the row index numbers the rows, whose cells are
    several here; Spark's group limit keeps at most ``n`` rows of a file per
    task before the only shuffle.
    """
    if not row_idx:
        raise ValueError("sampled mode needs an explicit row_idx column")
    from pyspark.sql import Window
    w = Window.partitionBy("file_name").orderBy(row_idx)
    return cells.withColumn("_rn", F.dense_rank().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def has_bit(mask: Column, bit: int) -> Column:
    return (mask.bitwiseAND(F.lit(bit)) != 0)


# --------------------------------------------------------------------------
# R01 initial type
# --------------------------------------------------------------------------

def initial_type_expr(p) -> tuple[Column, Column, Column]:
    """(type, rule, date_format) columns from a profile row."""
    all_ = F.col("mask_all")
    any_ = F.col("mask_any")
    empty = F.col("n_values") == 0
    code = X.is_code_name(F.col("column_name"))
    zpad = has_bit(all_, BIT_DIGITS) & has_bit(any_, BIT_ZPAD)
    fmt = None
    for f, bit in FORMAT_BITS.items():
        fmt = F.when(has_bit(all_, bit), F.lit(f)) if fmt is None else fmt.when(has_bit(all_, bit), F.lit(f))
    is_date = fmt.isNotNull()
    rule = (F.when(empty, "empty").when(code, "code_name").when(zpad, "zero_padded")
            .when(is_date, "date_format").when(has_bit(all_, BIT_INT), "integral")
            .when(has_bit(all_, BIT_NUM), "numeric").otherwise("fallback"))
    typ = (F.when(rule.isin("empty", "code_name", "zero_padded", "fallback"), K.TEXT)
           .when(rule == "date_format", K.DATETIME)
           .when(rule == "integral", K.INTEGER).otherwise(K.REAL))
    date_fmt = F.when(rule == "date_format", fmt)
    return typ, rule, date_fmt


def infer_initial(profile: DataFrame) -> DataFrame:
    """file_name, column_name, n_values, initial_type, initial_rule, date_format."""
    typ, rule, fmt = initial_type_expr(profile)
    return profile.select("file_name", "column_name", "n_values",
                          typ.alias("initial_type"), rule.alias("initial_rule"),
                          fmt.alias("date_format"))


# --------------------------------------------------------------------------
# J07 keyword match (the shipped rules)
# --------------------------------------------------------------------------

def keyword_list(keywords: DataFrame | None = None) -> list[tuple[str, str]]:
    """Ordered (category, keyword) pairs of the shipped rules, or of a table that a person edits."""
    if keywords is None:
        return ([("code", k) for k in K.DEFAULT_CODE_KEYWORDS]
                + [("amount", k) for k in K.DEFAULT_AMOUNT_KEYWORDS]
                + [("quantity", k) for k in K.DEFAULT_QUANTITY_KEYWORDS])
    prio = F.when(F.col("category") == "code", 0).when(F.col("category") == "amount", 1).otherwise(2)
    rows = keywords.select("category", "keyword", prio.alias("_p"), "seq").orderBy("_p", "seq").collect()
    return [(r["category"], r["keyword"]) for r in rows]


def keyword_match(name: Column, keywords: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(category, keyword) of the first keyword contained in lower(name)."""
    low = F.lower(name)
    if not keywords:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    # One flat CASE per output (first hit wins), not nested CASEs.
    cat = kw = None
    for c, k in keywords:
        hit = low.contains(k)
        cat = F.when(hit, F.lit(c)) if cat is None else cat.when(hit, F.lit(c))
        kw = F.when(hit, F.lit(k)) if kw is None else kw.when(hit, F.lit(k))
    return cat, kw


# --------------------------------------------------------------------------
# R02 corrected type
# --------------------------------------------------------------------------

def infer_corrected(profile: DataFrame, *, file_rules: DataFrame | None = None,
                    keywords: DataFrame | None = None,
                    threshold: float = K.DATE_RATIO_THRESHOLD) -> DataFrame:
    """R01 + R02/R03: initial and corrected type with the rule that decided.

    The shipped keywords are a CASE; a keyword table (seq, category, keyword), of
    any size, is joined by ``keyword_index``.
    """
    from typesift.sources.rules import default_file_rules
    spark = profile.sparkSession
    if file_rules is None:
        # The shipped rule list has a fixed, known size: broadcast without a check.
        fr = F.broadcast(default_file_rules(spark).select(F.col("file_name").alias("_rule_file")))
    else:
        fr = file_rules.select(F.col("file_name").alias("_rule_file")).distinct()
    kws = tuple(keyword_list()) if keywords is None else ()
    first, later = _corrected(spark.sparkContext.applicationId, kws, threshold)
    base = profile.select("*", *first)
    j = base.join(fr, base.file_name == fr._rule_file, "left")
    if keywords is not None:
        hit = KI.match(profile, "column_name", keywords).withColumnsRenamed({"column_name": "_name", "category": "_cat"})
        j, later = j.join(hit, F.col("column_name").eqNullSafe(F.col("_name")), "left").drop("_name"), later[1:]
    for args in later:
        j = j.select(*args)
    return j


@lru_cache(maxsize=16)
def _corrected(session: str, keywords: tuple, threshold: float) -> tuple[list, list]:
    return _corrected_exprs(keywords, threshold)


def _corrected_exprs(keywords: tuple, threshold: float) -> tuple[list, list]:
    """Name-based select lists of ``infer_corrected`` (built once per session).

    Keyword match, deciding rule and corrected type are separate stages, each
    referring to the previous result by name, so no CASE is copied into
    another."""
    typ, rule, fmt = initial_type_expr(None)
    first = [typ.alias("initial_type"), rule.alias("initial_rule"), fmt.alias("date_format")]
    cat0, kw0 = keyword_match(F.col("column_name"), list(keywords))
    stage_kw = ["*", cat0.alias("_cat"), kw0.alias("keyword")]
    cat = F.col("_cat")
    has_dec = F.coalesce(has_bit(F.col("mask_any"), BIT_DEC), F.lit(False))
    ratio = F.when(F.col("n_nonblank") > 0, F.col("n_datepat") / F.col("n_nonblank"))
    date_hit = (ratio >= F.lit(threshold)) & (F.col("initial_type") != K.DATETIME)
    corr_rule = (F.when(F.col("_rule_file").isNotNull(), "file_rule")
                 .when(cat == "code", "code_keyword")
                 .when(cat.isin("amount", "quantity"), F.concat(cat, F.lit("_keyword")))
                 .when(F.coalesce(date_hit, F.lit(False)), "date_ratio")
                 .otherwise("initial"))
    stage_rule = ["*", corr_rule.alias("corrected_rule")]
    corr_rule = F.col("corrected_rule")
    corrected = (F.when(corr_rule.isin("file_rule", "code_keyword"), K.TEXT)
                 .when(corr_rule.isin("amount_keyword", "quantity_keyword"),
                       F.when(has_dec, K.REAL).otherwise(K.INTEGER))
                 .when(corr_rule == "date_ratio", K.DATETIME)
                 .otherwise(F.col("initial_type")))
    last = ["file_name", "column_name", "n_values", "initial_type", "initial_rule",
            "date_format", corrected.alias("corrected_type"), "corrected_rule", "keyword",
            "n_nonblank", "n_datepat", has_dec.alias("has_decimal")]
    return first, [stage_kw, stage_rule, last]


def infer_table(df: DataFrame, file_name: str, **kw) -> DataFrame:
    """Convenience: profile one wide string DataFrame and infer its types."""
    return infer_corrected(profile_cells(to_cells(df, file_name)), **kw)


# --------------------------------------------------------------------------
# Dtype labels
# --------------------------------------------------------------------------

def dtype_label(profile: DataFrame) -> DataFrame:
    """A pandas-style dtype label per column from the profile: ``empty``,
    ``boolean``, ``integer``, ``floating`` (also integers among nulls) or
    ``string`` (F14)."""
    all_ = F.col("mask_all")
    whole = has_bit(all_, BIT_INT) & ~has_bit(F.col("mask_any"), BIT_DEC)
    label = (F.when(F.col("n_values") == 0, "empty")
             .when(has_bit(all_, BIT_BOOL), "boolean")
             .when(whole & (F.col("n_rows") == F.col("n_values")), "integer")
             .when(has_bit(all_, BIT_NUM), "floating")
             .otherwise("string"))
    return profile.select("file_name", "column_name", label.alias("dtype"))


def dtype_label_counts(labels: DataFrame) -> DataFrame:
    """Label counts per file, most frequent first."""
    return (labels.groupBy("file_name", "dtype").agg(F.count(F.lit(1)).alias("columns"))
            .orderBy("file_name", F.desc("columns"), "dtype"))
