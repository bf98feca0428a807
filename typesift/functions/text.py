"""Scalar value tests as built-in Column expressions (no UDFs).

Every function here returns a ``pyspark.sql.Column`` built only from
``pyspark.sql.functions``, so it stays inside whole-stage codegen.

Date parsing does not call a formatter per value.  A value is first reduced
to its *shape* (every ASCII digit mapped to ``0``), which is one cheap pass
over the string; a shape set lookup (``InSet``) decides whether a format can
apply at all, and only then are the numeric parts split out and checked with
integer arithmetic (month range, days in month with leap years, year window).
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from typesift.functions import constants as K

# Characters removed by Python's str.strip() (ASCII part).
PY_WHITESPACE = " \t\n\r\x0b\x0c"
# Python float() grammar without inf/nan/underscores.
NUMERIC_REGEX = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DIGITS_REGEX = r"^\p{Nd}+$"

_DIRECTIVE = re.compile(r"(%[YmdHMS])")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """``str.strip()``: trim ASCII whitespace on both ends."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def shape(c) -> Column:
    """Map every ASCII digit to ``0`` ("2024-01-05" -> "0000-00-00")."""
    return F.translate(col_of(c), "123456789", "000000000")


def is_all_digits(c) -> Column:
    """``str.isdigit()`` on Unicode decimal digits.

    A short anchored regex decides ASCII digits; only values with non-ASCII
    characters go through the Unicode ``\\p{Nd}`` regex.
    """
    v = col_of(c)
    ascii_only = F.octet_length(v) == F.length(v)
    # Non-ASCII values: the first character decides before the whole value is scanned.
    return (F.when(v.rlike(r"\A[0-9]+\z"), True).when(ascii_only, False)
            .otherwise(v.substr(1, 1).rlike(DIGITS_REGEX) & v.rlike(DIGITS_REGEX)))


def is_zero_padded(c) -> Column:
    """Starts with ``0`` and is longer than one character."""
    v = col_of(c)
    return v.startswith("0") & (F.length(v) > 1)


def null_tokens(c, tokens=K.PANDAS_NA_TOKENS) -> Column:
    """Cells equal to an NA token become null (analyze path)."""
    v = col_of(c)
    if not tokens:
        return v
    return F.when(v.isin(list(tokens)), F.lit(None).cast("string")).otherwise(v)


# --------------------------------------------------------------------------
# Dates
# --------------------------------------------------------------------------

def format_fields(fmt: str) -> list[str]:
    return [d[1] for d in _DIRECTIVE.findall(fmt)]


def format_shapes(fmt: str) -> list[str]:
    """All digit shapes a strict format accepts.

    %Y is four digits; %m %d %H %M %S are one or two digits when separated by
    a literal, exactly two when packed against another directive (so %Y%m%d
    is exactly eight digits).
    """
    pieces = [p for p in _DIRECTIVE.split(fmt) if p]
    options = []
    for i, p in enumerate(pieces):
        if p == "%Y":
            options.append(["0000"])
        elif p.startswith("%"):
            packed = (i > 0 and pieces[i - 1].startswith("%")) or (
                i + 1 < len(pieces) and pieces[i + 1].startswith("%"))
            options.append(["00"] if packed else ["0", "00"])
        else:
            options.append([p])
    return sorted({"".join(x) for x in product(*options)})


def year_regex(lo: int, hi: int) -> str:
    """Matches the four-digit years from lo to hi."""
    spans: dict[tuple[str, int], list[str]] = {}
    y = lo
    while y <= hi:
        free = next(k for k in (3, 2, 1, 0) if y % 10 ** k == 0 and y + 10 ** k - 1 <= hi)
        digits = f"{y:04d}"[:4 - free]
        spans.setdefault((digits[:-1], free), []).append(digits[-1])
        y += 10 ** free
    return "(?:" + "|".join(f"{head}[{''.join(ends)}]" + (f"[0-9]{{{free}}}" if free else "")  # the widest spans first
                            for (head, free), ends in sorted(spans.items(), key=lambda x: -x[0][1])) + ")"


#: (years, months, days) of the calendar; leap years are one kind of year.
_LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_CALENDAR = (("", "(?:{0}[1-9]|1[0-2])", "(?:{0}[1-9]|1[0-9]|2[0-8])"), ("", "(?:{0}[13-9]|1[0-2])", "(?:29|30)"),
             ("", "(?:{0}[13578]|1[02])", "31"), (f"(?={_LEAP})", "{0}2", "29"))
_CLOCK = {"%H": "(?:[01]?[0-9]|2[0-3])", "%M": "[0-5]?[0-9]", "%S": "[0-5]?[0-9]"}


def valid_date_regex(formats, year_min: int, year_max: int) -> str:
    """Matches what parses under one of the strict formats (F06/F07): its shape, the calendar with leap years and the years."""
    own = []
    for fmt in formats:
        zero = "0" if _packed(fmt) else "0?"
        for leap, m, d in _CALENDAR if "%d" in fmt else _CALENDAR[:1]:
            part = {"%Y": leap + year_regex(year_min, year_max), "%m": m.replace("{0}", zero), "%d": d.replace("{0}", zero), **_CLOCK}
            own.append("".join(part.get(p) or re.escape(p) for p in _DIRECTIVE.split(fmt) if p))
    return r"\A(?:" + "|".join(own) + r")\z"


def _packed(fmt: str) -> bool:
    return not re.sub(r"%[YmdHMS]", "", fmt)


def _parts(v: Column, fmt: str) -> dict[str, Column]:
    """Integer parts of ``v`` under ``fmt`` (only meaningful when the shape matched)."""
    fields = format_fields(fmt)
    out = {}
    if _packed(fmt):
        pos = 1
        for f in fields:
            width = 4 if f == "Y" else 2
            out[f] = v.substr(pos, width).try_cast("int")
            pos += width
    else:
        seps = "".join(sorted(set(re.sub(r"%[YmdHMS]", "", fmt))))
        parts = F.split(F.translate(v, seps, "-" * len(seps)), "-")
        for i, f in enumerate(fields):
            out[f] = F.element_at(parts, i + 1).try_cast("int")
    return out


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return (F.when(m == 2, F.when(leap, 29).otherwise(28))
            .when(m.isin(4, 6, 9, 11), 30)
            .otherwise(31))


def parses_as(c, fmt: str, year_min: int, year_max: int, shp: Column | None = None) -> Column:
    """Strict parse test of ``c`` under a strptime-style ``fmt``."""
    v = col_of(c)
    shp = shape(v) if shp is None else shp
    p = _parts(v, fmt)
    checks = []
    if "Y" in p:
        checks.append(p["Y"].between(year_min, year_max))
    if "m" in p:
        checks.append(p["m"].between(1, 12))
    if "d" in p:
        y = p.get("Y", F.lit(1900))
        m = p.get("m", F.lit(1))
        checks.append(p["d"].between(1, days_in_month(y, m)))
    if "H" in p:
        checks.append(p["H"].between(0, 23))
    if "M" in p:
        checks.append(p["M"].between(0, 59))
    if "S" in p:
        checks.append(p["S"].between(0, 59))
    valid = reduce(lambda a, b: a & b, checks)
    # CASE keeps the split/cast work off every value whose shape cannot match.
    return F.when(shp.isin(format_shapes(fmt)), F.coalesce(valid, F.lit(False))).otherwise(F.lit(False))


def any_format_parses(c, formats, year_min, year_max) -> Column:
    v = col_of(c)
    shp = shape(v)
    return reduce(lambda a, b: a | b, [parses_as(v, f, year_min, year_max, shp) for f in formats])


def fold_patterns(patterns) -> str:
    """One alternation regex from an ordered pattern list (rules folded once)."""
    return "|".join(f"(?:{p})" for p in patterns)


# --------------------------------------------------------------------------
# Numbers
# --------------------------------------------------------------------------

def trailing_minus_to_leading(c) -> Column:
    """``"123.4-"`` -> ``"-123.4"`` when the rest is digits and dots."""
    v = col_of(c)
    t = pystrip(v)
    body = t.substr(F.lit(1), F.length(t) - 1)
    cond = t.endswith("-") & is_all_digits(F.regexp_replace(body, r"\.", ""))
    return F.when(cond, F.concat(F.lit("-"), body)).otherwise(v)


def is_numeric(c) -> Column:
    """the value is a plain decimal or scientific number."""
    return col_of(c).rlike(NUMERIC_REGEX)


def is_integral(x: Column) -> Column:
    """a finite double with no fractional part."""
    return (F.abs(x) < F.lit(float("inf"))) & (x % F.lit(1.0) == F.lit(0.0))


def has_decimal_mark(c) -> Column:
    """A03 per value: contains ``.`` or ``,``."""
    v = col_of(c)
    return v.contains(".") | v.contains(",")


# --------------------------------------------------------------------------
# Names
# --------------------------------------------------------------------------

def is_code_name(name) -> Column:
    """The upper-cased column name contains a code token."""
    u = F.upper(col_of(name))
    return reduce(lambda a, b: a | b, [u.contains(t) for t in K.CODE_NAME_TOKENS])


def sanitize_table_name(file_name) -> Column:
    """Table name from a file name.

    Drops the last extension the way ``os.path.splitext`` does (leading dots
    belong to the name), maps every character that is not a letter, number
    or ``_`` to ``_``, prefixes ``table_`` before a leading digit and names an
    empty result ``unnamed_table``.
    """
    f = col_of(file_name)
    lead = F.regexp_extract(f, r"^(\.*)", 1)
    rest = f.substr(F.length(lead) + 1, F.length(f))
    base = F.when(rest.contains("."), F.concat(lead, F.regexp_extract(rest, r"^(.*)\.[^.]*$", 1))).otherwise(f)
    clean = F.regexp_replace(base, r"[^\p{L}\p{N}_]", "_")
    return (F.when(clean == "", F.lit("unnamed_table"))
            .when(clean.rlike(r"^\p{Nd}"), F.concat(F.lit("table_"), clean))
            .otherwise(clean))


def base_name(path) -> Column:
    """last path component."""
    return F.regexp_extract(col_of(path), r"[^/\\]+$", 0)


def extension(path) -> Column:
    """lower-cased last extension including the dot, '' when none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))


# --------------------------------------------------------------------------
# ERP value normaliser
# --------------------------------------------------------------------------

def normalize_erp_value(c, patterns=K.DEFAULT_ERP_PATTERNS) -> Column:
    """First matching rule wins: trailing minus, zero padding (length > 3),
    decimal comma; otherwise the stripped value.  Null stays null."""
    pats = dict(patterns)
    t = pystrip(c)
    tm, zp, dc = pats["trailing_minus"], pats["zero_padding"], pats["decimal_comma"]
    return (F.when(col_of(c).isNull(), F.lit(None).cast("string"))
            .when(t.rlike(tm), F.concat(F.lit("-"), F.regexp_extract(t, tm, 1)))
            .when(t.rlike(zp) & (F.length(t) >= K.ZERO_PADDING_MIN_LENGTH), F.regexp_extract(t, zp, 1))
            .when(t.rlike(dc), F.concat(F.regexp_extract(t, dc, 1), F.lit("."), F.regexp_extract(t, dc, 2)))
            .otherwise(t))
