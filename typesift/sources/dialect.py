"""The delimiter and quote of a file, by how alike they make its rows.

Under a dialect each line has a width, its number of fields.  A dialect is good if
few widths explain many lines and rows are wide: its score is the sum over widths of
(lines of that width) * (width - 1) / width, divided by the number of different
widths (after the pattern score of van den Burg, Nazábal and Sutton, 2019).  A width
of one counts a thousandth.  Scores are whole numbers, in millionths, so that every
engine agrees.

One grouped aggregate of (file, dialect, width) over all lines; a file's lines are
never together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|", " ")
QUOTES = ('"', "'", "")  # '': no quotes
SCALE = 1_000_000
DIALECTS = [(d, q) for d in DELIMITERS for q in QUOTES]


def widths(line: Column) -> Column:
    """The number of fields of a line under each dialect; what is between two quotes is no delimiter."""
    bare = {q: F.regexp_replace(line, f"{q}[^{q}]*{q}", "") if q else line for q in QUOTES}
    return F.array(*[F.length(bare[q]) - F.length(F.replace(bare[q], F.lit(d), F.lit(""))) + 1 for d, q in DIALECTS])


def scores(lines: DataFrame, file: str, line: str) -> DataFrame:
    """(file, dialect, score, widest, lines) of every file with a line that is not blank; dialect: place in DIALECTS."""
    some = lines.where(F.btrim(F.col(line), F.lit(" \t\r")) != "")
    per = some.select(file, F.posexplode(widths(F.col(line))).alias("dialect", "width")).groupBy(file, "dialect", "width").agg(F.count("*").alias("n"))
    part = F.when(F.col("width") == 1, F.col("n") * (SCALE // 1000)).otherwise(F.expr(f"n * {SCALE} * (width - 1) div width"))
    return (per.groupBy(file, "dialect").agg(F.sum(part).alias("sum"), F.count("*").alias("k"), F.max("width").alias("widest"), F.sum("n").alias("lines"))
            .select(file, "dialect", F.expr("sum div k").alias("score"), "widest", "lines"))


def detect(lines: DataFrame, file: str, line: str) -> DataFrame:
    """(file, delimiter, quote, score, lines): the dialect of the highest score, the earlier of equals; delimiter ``N/A`` if nothing splits a line."""
    best = scores(lines, file, line).groupBy(file).agg(F.max(F.struct("score", (-F.col("dialect")).alias("d"), "widest", "lines")).alias("b"))
    names = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(q).alias("quote")) for d, q in DIALECTS])
    one = F.element_at(names, 1 - F.col("b.d"))
    splits = F.col("b.widest") > 1
    return best.select(file, F.when(splits, one["delimiter"]).otherwise("N/A").alias("delimiter"), F.when(splits, one["quote"]).otherwise("").alias("quote"),
                       F.col("b.score").alias("score"), F.col("b.lines").alias("lines"))
