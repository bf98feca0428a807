"""Line dedup by a log-template tree, in DataFrame functions only.

Each line is parsed down a tree of fixed depth: first by its number of tokens,
then by its ``DEPTH`` leading tokens, where a token with a digit is a variable
field.  The leaf is the line's template; what follows the leading tokens is
variable too.  A template that occurs in ``MIN_DOCS`` documents or more is
recurring: its lines stay in the first document (the smallest doc_id) and are
dropped from all others.  Lines of fewer than ``MIN_TOKENS`` tokens stay.

That is op5's rule, as its SQL has it (``drops``).  It takes lines of numbers,
and lines that only open alike, for one template, so ``deduplicate`` checks
(``checked_drops``) and drops a line only if an earlier document has

* the same line, token by token, or
* the same line but for its variable fields, where at least half of the tokens
  are constant and ``VARIABLE_DOCS`` documents or more have the template, or
* the leaf's first line, and two thirds of the constant words of either are in
  both; at least half of the tokens are constant, and the variable fields are
  equal or ``VARIABLE_DOCS`` documents or more have the leaf.

Only (template hash, doc_id) pairs are counted, deduplicated before the
shuffle, so a template in a third of all documents is one row a task.

Definite results: rows with a null doc_id or null text are not counted and
stay as they are; empty lines stay; equal templates within one document are
one occurrence; repeated rows (same doc_id and text) get the same result; an
empty table gives no rows; ``deduplicate`` keeps all columns of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typesift.llm.session import materialize

DEPTH = 8
MIN_TOKENS = 5
MIN_DOCS = 2
#: Documents that make a template with variable fields recurring.
VARIABLE_DOCS = 3

_TOKEN = r"[^\x20\x09-\x0D]+"


def template(line: Column, depth: int = DEPTH) -> Column:
    """Hash of a line's leaf: its token count and its masked leading tokens."""
    tokens = _tokens(line)
    return F.struct(F.size(tokens).alias("n"), _leaf(tokens, depth).alias("key"))


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))


def _variable(token: Column) -> Column:
    return token.rlike("[0-9]")


def _leaf(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), F.array_join(_masked(F.slice(tokens, 1, depth)), " "))


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(_variable(t), F.lit("<*>")).otherwise(t))


def drops(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, h, at): for each (doc_id, hash of the text), the numbers of the lines to drop, from 0."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t")).where("id is not null and t is not null")
    lines = texts.select("id", F.xxhash64("t").alias("h"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "h", "pos", template(F.col("line"), depth).alias("leaf"))
    lines = materialize(lines.where(F.col("leaf.n") >= min_tokens).select("id", "h", "pos", "leaf.key"), "line-templates")
    recurring = (lines.select("key", "id").distinct().groupBy("key")
                 .agg(F.min("id").alias("first"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs))
    # a line is dropped where its template has been in an earlier document
    found = lines.join(recurring.select("key", "first"), "key").where("id > first")
    return found.groupBy("id", "h").agg(F.collect_set("pos").alias("at"))


#: Rules of checked_drops, in the key of a line.
_SAME, _FIELDS, _LEAF = 0, 1, 2


def checked_drops(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """As ``drops``, for lines that equal or nearly equal an earlier document's."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t")).where("id is not null and t is not null")
    texts = texts.withColumn("h", F.xxhash64("t"))
    lines = texts.select("id", "h", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "h", "pos", _tokens(F.col("line")).alias("w")).where(F.size("w") >= min_tokens)
    lines = lines.withColumn("constant", F.size(F.filter("w", lambda t: ~_variable(t))))
    half, varies = F.col("constant") * 2 >= F.size("w"), F.col("constant") < F.size("w")
    key = lambda rule, k: F.struct(F.lit(rule).alias("rule"), k.alias("key"))
    keys = F.array(key(_SAME, F.xxhash64(F.array_join("w", " "))),
                   F.when(half & varies, key(_FIELDS, F.xxhash64(F.array_join(_masked(F.col("w")), " ")))),
                   F.when(half, key(_LEAF, _leaf(F.col("w"), depth))))
    keyed = materialize(lines.select("id", "h", "pos", F.explode(F.array_compact(keys)).alias("k")).select("id", "h", "pos", "k.*"), "line-keys")

    recurring = (keyed.groupBy("rule", "key", "id").agg(F.min(F.struct("h", "pos")).alias("at"))
                 .groupBy("rule", "key").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("docs"))
                 .where(F.col("docs") >= F.when(F.col("rule") == _FIELDS, max(min_docs, VARIABLE_DOCS)).otherwise(min_docs)))
    found = materialize(keyed.join(recurring, ["rule", "key"]).where(F.col("id") > F.col("first.id"))
                        .select("rule", "id", "h", "pos", "first", "docs"), "line-repeats")
    sure = found.where(F.col("rule") != _LEAF).select("id", "h", "pos").distinct()

    # the others of a leaf are held to its first line; only these lines are read again
    others = materialize(found.where(F.col("rule") == _LEAF).join(sure, ["id", "h", "pos"], "left_anti").distinct()
                         .select("id", "h", "pos", F.col("first.id").alias("id1"), F.col("first.at.h").alias("h1"),
                                 F.col("first.at.pos").alias("pos1"), "docs"), "line-others")
    wanted = others.select("id", "h", "pos").unionByName(others.selectExpr("id1 as id", "h1 as h", "pos1 as pos"))
    wanted = wanted.groupBy("id", "h").agg(F.collect_set("pos").alias("at"))
    read = texts.join(wanted, ["id", "h"]).withColumn("lines", F.split("t", "\n", -1)).select(
        "id", "h", F.explode(F.transform("at", lambda i: F.struct(i.alias("pos"), F.element_at("lines", i + 1).alias("line")))).alias("l"))
    read = read.select("id", "h", "l.*").groupBy("id", "h", "pos").agg(F.first("line").alias("line"))  # repeated rows
    both = others.join(read, ["id", "h", "pos"]).join(read.selectExpr("id as id1", "h as h1", "pos as pos1", "line as line1"), ["id1", "h1", "pos1"])
    a, b = _tokens(F.col("line")), _tokens(F.col("line1"))
    fixed = lambda w: F.filter(w, lambda t: ~_variable(t))
    near = F.size(F.array_intersect(fixed(a), fixed(b))) * 3 >= F.size(F.array_union(fixed(a), fixed(b))) * 2
    fields = (F.filter(a, _variable) == F.filter(b, _variable)) | (F.col("docs") >= VARIABLE_DOCS)
    return sure.unionByName(both.where(near & fields).select("id", "h", "pos")).groupBy("id", "h").agg(F.collect_set("pos").alias("at"))


def _joined(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The documents with columns renamed c0, c1, ... and the outcome for each; found: see ``drops``."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no clash with the joined columns
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    rows = plain.join(found, (doc_id == F.col("id")) & (F.xxhash64(text.cast("string")) == F.col("h")), "left")
    lines = F.split(text.cast("string"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("at"))
    rest = F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")
    new = F.when(F.col("at").isNull(), text.cast("string")).otherwise(rest)
    return rows, {"doc_id": doc_id, "text": new, "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
                  "n_dropped": F.coalesce(F.size("at"), F.lit(0)).cast("long")}


def deduplicate(docs: DataFrame, **rules) -> DataFrame:
    """The documents without recurring lines, and without those that have no word left.

    All columns stay; text, and n_chars where there is one, are brought up to date.
    """
    rows, new = _joined(docs, checked_drops(docs, **rules))
    rows = rows.withColumn("new_text", new["text"])
    rows = rows.where((new["n_dropped"] == 0) | F.col("new_text").rlike(_TOKEN))
    fresh = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    types = dict(docs.dtypes)
    return rows.select(*(
        F.when(F.col("at").isNull(), F.col(f"c{i}")).otherwise(fresh[c].cast(types[c])).alias(c) if c in fresh else F.col(f"c{i}").alias(c)
        for i, c in enumerate(docs.columns)))


def op5(docs: DataFrame) -> DataFrame:
    rows, new = _joined(docs, drops(docs))
    return rows.select(new["doc_id"].alias("doc_id"), new["n_lines"].alias("n_lines"), new["n_dropped"].alias("n_dropped"),
                       F.length(new["text"]).cast("long").alias("n_chars"), F.sha2(new["text"], 256).alias("text_sha256"))
