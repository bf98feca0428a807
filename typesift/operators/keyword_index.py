"""Which keyword does a name contain (J07), for keyword tables of any size.

A keyword can only be in a name that has all its grams (parts of three characters;
shorter keywords are a gram themselves).  Each keyword is filed under one of its
grams, the one that the fewest keywords have; each distinct name is looked up under
its own grams, and what meets is compared.  So the join is an equi-join on grams:
no pair of a name and a keyword that share no gram is made, and no keyword passes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: The order in which categories are tried.
CATEGORIES = ("code", "amount")


def grams(text: Column, n: Column | int) -> Column:
    """The distinct parts of ``n`` characters; none of a shorter text."""
    n = n if isinstance(n, Column) else F.lit(n)
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    return F.array_distinct(F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.substring(text, i, n)))


def filed(keywords: DataFrame) -> DataFrame:
    """``keywords`` (keyword, ...) with the gram that each is filed under; the empty keyword, which all names contain, under ''."""
    size = F.least(F.length("keyword"), F.lit(GRAM))
    own = keywords.select("keyword").distinct().withColumn("gram", F.explode(F.when(size > 0, grams(F.col("keyword"), size)).otherwise(F.array(F.lit("")))))
    often = own.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, "gram").groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return keywords.join(rarest, "keyword")


def match(names: DataFrame, name: str, keywords: DataFrame) -> DataFrame:
    """(name, category, keyword) of each distinct name: the first keyword of (category, keyword, seq) contained in its lower case.

    Codes come before amounts and those before all others, each by seq, equal ones
    by the keyword.  Names without a keyword have nulls.
    """
    prio = F.lit(len(CATEGORIES))
    for i, c in enumerate(CATEGORIES):
        prio = F.when(F.col("category") == c, i).otherwise(prio)
    index = filed(keywords.where("keyword is not null").select("keyword", F.struct(prio.alias("p"), "seq", "keyword", "category").alias("entry")))
    own = names.select(F.col(name).alias("name")).distinct()
    low = F.lower("name")
    looked = own.where("name is not null").withColumn("gram", F.explode(F.concat(F.array(F.lit("")), *[grams(low, n) for n in range(1, GRAM + 1)])))
    met = looked.join(index, "gram").where(low.contains(F.col("keyword")))
    first = met.groupBy("name").agg(F.min("entry").alias("e"))
    return own.join(first, "name", "left").select(F.col("name").alias(name), F.col("e.category").alias("category"), F.col("e.keyword").alias("keyword"))
