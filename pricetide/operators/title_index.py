"""Substring search in titles by a stored index of letter groups (grams).

A gram is one to three characters in a row of a lower-cased title; the empty gram stands in every title. The index holds, for
each different title, a row for each of its grams. A search is an ILIKE pattern: between its wildcards stand runs of
characters that each found title must hold, so their grams of greatest length must be in it. The rarest few of them are looked
up, titles that have them all are tested by the pattern itself, once for all products of a title. Many searches go at once, as
joins on equal grams: no title is compared with a search that shares none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.sources.work import materialize

#: Characters of the longest gram, and how many of a search's grams are looked up.
GRAM, ASKED = 3, 3


class TitleIndex(NamedTuple):
    """postings: gram, title_key; counts: gram, n (summed over what was added); titles: title_key, product_id, canonical_title."""

    postings: DataFrame
    counts: DataFrame
    titles: DataFrame


def title_key(title: Column) -> Column:
    """Equal titles share a key; different ones may, since every hit is tested on its title."""
    return F.xxhash64(F.lower(title))


def _grams(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _rows(products: DataFrame) -> DataFrame:
    named = products.where(F.col("canonical_title").isNotNull())
    return named.select(title_key(F.col("canonical_title")).alias("title_key"), "product_id", "canonical_title")


def _postings(titles: DataFrame) -> DataFrame:
    once = titles.groupBy("title_key").agg(F.min(F.lower("canonical_title")).alias("t"))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("t"), n) for n in range(1, GRAM + 1)]))
    return once.select("title_key", F.explode(grams).alias("gram"))


def _write(titles: DataFrame, fresh: DataFrame, path: str) -> None:
    """Postings of ``fresh`` titles by gram, so that a search reads few row groups of few files; the titles come last: a product counts as
    known once all of its postings are stored."""
    rows = _postings(fresh).select("gram", "title_key")
    rows.repartitionByRange("gram", "title_key").sortWithinPartitions("gram", "title_key").write.mode("append").parquet(f"{path}/postings")
    rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{path}/counts")
    titles.write.mode("append").parquet(f"{path}/titles")


def build_title_index(products: DataFrame, path: str) -> TitleIndex:
    """Store an index of ``products`` (product_id, canonical_title) at the new folder ``path``. Products without a title are left out."""
    _write(_rows(products), _rows(products), path)
    return open_title_index(products.sparkSession, path)


def open_title_index(spark: SparkSession, path: str) -> TitleIndex:
    counts = spark.read.parquet(f"{path}/counts").groupBy("gram").agg(F.sum("n").alias("n"))
    return TitleIndex(spark.read.parquet(f"{path}/postings"), counts, spark.read.parquet(f"{path}/titles"))


def extend_title_index(products: DataFrame, path: str) -> TitleIndex:
    """Add the products that the index at ``path`` does not know by id; the same batch twice adds nothing. One writer at a time."""
    spark = products.sparkSession
    known = open_title_index(spark, path).titles
    rows = materialize(_rows(products).join(known.select("product_id"), "product_id", "left_anti").select("title_key", "product_id", "canonical_title"), "titles")
    _write(rows, rows.join(known.select("title_key"), "title_key", "left_anti"), path)
    return open_title_index(spark, path)


def _asked(searches: DataFrame, counts: DataFrame) -> DataFrame:
    """query, pattern, gram and asked (their number) of the rarest grams that each search can't do without."""
    pattern = F.concat(F.lit("%"), F.lower("query"), F.lit("%"))
    runs = F.filter(F.split("pattern", r"[%_\\]+"), lambda r: r != "")
    size = F.when(F.size("runs") > 0, F.least(F.lit(GRAM), F.array_max(F.transform(F.col("runs"), lambda r: F.length(r)))))
    of_runs = lambda n: F.flatten(F.transform("runs", lambda r: _grams(r, n)))  # noqa: E731  a second argument of transform's function would be the place in the array
    cut = F.lit(None).cast("array<string>")
    for n in range(1, GRAM + 1):
        cut = F.when(F.col("size") == n, of_runs(n)).otherwise(cut)
    once = searches.select("query").where("query is not null").distinct().withColumn("pattern", pattern)
    needed = once.withColumn("runs", runs).withColumn("size", size).select("query", "pattern", F.explode(F.array_distinct(F.coalesce(cut, F.array(F.lit(""))))).alias("gram"))
    rarest = Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram")
    chosen = needed.join(counts, "gram", "left").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= ASKED)
    return chosen.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("query"))).select("query", "pattern", "gram", "asked")


def _named(index: TitleIndex) -> DataFrame:
    """title_key, t, product_id: what makes two titles one, in lower case."""
    return index.titles.select("title_key", F.lower("canonical_title").alias("t"), "product_id")


def _found(index: TitleIndex, searches: DataFrame) -> DataFrame:
    """query, title_key, t: the different titles that each search finds. Both sides are in lower case, so LIKE is ILIKE."""
    asked = _asked(searches, index.counts)
    met = asked.join(index.postings, "gram").groupBy("query", "pattern", "title_key", "asked").agg(F.count(F.lit(1)).alias("found"))
    met = met.where("found >= asked").select("query", "pattern", "title_key")  # more where a writer that died stored postings twice
    return met.join(_named(index).select("title_key", "t").distinct(), "title_key").where(F.expr("t LIKE pattern")).select("query", "title_key", "t")


def search_titles(index: TitleIndex, searches: DataFrame) -> DataFrame:
    """query, product_id of every product whose title holds ``query`` of ``searches``, in any case; % and _ are wildcards.

    Each different search is answered once; a null one finds nothing, an empty one everything.
    """
    return _found(index, searches).join(_named(index), ["title_key", "t"]).select("query", "product_id")


def first_products(index: TitleIndex, searches: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` products of smallest id of what ``search_titles`` finds for each search, with their rank.

    They are among the first ``limit`` of each title found, so products meet searches by those alone.
    """
    own = Window.partitionBy("title_key", "t").orderBy("product_id")
    first = _named(index).withColumn("r", F.row_number().over(own)).where(F.col("r") <= limit).drop("r")
    order = Window.partitionBy("query").orderBy("product_id")
    hits = _found(index, searches).join(first, ["title_key", "t"]).select("query", "product_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
