"""What the operators of this subpackage share: work tables, hashing expressions and cheap whole-table orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.sources.work import clean_work as clean_scratch
from pricetide.sources.work import materialize, nullable
from pricetide.sources.work import new_path as scratch

__all__ = ["BROADCAST_IDS", "ROW", "clean_scratch", "fold", "id_text", "keep_rows", "materialize", "nullable", "numbered", "row_id", "running_sum", "scratch", "share", "without"]

#: Ids (8 bytes each) that may be broadcast; beyond it the same join is shuffled.
BROADCAST_IDS = 1_000_000

#: Name of the row number that joins decisions back to rows; no table is expected to have it.
ROW = "__pricetide_row"


def row_id(docs: DataFrame) -> Column:
    """Where a row stands in the stored table ``docs``: the same number each time the table is read in this session.

    How a table is split for reading otherwise depends on the cores that are there at the time, so an executor lost between
    two reads would shift the numbers: the least number of splits is pinned once for the session.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    return F.monotonically_increasing_id()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW."""
    return docs.withColumn(ROW, row_id(docs))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ROW is not in ``gone`` (one column, ROW), with the columns of ``docs``."""
    return keep_rows(numbered(docs), gone, "left_anti", gone.count(), ROW).select(*[F.col(f"`{c}`") for c in docs.columns])


def id_text(col: str = "doc_id") -> Column:
    return F.col(col).cast("string")


def fold(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_text(col), F.lit("")).cast("binary")) % F.lit(mod)


def share(cap: int, total: int, *cols: str, scale: int = 1 << 20) -> Column:
    """Keeps about ``cap`` of ``total`` rows, the same ones each time: a hash threshold, no sort and no limit."""
    if total <= cap:
        return F.lit(True)
    return F.pmod(F.xxhash64(*cols, F.lit(7)), F.lit(scale)) < F.lit(int(scale * cap / total))


def keep_rows(docs: DataFrame, ids: DataFrame, how: str, n_ids: int, key: str = "doc_id") -> DataFrame:
    """Semi or anti join on the id; broadcast only when the counted ids fit the bound, else a shuffled join."""
    return docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, how)


def running_sum(df: DataFrame, group: list[str], slice_col: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per group, rows ordered by (slice, order), without a window over a whole group.

    A first window stays inside (group, slice), the totals of the slices are summed by a second, tiny one, and joined back.
    """
    spans = df.groupBy(*group, slice_col).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
    keys = [*group, slice_col]
    renamed = spans.select(*[F.col(k).alias(f"_run{i}") for i, k in enumerate(keys)], "_base")
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = [df[k].eqNullSafe(renamed[f"_run{i}"]) for i, k in enumerate(keys)]
    cond = at[0]
    for c in at[1:]:
        cond = cond & c
    joined = df.join(renamed, cond, "left").drop(*[f"_run{i}" for i in range(len(keys))])
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_base")
