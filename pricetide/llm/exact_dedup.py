"""Exact de-duplication by distributed MSD radix partitioning.

Documents are split by successive byte strings of their UTF-8 text: first by a short digit, then each group that still has
more than one member by the next, wider digit. A group leaves as soon as it has one member or its texts have ended; equality
is equality of bytes and no digest decides it. Group counts are pre-aggregated before the shuffle, so a text that a third of
the rows share costs one counter per task, and the join that hands the count back is one that Spark can split by skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import ROW, materialize, nullable, row_id, scratch, without

#: Bytes of the first digit, and how much wider each next one is.
FIRST, WIDER = 64, 16


def _split(rows: DataFrame, width: int) -> DataFrame:
    """One radix pass: groups (grp, next ``width`` bytes), each row with its group's size and largest member."""
    rows = rows.withColumn("digit", F.substring("rest", 1, width))
    keys = [c for c in ("grp", "digit") if c in rows.columns]
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "uid")).alias("top")).where("n > 1")
    groups = materialize(groups, "groups")  # a table of its own, so that the join can split a hot group's rows
    found = rows.join(groups.hint("shuffle_hash"), keys, "left")
    ended = F.octet_length("rest") < F.lit(width)
    done = F.col("n").isNull() | ended
    return found.select(
        "doc_id", "uid", "sha", done.alias("done"),
        F.coalesce(F.col("top.uid"), F.col("uid")).alias("grp"),
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )


def exact_groups(docs: DataFrame, text: str = "text", with_uid: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. Of equal texts the largest doc_id stays; where rows repeat the
    doc_id as well, exactly one of them stays. A null doc_id sorts below all others. An empty table gives an empty result.
    Other columns are not read. ``docs`` is a stored table: it is read more than once, and rows are told apart by where they
    stand in it (``uid``), so that ids that repeat or are null do no harm.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select("doc_id", row_id(docs).alias("uid"), F.sha2(body, 256).alias("sha"), body.alias("rest"))
    path, width, level, parts = scratch(spark, "radix"), FIRST, 0, []
    while True:
        at = f"{path}-{level}"
        out = _split(rows, width)
        out.write.option("compression", "zstd").partitionBy("done").parquet(at)
        back = spark.read.schema(nullable(out.schema)).parquet(at)
        parts.append(back.where("done").select("doc_id", "uid", "sha", "grp", "keep_id", "group_size"))
        rows = back.where("not done").select("doc_id", "uid", "sha", "grp", "rest")
        if rows.isEmpty():
            break
        width, level = width * WIDER, level + 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select(
        *(["uid"] if with_uid else []), "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("grp")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; copies are few, so only where they stand is moved."""
    return without(docs, materialize(exact_groups(docs, with_uid=True).where("not kept").select(F.col("uid").alias(ROW)), "copies"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op5_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
}
