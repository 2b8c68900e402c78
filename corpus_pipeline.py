"""Corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; all but the last return the columns of
``docs``. ``docs`` is a stored table, so a stage that only orders rows (mixing) takes effect through the order of the files,
which packing follows. Language ID drops texts that have no identifiable language, the dedup stages keep one document of each
group, mixing and packing keep every document.
"""

from __future__ import annotations

from pricetide.llm.common import materialize
from pricetide.llm.exact_dedup import drop_copies
from pricetide.llm.language_id import reject_unidentified
from pricetide.llm.mixing import mixed_order
from pricetide.llm.near_dedup import drop_near_copies
from pricetide.llm.packing import pack


def language_id(spark, docs, sf_dir):
    return reject_unidentified(docs)


def exact_dedup(spark, docs, sf_dir):
    return drop_copies(docs)


def near_dedup(spark, docs, sf_dir):
    return drop_near_copies(docs, width=5, percent=80)


def mixing(spark, docs, sf_dir):
    return mixed_order(docs)


def packing(spark, docs, sf_dir):
    return pack(docs, keep=["doc_id", "lang", "source"], stored_order=True)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
#: Naive Bayes and the schedule have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
