"""Expressions on JSON trees: the fields of an object, and how deep a text nests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields_of(v: Column) -> Column:
    """The fields of an object, a map of variants; null for all else."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _brackets(text: Column) -> Column:
    """The brackets of a JSON text in order, those within strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    return F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")


def nesting(text: Column, kinds: str = "{[") -> Column:
    """How many brackets of ``kinds`` a JSON text has open at most at once; 0 for null."""
    shut = "".join({"{": "}", "[": "]"}[k] for k in kinds)

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(F.lit(kinds).contains(c) & (c != ""), 1).when(F.lit(shut).contains(c) & (c != ""), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.coalesce(F.aggregate(_brackets(text), start, step, lambda a: a["most"]), F.lit(0))
