"""Quote pages, module JSON and replies merged into flat and smart quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import finance, replies


def flat_quotes(modules: DataFrame, pages: DataFrame, parsed_replies: DataFrame) -> DataFrame:
    """modules (ticker, modules), pages (page_id = ticker, html, symbol), replies (ticker, parsed) -> ticker, name, value."""
    api = finance.flatten_modules(modules).select("ticker", F.col("key").alias("name"), F.regexp_replace("value_json", '^"|"$', "").alias("value"), F.lit(2).alias("prio"))
    page = finance.page_quote_fields(pages).select(F.col("page_id").alias("ticker"), "name", "value", F.lit(1).alias("prio"))
    seen = replies.flatten_reply(parsed_replies, key="ticker").withColumn("prio", F.lit(3))
    return finance.merge_quote_sources(api.unionByName(page).unionByName(seen))


def smart_quotes(modules: DataFrame, pages: DataFrame, parsed_replies: DataFrame) -> DataFrame:
    return finance.smart_quote(flat_quotes(modules, pages, parsed_replies))
