"""Chunks, contexts and fresh fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions.prices import html_price_candidates, merge_candidates, text_price_candidates
from pricetide.functions.text import chunks, fetch_key, fresh_seconds, sanitize_text, score_words

#: Chunks kept, characters of a context, candidates named in it.
TOP_CHUNKS, CONTEXT_LIMIT, NAMED = 4, 52_000, 8


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_no (from 0), chunk."""
    return docs.select(key, F.posexplode(chunks(F.col(text))).alias("chunk_no", "chunk"))


def score_chunks(rows: DataFrame, query) -> DataFrame:
    return rows.withColumn("score", score_words(F.col("chunk"), query))


def top_chunks(scored: DataFrame, key: str = "doc_id", k: int = TOP_CHUNKS) -> DataFrame:
    """The k best chunks of each document, ties to the earlier; order by chunk_no to read them."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), "chunk_no")
    return scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def build_llm_context(pages: DataFrame) -> DataFrame:
    """page_text, html, query, retailer_key -> further columns candidates and context.

    The chunks of a page stay in its row: scored, cut to the best and put back in order as arrays, without a shuffle.
    """
    clean = sanitize_text(F.col("page_text"))
    rows = pages.withColumn("_text", clean).withColumn("candidates", merge_candidates(html_price_candidates(F.col("html"), F.col("retailer_key")), text_price_candidates(F.col("_text"))))
    asked = F.concat("query", F.lit(" price USD current now buy product "), "retailer_key", F.lit(" dollars sale discount"))
    rows = rows.withColumn("_asked", asked).withColumn("_chunks", chunks(F.col("_text")))
    scored = F.transform("_chunks", lambda c, i: F.struct((-score_words(c, F.col("_asked"))).alias("s"), i.alias("i"), c.alias("c")))
    best = F.slice(F.array_sort(scored), 1, TOP_CHUNKS)
    kept = F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))), lambda x: x["c"])
    body = F.array_join(F.when(F.size("_chunks") <= TOP_CHUNKS, F.col("_chunks")).otherwise(kept), "\n\n---\n\n")
    named = F.array_join(F.transform(F.slice("candidates", 1, NAMED), lambda p: F.format_string("$%.2f", p)), ", ")
    head = F.concat(F.lit("Pre-detected USD price candidates on this page: "), named, F.lit("\nUse one of these for the main product if it matches '"), F.col("query"), F.lit("'.\n\n"))
    said = F.left(F.concat(F.when(F.size("candidates") > 0, head).otherwise(F.lit("")), body), F.lit(CONTEXT_LIMIT))
    return rows.withColumn("context", said).drop("_text", "_asked", "_chunks")


def row_digest(rows: DataFrame) -> Column:
    """Names a row by all its columns, of any type that JSON can show, for an order among rows that are otherwise equal."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])), 256)


def fetch_seq(fetches: DataFrame) -> Column:
    """The fetches' seq, where they have one: of fetches at one moment the larger seq is the newer."""
    return F.coalesce(F.col("seq").cast("long"), F.lit(-1)) if "seq" in fetches.columns else F.lit(-1).cast("long")


def fresh_fetches(fetches: DataFrame, as_of: str) -> DataFrame:
    """The newest fetch of each url (url, fetched_at, ...) that is still within its time to live at ``as_of``.

    Of fetches of one url at one moment the one of largest seq counts, if there is such a column, then the one whose digest is
    largest.
    """
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("fetched_at")
    live = fetches.withColumns({"_seq": fetch_seq(fetches), "_digest": row_digest(fetches), "fetch_key": fetch_key(F.col("url"))}).where((age >= 0) & (age < fresh_seconds(F.col("url"))))
    newest = Window.partitionBy("fetch_key").orderBy(F.desc("fetched_at"), F.desc("_seq"), F.desc("_digest"))
    return live.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "_seq", "_digest")
