"""Pages in and results out: envelopes, snapshots, result lines and the two response shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.text import html_to_text, page_title, text_or_empty

#: Characters kept of a page, of a snapshot and of an excerpt.
HTML_LIMIT, SNAPSHOT_LIMIT, EXCERPT_LIMIT = 350_000, 500_000, 2000


def read_pages(spark: SparkSession, path: str, kind: str = "parquet", schema=None) -> DataFrame:
    """A stored table of fetched pages; give JSON and CSV a schema."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def to_envelope(pages: DataFrame, mode: str = "plain", whole: bool = False) -> DataFrame:
    """url, html -> the fetch envelope; a column of the envelope that ``pages`` has already stays as it is.

    html is cut to HTML_LIMIT unless ``whole``, which snapshots need: their hash is that of the whole content.
    """
    made = {
        "title": page_title(F.col("html")),
        "text": html_to_text(F.col("html"), mode),
        "status": F.lit("ok"),
        "http_status": F.lit(200),
    }
    out = pages.withColumns({k: v for k, v in made.items() if k not in pages.columns})
    out = out.withColumn("char_count", F.length("text"))
    return out if whole else out.withColumn("html", F.left("html", F.lit(HTML_LIMIT)))


def build_snapshots(envelopes: DataFrame, day: str | None = None) -> DataFrame:
    """One row per fetch: hash of the whole content (html, else text) and its first characters."""
    content = F.when(text_or_empty(F.col("html")) != "", F.col("html")).otherwise(text_or_empty(F.col("text")))
    out = envelopes.select("url", "http_status", F.sha2(content, 256).alias("content_hash"), F.left(content, F.lit(SNAPSHOT_LIMIT)).alias("content"), F.length(content).alias("content_chars"))
    return out.withColumn("fetch_date", F.lit(day).cast("date")) if day else out


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append by day of the fetch."""
    snapshots.write.mode("append").partitionBy("fetch_date").parquet(path)


def shop_results_ndjson(results: DataFrame, query_col: str = "query") -> DataFrame:
    """One JSON line for each retailer's result and one summary line for each query, in one text column with its order."""
    data = [c for c in results.columns]
    one = results.select(F.col(query_col).alias("query"), F.lit(0).alias("part"), F.col("retailer_key"), F.to_json(F.struct(F.lit("retailer").alias("type"), F.struct(*data).alias("data"))).alias("value"))
    summary = search_summary(results, query_col)
    last = summary.select(F.col(query_col).alias("query"), F.lit(1).alias("part"), F.lit(None).cast("string").alias("retailer_key"), F.to_json(F.struct(F.lit("summary").alias("type"), F.struct("attempted", "success", "blocked").alias("data"))).alias("value"))
    return one.unionByName(last)


def search_summary(results: DataFrame, query_col: str = "query") -> DataFrame:
    """Attempts, successes and blocks of each query."""
    status = F.col("status")
    return results.groupBy(query_col).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(status == "ok").alias("success"), F.count_if(status == "blocked").alias("blocked"))


def to_scrape_response(envelopes: DataFrame) -> DataFrame:
    """url, success, error, markdown, content, and metadata: title, sourceURL, statusCode."""
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    body = F.when(~failed, text_or_empty(F.col("text")))
    meta = F.struct(text_or_empty(F.col("title")).alias("title"), F.col("url").alias("sourceURL"), F.coalesce("http_status", F.lit(200)).alias("statusCode"))
    error = F.when(failed, F.coalesce("error", F.lit("Unknown error")) if "error" in envelopes.columns else F.lit("Unknown error"))
    return envelopes.select("url", (~failed).alias("success"), error.alias("error"), body.alias("markdown"), body.alias("content"), F.when(~failed, meta).alias("metadata"))


def to_crawl_payload(envelopes: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """url, status_code, title, excerpt, html (only of usable pages, cut), status."""
    html = F.when(text_or_empty(F.col("html")) != "", F.col("html")).otherwise(text_or_empty(F.col("text")))
    cut = F.left(html, F.lit(max_bytes or HTML_LIMIT))
    return envelopes.select("url", F.col("http_status").alias("status_code"), "title", F.left(text_or_empty(F.col("text")), F.lit(EXCERPT_LIMIT)).alias("excerpt"), F.when(F.col("status") == "ok", cut).alias("html"), "status")
