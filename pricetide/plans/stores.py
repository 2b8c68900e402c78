"""The catalog at rest: offers, sources and the newest price history of products, kept up to date by batches.

Each is a ``KeyedTable``: a batch rewrites only the buckets of its own sources, retailers or products, and the same batch
again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricetide.operators import catalog
from pricetide.sources.keyed import BUCKETS, KeyedTable
from pricetide.sources.work import materialize

#: Buckets that one source's offers are spread over; a batch of at most so many rows and bytes is broadcast to the stored rows.
SPREAD, BROADCAST_ROWS, BROADCAST_BYTES = 16, 100_000, 32 << 20
HISTORY = "product_id long, offer_id long, seq long, price double, availability string, captured_at timestamp"


def offer_store(spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS, spread_over: int = SPREAD) -> KeyedTable:
    """Offers (source_id, title, ...) by source; a source's offers are spread over some buckets by title."""
    return KeyedTable(spark, path, schema, ["source_id"], buckets, ["title"], spread_over)


def source_store(spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS) -> KeyedTable:
    """Sources (retailer_key, source_type, status, allowed, ...) by retailer."""
    return KeyedTable(spark, path, schema, ["retailer_key"], buckets)


def history_store(spark: SparkSession, path: str, schema: T.StructType | str = HISTORY, buckets: int = BUCKETS) -> KeyedTable:
    """The newest rows of each product's price history, by product."""
    return KeyedTable(spark, path, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema, ["product_id"], buckets)


def store_rows(table: KeyedTable, rows: DataFrame) -> int:
    """Add ``rows`` as they are, beside those that are stored: how a store is first filled."""
    return table.update(rows, lambda current, batch: current.unionByName(batch.select(*[F.col(f"`{c}`") for c in current.columns])))


def store_offers(table: KeyedTable, incoming: DataFrame, as_of: str) -> int:
    """Upsert ``incoming`` (see ``catalog.upsert_offers``) into an offer store; returns the newest version.

    A batch that is counted small goes to the stored rows of its buckets, which then are not shuffled; a larger one meets them
    in a shuffled join.
    """
    fresh = materialize(catalog.newest_offers(incoming), "fresh")
    n, size = fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return table.update(fresh, lambda current, batch: catalog.merge_offers(current, batch, as_of, small), in_place=small)


def seed_store(table: KeyedTable, seed: DataFrame) -> int:
    """Seed a source store (see ``catalog.seed_sources``): only buckets of seeded retailers are read."""
    return table.update(seed, catalog.seed_sources)


def keep_history(table: KeyedTable, rows: DataFrame, limit: int = catalog.HISTORY_ROWS) -> int:
    """Add new history ``rows`` (product_id, offer_id, seq, price, captured_at, ...) to a history store.

    Each product keeps its newest ``limit`` rows, which is all that later batches need to know of it: old history isn't read.
    A row is named by its offer_id, seq and captured_at; one that comes again is the same row.
    """
    newest = Window.partitionBy("product_id").orderBy(F.desc("captured_at"), "offer_id", "seq")
    first = lambda d: d.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit).drop("_r")

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        name = ["product_id", "offer_id", "seq", "captured_at"]
        fresh = batch.select(*[F.col(f"`{c}`") for c in current.columns]).dropDuplicates(name)
        return first(current.unionByName(first(fresh.join(current.select(*name), name, "left_anti"))))

    return table.update(rows, merge)


def stored_history(table: KeyedTable) -> DataFrame:
    """The store's rows with their rank within the product, newest first."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("captured_at"), "offer_id", "seq")
    return table.read().withColumn("rank", F.row_number().over(newest))
