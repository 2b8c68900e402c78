"""Stored offers, sources and history: small batches, repeated batches, writers that race or die."""

from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricetide.operators import catalog
from pricetide.plans import stores
from pricetide.sources import keyed, versions
from pricetide.sources.keyed import KeyedTable

OFFERS = "offer_id string, source_id long, title string, price double, availability string, rating double, review_count int, url string, last_seen_at timestamp, currency string"
SEEN = "source_id long, title string, price double, availability string, rating double, review_count int, url string, page_url string, observed_at timestamp, seq long"


def rows_of(table):
    return sorted(map(str, table.collect()))


def files(path):
    return {p for p in Path(path, "data").rglob("*.parquet")}


def offers(spark, sources=100, titles=20):
    made = [(f"o{s}-{t}", s, f"Title {t}", float(10 + t), "in_stock", None, 1, "old", datetime(2024, 1, 1), "EUR") for s in range(sources) for t in range(titles)]
    return spark.createDataFrame(made, OFFERS)


def batch(spark, source, day=2):
    found = [(source, f"Title {t}", 99.0 + t, "gone", 4.0, 2, None if t % 2 else "new", "page", datetime(2024, 2, day), t) for t in range(0, 20, 3)]
    return spark.createDataFrame([*found, (source, "Fresh", 5.0, "new", 0.0, None, None, "page", datetime(2024, 2, day), 50), (source, None, 6.0, "new", None, None, None, None, datetime(2024, 2, day), 51), (source, "Fresh", 4.0, "x", None, None, None, None, datetime(2024, 1, day), 52)], SEEN)


@pytest.mark.parametrize("most", [0, 100_000])
def test_one_source_of_a_hundred_rewrites_a_hundredth(spark, tmp_path, monkeypatch, most):
    """By a shuffled join and by a broadcast; the same batch again changes nothing."""
    monkeypatch.setattr(stores, "BROADCAST_ROWS", most)
    path, known, seen = str(tmp_path / "s"), offers(spark), batch(spark, 7)
    store = stores.offer_store(spark, path, known.schema, 128, 2)
    assert stores.store_rows(store, known) == 1 and rows_of(store.read()) == rows_of(known)
    before = files(path)
    assert stores.store_offers(store, seen, "2024-03-01") == 2
    assert rows_of(store.read()) == rows_of(catalog.upsert_offers(known, seen, "2024-03-01"))
    added = files(path) - before
    assert 0 < len(added) <= 0.05 * len(before)
    assert rows_of(store.read(1)) == rows_of(known)
    after = files(path)
    assert stores.store_offers(store, seen, "2024-03-01") == 2 and files(path) == after
    assert store.vacuum() == 0 and store.vacuum(0) > 0
    assert rows_of(store.read()) == rows_of(catalog.upsert_offers(known, seen, "2024-03-01")) and len(files(path)) <= len(before) + 2


def test_stored_rows_of_a_small_batch_are_not_shuffled(spark, tmp_path):
    known = offers(spark, 4)
    known.write.parquet(str(tmp_path / "o"))
    fresh = catalog.newest_offers(batch(spark, 2))
    plan = catalog.merge_offers(spark.read.parquet(str(tmp_path / "o")), fresh, "2024-03-01", True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FullOuter" not in plan


def test_a_dead_writer_and_a_slow_one(spark, tmp_path, monkeypatch):
    known = offers(spark, 5)
    store = stores.offer_store(spark, str(tmp_path / "s"), known.schema, 8, 1)
    stores.store_rows(store, known)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions.Versions, "claim", die)
        with pytest.raises(KeyboardInterrupt):
            stores.store_offers(store, batch(spark, 1), "2024-03-01")
    assert rows_of(store.read()) == rows_of(known)
    broken = tmp_path / "s/versions/v000000002"
    broken.write_text("")
    monkeypatch.setattr(keyed, "ATTEMPTS", 2)
    with pytest.raises(versions.CommitConflict):
        stores.store_offers(store, batch(spark, 1), "2024-03-01")
    os.utime(broken, (0, 0))
    assert stores.store_offers(store, batch(spark, 1), "2024-03-01") == 3
    assert rows_of(store.read()) == rows_of(catalog.upsert_offers(known, batch(spark, 1), "2024-03-01"))


def test_writers_that_race_lose_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], 4)
    add = lambda k: stores.store_rows(table, spark.createDataFrame([(k, i) for i in range(5)], schema))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(6)))
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [(k, i) for k in range(6) for i in range(5)] and table.version() == 6


def test_tables_guard_their_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], 4)
    assert table.read().count() == 0 and table.version() == 0
    some = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], schema)
    assert stores.store_rows(table, some) == 1 and rows_of(table.read()) == rows_of(some)
    assert stores.store_rows(table, some.where("false")) == 1
    with pytest.raises(ValueError, match="does not touch"):
        table.update(some.where("k = 1"), lambda current, b: spark.createDataFrame([(i, "x") for i in range(40)], schema))
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(spark, table.path, schema, ["k"], 8).read()
    table.update(some, lambda current, b: current.where("false"))  # rows may go as well
    assert table.read().count() == 0 and table.version() == 2


def test_sources_are_seeded_in_place(spark, tmp_path):
    known = spark.createDataFrame([(i, f"r{i}", "paused" if i % 2 else "active", catalog.MANAGED if i % 3 else "api", False) for i in range(30)], "source_id long, retailer_key string, status string, source_type string, allowed boolean")
    seed = spark.createDataFrame([(-1, k, "active", catalog.MANAGED, True) for k in ("r1", "r3", "r5", "new")], known.schema)
    table = stores.source_store(spark, str(tmp_path / "s"), known.schema, 64)
    stores.store_rows(table, known)
    before = files(table.path)
    assert stores.seed_store(table, seed) == 2
    assert rows_of(table.read()) == rows_of(catalog.seed_sources(known, seed).select(*known.columns))
    assert len(files(table.path) - before) <= 4
    assert stores.seed_store(table, seed) == 2


def test_history_is_kept_by_new_rows_alone(spark, tmp_path):
    """Ten batches out of order, some rows twice: what is kept equals the newest rows of everything; a batch reads its products only."""
    rng = random.Random(6)
    rows = [(rng.randrange(12) ** 2 % 12, 1, i, float(i % 50), "x", datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(500))) for i in range(1200)]
    table = stores.history_store(spark, str(tmp_path / "h"), buckets=8)
    make = lambda part: spark.createDataFrame(part, stores.HISTORY)
    for k in range(10):
        stores.keep_history(table, make([r for i, r in enumerate(rows) if i % 10 == k or i % 10 == 0]), 40)
    kept = {}
    for r in stores.stored_history(table).collect():
        kept.setdefault(r["product_id"], []).append((r["rank"], r["seq"]))
    want = {}
    for p in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[5].timestamp(), r[1], r[2]))[:40]
        want[p] = [(i + 1, r[2]) for i, r in enumerate(own)]
    assert {p: sorted(x) for p, x in kept.items()} == want
    version, some = table.version(), make(rows[:50])
    assert stores.keep_history(table, some, 40) == version
    before = files(table.path)
    stores.keep_history(table, make([(3, 1, 9999, 1.0, "x", datetime(2025, 1, 1))]), 40)
    assert len(files(table.path) - before) == 1 and table.version() == version + 1
    assert table.read().where("seq = 9999").select(F.col("product_id")).first()[0] == 3
