"""Every registered query that has SQL gives the rows that DuckDB gives; all others give rows; plans hold at any partitioning."""

from __future__ import annotations

import glob
import itertools
import os
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from pricetide.operators import ranking
from pricetide.queries import AS_OF, HOURS, ORACLES, QUERIES, SCORE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[str]:
    def said(v) -> str:
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return f"{float(v):.6g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted("|".join(map(said, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = db.execute(ORACLES[name]).fetchdf()
        assert sorted(found.columns) == sorted(want.columns)
        assert canonical(found) == canonical(want)
    else:
        assert len(found)


@pytest.mark.parametrize("name", ["top_offers", "top_listings", "upserted_offers", "fuzzy_matches", "admitted_requests", "merged_replies"])
def test_partitioning_does_not_matter(spark, name):
    one = canonical(QUERIES[name](spark, SF).toPandas())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert canonical(QUERIES[name](spark, SF).toPandas()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_scores_and_ranks_are_those_of_the_sql_to_the_last_bit(spark):
    """Offers of many equal scores: those that differ in their last bit only would be ranked by it."""
    now = datetime.fromisoformat(AS_OF)
    kinds = itertools.product(["in_stock", "preorder", "unknown", "out_of_stock", None], [1, 100, 500, 9000], [None, 2.5, 4.0], [None, 5, 25, 50], [None, 10.0, 15.0, 20.0], [None, 0.0])
    rows = [(1, i, p, a, r, n, now - timedelta(hours=h), s) for i, (a, h, r, n, p, s) in enumerate(kinds)]
    schema = "product_id long, offer_id long, price double, availability string, rating double, review_count int, last_seen_at timestamp, shipping_price double"
    found = ranking.rank_all(ranking.score_offers(spark.createDataFrame(rows, schema), ["product_id"], AS_OF), ["product_id"])
    con = duckdb.connect()
    con.execute(f"CREATE TABLE offers ({schema.replace('long', 'bigint').replace('string', 'varchar')})")
    con.executemany("INSERT INTO offers VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    want = con.execute(f"""SELECT offer_id, s, row_number() OVER (ORDER BY s DESC, offer_id) FROM (SELECT offer_id, {SCORE} AS s FROM (
        SELECT *, min(price) OVER () AS lo, max(price) OVER () AS hi, {HOURS} AS hours FROM offers) AS a) AS b""").fetchall()
    assert sorted(map(tuple, found.select("offer_id", "shopping_score", "rank").collect())) == sorted(want)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
