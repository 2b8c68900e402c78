"""Scoring and ranking offers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions.numbers import rounded
from pricetide.operators.title_index import TitleIndex, build_title_index, search_titles
from pricetide.sources.work import materialize, new_path

#: Weights of a score, and what each state of availability and age in hours is worth.
WEIGHTS = {"price": 0.30, "availability": 0.20, "merchant": 0.20, "reviews": 0.15, "freshness": 0.10, "shipping": 0.05}
AVAILABILITY = {"in_stock": 1.0, "preorder": 0.6, "unknown": 0.4, "out_of_stock": 0.0}
FRESHNESS = ((24, 1.0), (168, 0.7), (720, 0.4))
STALE, NO_PRICE, ACTIVE_MERCHANT, NO_RATING = 0.1, 0.7, 0.7, 0.5


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _share(part: str, worth: float) -> Column:
    """Weight times a fixed worth as the decimals that they are (0.2 x 0.7 is 0.14), or equal scores would differ in their last bit and rank by it."""
    return F.lit(float(Decimal(str(WEIGHTS[part])) * Decimal(str(worth))))


def offer_score(lo: Column, hi: Column, as_of: Column, status: Column | None = None) -> Column:
    """0 to 1 from price within lo..hi, availability, merchant, reviews, age at ``as_of`` and shipping."""
    price = F.col("price")
    cheap = F.when(price.isNull() | lo.isNull(), F.lit(NO_PRICE)).when(hi > lo, 1.0 - (price - lo) / (hi - lo)).otherwise(F.lit(1.0))
    stock = F
    for name, worth in AVAILABILITY.items():
        stock = stock.when(F.lower("availability") == name, _share("availability", worth))
    stock = stock.otherwise(_share("availability", AVAILABILITY["unknown"]))
    active = _share("merchant", ACTIVE_MERCHANT)
    merchant = active if status is None else F.when(status == "active", active).otherwise(F.lit(0.0))
    trust = F.least(F.lit(1.0), F.coalesce(F.col("review_count"), F.lit(0)) / 50.0)
    reviews = F.when(F.col("rating").isNull(), F.lit(NO_RATING)).otherwise(_unit(F.col("rating") / 5.0 * trust))
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last_seen_at")) / 3600.0
    fresh = F
    for limit, worth in FRESHNESS:
        fresh = fresh.when(hours <= limit, _share("freshness", worth))
    fresh = fresh.otherwise(_share("freshness", STALE))
    shipping = F.when(F.col("shipping_price") == 0, _share("shipping", 1.0)).otherwise(_share("shipping", 0.5))
    total = F.lit(0.0)
    for part in (F.lit(WEIGHTS["price"]) * _unit(cheap), stock, merchant, F.lit(WEIGHTS["reviews"]) * reviews, fresh, shipping):
        total = total + part
    return _unit(total)


def score_offers(offers: DataFrame, group_cols: list[str], as_of: str, status: str | None = None, small_groups: bool = False) -> DataFrame:
    """offers with shopping_score against the price range of their group; no group columns: of the whole table.

    The range is a two-phase aggregate joined back, so a huge group is never held or sorted in one task. ``small_groups`` (one
    product's offers) takes it from a window instead: one shuffle, which ranking within the same groups uses again.
    """
    as_of_col = F.lit(as_of).cast("timestamp")
    if small_groups and group_cols:
        own = Window.partitionBy(*group_cols)
        rows = offers.withColumns({"_lo": F.min("price").over(own), "_hi": F.max("price").over(own)})
    else:
        ranges = offers.groupBy(*group_cols).agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
        if group_cols:
            keys = ranges.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], "_lo", "_hi")
            cond = F.lit(True)
            for i, c in enumerate(group_cols):
                cond = cond & offers[c].eqNullSafe(keys[f"_g{i}"])
            rows = offers.join(keys, cond, "left").drop(*[f"_g{i}" for i in range(len(group_cols))])
        else:
            rows = offers.crossJoin(F.broadcast(ranges))  # one row
    score = offer_score(F.col("_lo"), F.col("_hi"), as_of_col, F.col(status) if status else None)
    return rows.withColumn("shopping_score", score).drop("_lo", "_hi")


def rank_offers(scored: DataFrame, group_cols: list[str], k: int | None = None) -> DataFrame:
    """Rank by score within a group, ties to the smaller offer_id; the first ``k`` if given."""
    order = Window.partitionBy(*group_cols).orderBy(F.desc("shopping_score"), "offer_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k) if k else ranked


def rank_all(scored: DataFrame, group_cols: list[str]) -> DataFrame:
    """``rank_offers`` for groups of any size: rows are dealt by ranges of (group, score), numbered within each range, and each
    range counts on from the ranges of its group before it, so no group is sorted in one task."""
    order = [F.desc("shopping_score"), F.col("offer_id")]
    dealt = materialize(scored.repartitionByRange(*group_cols, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group_cols, "_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a group and range
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col("_part").alias("_p"), "_base")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    rows = dealt.join(keys, same)
    inside = F.row_number().over(Window.partitionBy(*group_cols, "_part").orderBy(*order))
    return rows.withColumn("rank", F.col("_base") + inside).drop("_part", "_p", "_base", *[f"_g{i}" for i in range(len(group_cols))])


def ranked_search(offers: DataFrame, products: DataFrame, queries: DataFrame, as_of: str, price_max: float | None = None, k: int | None = None, index: TitleIndex | None = None) -> DataFrame:
    """query x offers whose product title holds it: scored within the query's surviving rows and ranked, the first ``k`` if given.

    A rating of 0 counts as none and shipping is not known. Any number of queries is answered at once, by ``index`` or one that
    is built for the call. The hits are a work table, found once for the price ranges and the scores.
    """
    index = index or build_title_index(products, new_path(products.sparkSession, "titles"))
    if price_max is not None:
        offers = offers.where(F.col("price").isNull() | (F.col("price") <= price_max))
    rows = offers.join(search_titles(index, queries), "product_id")
    rows = rows.withColumns({"rating": F.nullif("rating", F.lit(0.0)), "shipping_price": F.lit(None).cast("double")})
    scored = score_offers(materialize(rows, "hits"), ["query"], as_of)
    return rank_offers(scored, ["query"], k) if k else rank_all(scored, ["query"])


def recompute_scores(offers: DataFrame, as_of: str) -> DataFrame:
    """Scores of all offers against the one global price range, four decimals; zeros of price, rating and shipping are missing."""
    zero = {c: F.nullif(c, F.lit(0.0)) for c in ("rating", "shipping_price")}
    range_ = offers.agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    rows = offers.crossJoin(F.broadcast(range_)).withColumns(zero).withColumn("price", F.nullif("price", F.lit(0.0)))
    score = offer_score(F.col("_lo"), F.col("_hi"), F.lit(as_of).cast("timestamp"))
    return rows.select("offer_id", rounded(score, 4).alias("shopping_score"))
