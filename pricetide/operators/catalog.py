"""The catalog: normalising, matching, upserting and reading products, offers, history and sources."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pricetide.functions.text import SPACE, strip, text_or_empty
from pricetide.functions.titles import best_partners
from pricetide.operators.title_index import TitleIndex, first_products
from pricetide.sources.work import materialize

#: Words taken out of titles, length of a key, confidences, and ratios that accept and that ask for review.
PROMO = r"(?i)\b(?:sale|deal|free shipping|limited time|clearance|new lower price)\b"
KEY_CHARS = 500
CONFIDENCE = {"gtin_exact": 0.99, "mpn_brand": 0.95, "normalized_key": 0.93}
SURE_RATIO, LIKELY_RATIO = 0.92, 0.80
MANAGED = "managed_retailer_search"
HISTORY_ROWS, SEARCH_ROWS = 200, 50
#: Titles of a block, about, and the ratio of lengths that one band of lengths spans (see ``match_fuzzy``).
TITLE_BLOCK, LENGTH_STEP = 1024, 1.1


def title_case(c: Column) -> Column:
    """Every run of letters capitalised."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_products(raw: DataFrame) -> DataFrame:
    """title (or product_name), brand, mpn, sku, model_number, gtin -> canonical_title, brand, model_number, normalized_key, mpn, gtin."""
    named = F.coalesce(*[_filled(F.col(c)) for c in ("title", "product_name") if c in raw.columns], F.lit(""))
    title = strip(F.regexp_replace(F.regexp_replace(strip(named), f"{SPACE}+", " "), PROMO, ""))
    brand = title_case(F.regexp_replace(strip(F.col("brand")), f"{SPACE}+", " "))
    model = F.coalesce(*[_filled(F.col(c)) for c in ("mpn", "sku", "model_number") if c in raw.columns])
    out = raw.withColumns({"canonical_title": title, "brand": F.when(F.col("brand") != "", brand).otherwise(F.col("brand")), "model_number": model})
    parts = [F.lower(_filled(F.col(c))) for c in ("brand", "canonical_title", "model_number")]
    return out.withColumn("normalized_key", _filled(F.left(F.concat_ws("|", *parts), F.lit(KEY_CHARS))))


def _first_by(products: DataFrame, *keys: Column) -> DataFrame:
    """The smallest product_id of each key; null keys take no part."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = products.select("product_id", *named)
    for i in range(len(keys)):
        rows = rows.where(F.col(f"_k{i}").isNotNull() & (F.col(f"_k{i}") != ""))
    return rows.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("product_id").alias("_hit"))


def match_exact(incoming: DataFrame, products: DataFrame) -> DataFrame:
    """incoming with product_id, match_type, confidence: by gtin, then brand and mpn, then normalized_key; nulls if none."""
    mpn = F.coalesce(_filled(F.col("mpn")), _filled(F.col("model_number")))
    rules = [
        ("gtin_exact", (F.col("gtin"),), (F.col("gtin"),)),
        ("mpn_brand", (_filled(F.lower("brand")), mpn), (F.lower("brand"), F.col("mpn"))),
        ("normalized_key", (F.col("normalized_key"),), (F.col("normalized_key"),)),
    ]
    out = incoming
    for name, own, theirs in rules:
        found = _first_by(products, *theirs)
        keyed = out.withColumns({f"_o{i}": _filled(k) for i, k in enumerate(own)})
        cond = [keyed[f"_o{i}"] == found[f"_k{i}"] for i in range(len(own))]
        at = cond[0] & cond[1] if len(cond) > 1 else cond[0]
        out = keyed.join(found, at, "left").withColumnRenamed("_hit", f"_{name}").drop(*[f"_k{i}" for i in range(len(own))], *[f"_o{i}" for i in range(len(own))])
    names = [r[0] for r in rules]
    kind = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in names])
    sure = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(CONFIDENCE[n])) for n in names])
    return out.withColumns({"product_id": F.coalesce(*[F.col(f"_{n}") for n in names]), "match_type": kind, "confidence": sure}).drop(*[f"_{n}" for n in names])


def _slices(rows: DataFrame, size: int) -> DataFrame:
    """part, band and the number of slices of about ``size`` rows that they are cut in."""
    return rows.groupBy("part", "band").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("slices"))


def _title_blocks(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """part, band, slice and the members (title, id) of each slice."""
    dealt = rows.join(slices, ["part", "band"]).withColumn("slice", F.pmod(F.xxhash64("title"), F.col("slices")).cast("int"))
    return dealt.groupBy("part", "band", "slice").agg(F.collect_list(F.struct("title", "id")).alias("members"))


def match_fuzzy(incoming: DataFrame, products: DataFrame, block: int = TITLE_BLOCK) -> DataFrame:
    """in_id with the product of most similar title: product_id, confidence, needs_review.

    Products whose brand differs from a set brand take no part; ratios below LIKELY_RATIO match nothing; ties go to the
    smaller product_id. The join is complete: equal titles of a brand are compared once, titles go in blocks by brand and
    length, and every pair of blocks of similar length meets in some task, where the bounds of ``functions.titles`` leave few
    pairs to compare in full. A brand of any size is many blocks; what moves is blocks, not pairs.
    """
    shape = lambda d, key: d.where(F.col("canonical_title") != "").select(F.col(key).alias("id"), F.lower("canonical_title").alias("title"), text_or_empty(F.lower("brand")).alias("brand"))
    mine, theirs = materialize(shape(incoming, "in_id"), "titles"), shape(products, "product_id")
    band = F.floor(F.log(F.length("title")) / math.log(LENGTH_STEP)).cast("int").alias("band")
    #: a title with a brand meets that brand and products without one; a title without a brand meets all
    asked = mine.select("title", "brand").distinct()
    asked = asked.withColumn("part", F.explode(F.when(F.col("brand") == "", F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), "brand"), F.lit("="))))).select("title", F.col("brand").alias("id"), "part", band)
    offered = theirs.groupBy("title", F.concat(F.lit("="), "brand").alias("part")).agg(F.min("id").alias("id"))
    offered = offered.unionByName(theirs.groupBy("title").agg(F.min("id").alias("id")).withColumn("part", F.lit("*")))
    offered = materialize(offered.select("title", "id", "part", band), "offered")
    near = math.ceil(math.log((2 - LIKELY_RATIO) / LIKELY_RATIO) / math.log(LENGTH_STEP))
    slices = _slices(offered, block)
    met = _title_blocks(asked, _slices(asked, block)).select("part", F.col("slice").alias("own"), F.col("band").alias("of"), F.explode(F.sequence(F.col("band") - near, F.col("band") + near)).alias("band"), F.col("members").alias("mine"))
    met = met.join(slices, ["part", "band"]).select("part", "own", "of", "band", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "mine")
    met = met.join(_title_blocks(offered, slices), ["part", "band", "slice"])
    met = met.repartition(4 * incoming.sparkSession.sparkContext.defaultParallelism, "part", "own", "of", "band", "slice")  # comparing costs more than moving
    kind = theirs.schema["id"].dataType.simpleString()

    def tasks(batches):
        for b in batches:
            for one, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = best_partners([m["title"] for m in one], [m["title"] for m in other], [m["id"] for m in other], LIKELY_RATIO)
                rows = [{"title": one[i]["title"], "brand": one[i]["id"], "ratio": ratio, "product_id": key} for i, ratio, key in found]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("title", pa.string()), ("brand", pa.string()), ("ratio", pa.float64()), ("product_id", to_arrow_type(theirs_type))]))

    theirs_type = theirs.schema["id"].dataType
    pairs = met.select("mine", "members").mapInArrow(tasks, f"title string, brand string, ratio double, product_id {kind}")
    best = pairs.groupBy("title", "brand").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "product_id")).alias("b"))
    ratio = -F.col("b.less")
    rows = mine.withColumnRenamed("id", "in_id").join(best, ["title", "brand"])
    return rows.select("in_id", "b.product_id", F.lit("fuzzy_title").alias("match_type"), ratio.alias("confidence"), (ratio < SURE_RATIO).alias("needs_review"))


def new_products(unmatched: DataFrame) -> DataFrame:
    """One new product for each normalized_key: the row of smallest in_id; its id is a digest of the key."""
    first = Window.partitionBy("normalized_key").orderBy("in_id")
    once = unmatched.where("normalized_key is not null").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return once.withColumn("product_id", F.sha2(F.col("normalized_key"), 256)).withColumn("match_type", F.lit("new_product")).withColumn("confidence", F.lit(0.0))


def newest_offers(incoming: DataFrame) -> DataFrame:
    """The newest row by observed_at, then seq, of each source_id and title; a missing title is Unknown."""
    newest = Window.partitionBy("source_id", "title").orderBy(F.desc("observed_at"), F.desc("seq"))
    fresh = incoming.withColumn("title", F.coalesce(_filled(F.col("title")), F.lit("Unknown")))
    return fresh.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def _met(offers: DataFrame, fresh: DataFrame, small: bool) -> DataFrame:
    """o and n: each offer with its fresh row, and fresh rows without an offer. A ``small`` batch is sent to the offers, which then stay where they are."""
    o, n = offers.select(F.struct(*[F.col(f"`{c}`") for c in offers.columns]).alias("o")), fresh.select(F.struct(*[F.col(f"`{c}`") for c in fresh.columns]).alias("n"))
    same = (F.col("o.source_id") == F.col("n.source_id")) & (F.col("o.title") == F.col("n.title"))
    if not small:
        return o.join(n, same, "full_outer")
    known = offers.select("source_id", "title").join(F.broadcast(fresh.select("source_id", "title")), ["source_id", "title"], "left_semi")
    added = fresh.join(known, ["source_id", "title"], "left_anti").select(F.struct(*[F.col(f"`{c}`") for c in fresh.columns]).alias("n"))
    return o.join(F.broadcast(n), same, "left").unionByName(added, allowMissingColumns=True)


def upsert_offers(offers: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """offers, with all their columns, after ``incoming`` (newest by observed_at, then seq, of each source_id and title).

    A new offer takes the row's values for the columns it has, a rating of 0 as none, USD where no currency is said, and a
    digest of source and title as offer_id; its url is the page's (page_url) where the row has none. A known one keeps all but its price and url, which change where given, and
    last_seen_at.
    """
    return merge_offers(offers, newest_offers(incoming), as_of)


def merge_offers(offers: DataFrame, fresh: DataFrame, as_of: str, small: bool = False) -> DataFrame:
    """``upsert_offers`` for rows that are one to each source_id and title; ``small`` ones may be broadcast."""
    both = _met(offers, fresh, small)
    known, seen = F.col("o.source_id").isNotNull(), F.col("n.source_id").isNotNull()
    made = {f.name: F.col(f"n.{f.name}") if f.name in fresh.columns else F.lit(None) for f in offers.schema}
    if "offer_id" in made:
        made["offer_id"] = F.sha2(F.concat_ws("|", F.col("n.source_id").cast("string"), "n.title"), 256)
    if "currency" in made:
        made["currency"] = F.coalesce(made["currency"], F.lit("USD"))
    if "rating" in made:
        made["rating"] = F.when(made["rating"] != 0, made["rating"])

    def value(field) -> Column:
        name, new = field.name, made[field.name].try_cast(field.dataType)
        old = F.col(f"o.{name}")
        if name in ("source_id", "title"):
            return F.coalesce(old, new)
        if name == "url" and "page_url" in fresh.columns:
            return F.coalesce(new, F.when(known, old).otherwise(F.col("n.page_url")))
        if name in ("price", "url"):
            return F.coalesce(new, old)
        if name == "last_seen_at":
            return F.when(seen, F.lit(as_of).cast(field.dataType)).otherwise(old)
        return F.when(known, old).otherwise(new)

    return both.select(*[value(f).alias(f.name) for f in offers.schema])


def append_price_history(observations: DataFrame) -> DataFrame:
    """One history row for each observation with a price; write it partitioned by captured_on."""
    return observations.where("price is not null").select("offer_id", "price", F.lit("USD").alias("currency"), "availability", "captured_at", F.to_date("captured_at").alias("captured_on"))


def product_price_history(offers: DataFrame, history: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    """The newest ``limit`` history rows of every product: product_id, offer_id, price, captured_at, rank."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("captured_at"), "offer_id", "seq")
    rows = history.join(offers.select("offer_id", "product_id"), "offer_id")
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def search_products(index: TitleIndex, searches: DataFrame, limit: int = SEARCH_ROWS) -> DataFrame:
    """query, product_id, rank: for each search (query) the first products by id whose title holds it in any case; % and _ are wildcards."""
    return first_products(index, searches, limit)


def product_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    return offers.join(products.select("product_id"), "product_id", "left_semi")


def pick_sources(sources: DataFrame) -> DataFrame:
    """The source of each retailer: an active one, else a managed one, which becomes active and allowed."""
    usable = sources.where((F.col("status") == "active") | (F.col("source_type") == MANAGED))
    order = Window.partitionBy("retailer_key").orderBy((F.col("status") != "active").cast("int"), "source_id")
    one = usable.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return one.withColumn("allowed", F.when(F.col("status") != "active", F.lit(True)).otherwise(F.col("allowed"))).withColumn("status", F.lit("active"))


def apply_source_patches(sources: DataFrame, patches: DataFrame, fields: tuple[str, ...] = ("name", "status", "allowed")) -> DataFrame:
    """Set what a patch sets (not null); a patch to active also allows; ordered by name."""
    p = patches.select(F.col("source_id").alias("_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = sources.join(p, sources["source_id"] == p["_id"], "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields})
    if {"status", "allowed"} <= set(fields):
        out = out.withColumn("allowed", F.when(F.col("_status") == "active", F.lit(True)).otherwise(F.col("allowed")))
    return out.drop("_id", *[f"_{f}" for f in fields]).orderBy("name", "source_id")


def seed_sources(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """``existing`` with managed, inactive sources of seeded retailers healed, and seed rows of unknown retailers added."""
    keys = seed.select("retailer_key").distinct().withColumn("_seeded", F.lit(True))
    heal = F.coalesce(F.col("_seeded"), F.lit(False)) & (F.col("source_type") == MANAGED) & (F.col("status") != "active")
    kept = existing.join(keys, "retailer_key", "left").withColumn("_h", heal)
    kept = kept.withColumns({"status": F.when(F.col("_h"), "active").otherwise(F.col("status")), "allowed": F.col("_h") | F.col("allowed")}).drop("_h", "_seeded")
    fresh = seed.join(existing.select("retailer_key"), "retailer_key", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def expand_search_urls(queries: DataFrame, retailers: DataFrame, sources: DataFrame) -> DataFrame:
    """query x retailer -> url from the source's template, or the error source_not_configured. Retailers are a fixed few."""
    rows = queries.crossJoin(retailers).join(sources.select("retailer_key", "search_url_template"), "retailer_key", "left")
    url = F.replace(F.col("search_url_template"), F.lit("{query}"), F.replace(F.url_encode("query"), F.lit("%7E"), F.lit("~")))
    missing = text_or_empty(F.col("search_url_template")) == ""
    return rows.select("query", "retailer_key", F.when(~missing, url).alias("url"), F.when(missing, F.lit("source_not_configured")).alias("error"))


def expand_ticker_urls(tickers: DataFrame, templates: DataFrame, first: int = 50) -> DataFrame:
    """Urls of the first tickers by position for each template; both lists are small by contract."""
    return tickers.orderBy("pos").limit(first).crossJoin(templates).select("ticker", F.replace(F.col("template"), F.lit("{ticker}"), F.col("ticker")).alias("url"))
