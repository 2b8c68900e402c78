"""Quote pages and news: symbols, module trees, scoped fields, prices, merges, smart quotes and headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions.numbers import double_text, rounded
from pricetide.functions.text import SPACE, let, strip, text_or_empty
from pricetide.functions.trees import fields_of, nesting
from pricetide.sources.work import materialize

#: Fields of an embedded quote.
QUOTE_FIELDS = (
    "regularMarketPrice", "regularMarketChange", "regularMarketChangePercent", "regularMarketVolume", "regularMarketDayHigh",
    "regularMarketDayLow", "regularMarketOpen", "regularMarketPreviousClose", "fiftyTwoWeekHigh", "fiftyTwoWeekLow",
    "trailingPE", "forwardPE", "marketCap", "shortName", "longName",
)
PRICE_PATTERNS = (
    r'"regularMarketPrice"\s*:\s*\{\s*"raw"\s*:\s*([0-9]+(?:\.[0-9]+)?)',
    r'"regularMarketPrice"\s*:\s*([0-9]+(?:\.[0-9]+)?)',
    r'"currentPrice"\s*:\s*\{\s*"raw"\s*:\s*([0-9]+(?:\.[0-9]+)?)',
)
PRICE_KEYS = ("price.regularMarketPrice", "asp.regularMarketPrice", "dom.regularMarketPrice", "vision.regularMarketPrice", "regularMarketPrice", "html.regularMarketPrice")
STALE_KEYS = ("asp.regularMarketPrice", "html.regularMarketPrice", "dom.regularMarketPrice")
#: A smart quote's fields and the keys they are taken from, first to last.
SMART = {
    "regularMarketPrice": ("price.regularMarketPrice", "vision.regularMarketPrice", "vision.quote_header.regularMarketPrice", "asp.regularMarketPrice", "html.regularMarketPrice"),
    "regularMarketChangePercent": ("price.regularMarketChangePercent", "vision.quote_header.regularMarketChangePercent", "asp.regularMarketChangePercent", "html.regularMarketChangePercent"),
    "regularMarketVolume": ("price.regularMarketVolume", "vision.quote_header.regularMarketVolume", "asp.regularMarketVolume", "html.regularMarketVolume"),
    "fiftyTwoWeekHigh": ("summaryDetail.fiftyTwoWeekHigh", "vision.quote_header.fiftyTwoWeekHigh", "asp.fiftyTwoWeekHigh"),
    "fiftyTwoWeekLow": ("summaryDetail.fiftyTwoWeekLow", "vision.quote_header.fiftyTwoWeekLow", "asp.fiftyTwoWeekLow"),
    "trailingPE": ("summaryDetail.trailingPE", "defaultKeyStatistics.trailingPE", "asp.trailingPE"),
    "marketCap": ("summaryDetail.marketCap", "asp.marketCap"),
    "shortName": ("price.shortName", "asp.shortName", "html.shortName"),
}
PUBLISHER, NEWS_LIMIT, SUMMARY = "Yahoo Finance", 15, 500
#: Fields of a wrapped value.
WRAPPED = ("raw", "fmt", "longFmt")
#: Lists within each other that a row opens in place; rows with more go through ``_deep_lists``.
LISTS_IN_PLACE = 2


def quote_ticker(url: Column) -> Column:
    """The symbol of a quote page's url, upper-case; null for other urls."""
    found = F.regexp_extract(text_or_empty(url), r"(?i)finance\.yahoo\.com/quote/([A-Za-z0-9.\-^=]+)", 1)
    return F.upper(F.nullif(found, F.lit("")))


def _is_wrapped(m: Column) -> Column:
    named = F.map_keys(m)
    return (F.size(F.array_except(named, F.array(*[F.lit(w) for w in WRAPPED]))) == 0) & (F.array_contains(named, "raw") | F.array_contains(named, "fmt"))


def _entries(fields: Column) -> Column:
    """The fields that are objects, as (path, v)."""
    return F.transform(F.filter(F.map_entries(fields), lambda x: fields_of(x["value"]).isNotNull()), lambda x: F.struct(x["key"].alias("path"), x["value"].alias("v")))


def _opened(entries: Column, depth: Column) -> Column:
    """(path, v) entries of a row -> those of their leaves: objects opened ``depth`` levels down, value wrappers replaced by their value."""
    entry = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    none = F.array().cast("array<struct<path: string, v: variant>>")

    def open_one(e: Column) -> Column:
        def of_map(m: Column) -> Column:
            inner = F.filter(F.map_entries(m), lambda x: ~F.coalesce(F.is_variant_null(x["value"]), F.lit(True)))
            fields = F.transform(inner, lambda x: entry(F.concat(e["path"], F.when(e["path"] == "", "").otherwise("."), x["key"]), x["value"]))
            value = F.when(F.map_contains_key(m, "raw"), F.element_at(m, "raw")).otherwise(F.element_at(m, "fmt"))
            return F.when(m.isNull(), F.array(e)).when(_is_wrapped(m), F.array(entry(e["path"], value))).otherwise(fields)

        return let(fields_of(e["v"]), of_map)

    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), depth))
    return F.aggregate(levels, F.coalesce(entries, none), lambda acc, _: F.when(F.exists(acc, lambda e: fields_of(e["v"]).isNotNull()), F.flatten(F.transform(acc, open_one))).otherwise(acc))


def _items(v: Column) -> Column:
    """The items of a list of objects; null for all else."""
    listed = F.try_variant_get(v, "$", "array<variant>")
    return let(listed, lambda a: F.when((F.size(a) > 0) & F.forall(a, lambda x: fields_of(x).isNotNull()), a))


def _named(path: Column, json: Column) -> Column:
    return let(F.to_json(F.array(path)), lambda j: F.concat(F.substring(j, F.lit(2), F.length(j) - 2), F.lit(":"), json))


def _leaf(v: Column, depth: Column, lists: int) -> Column:
    """JSON of a value. In a list of objects, an object with objects in it becomes their dot paths; its plain fields go."""
    if not lists:
        return F.to_json(v)

    def item(x: Column) -> Column:
        def of_objects(entries: Column) -> Column:
            said = F.transform(_opened(entries, depth), lambda e: _named(e["path"], _leaf(e["v"], depth, lists - 1)))
            return F.when(F.size(entries) == 0, F.to_json(x)).otherwise(F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}")))

        return let(_entries(fields_of(x)), of_objects)

    return let(_items(v), lambda a: F.when(a.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(a, item), ","), F.lit("]"))).otherwise(F.to_json(v)))


def flatten_modules(modules: DataFrame) -> DataFrame:
    """ticker, modules (JSON) -> ticker, key, value_json for every dot path below the modules that are objects, at any depth.

    Nulls and empty objects are dropped, value wrappers give their value, lists stay one value. Rows are opened in place; those
    with more than LISTS_IN_PLACE lists within each other, if there are any, list by list.
    """
    rows = modules.select("ticker", "modules", nesting(F.col("modules"), "{").alias("_depth"), nesting(F.col("modules"), "[").alias("_lists"))
    rows = rows.withColumn("_entries", _entries(fields_of(F.try_parse_json("modules"))))
    plain = rows.where(F.col("_lists") <= LISTS_IN_PLACE)
    leaves = F.transform(_opened(F.col("_entries"), F.col("_depth")), lambda e: F.struct(e["path"].alias("path"), _leaf(e["v"], F.col("_depth"), LISTS_IN_PLACE).alias("json")))
    found = plain.select("ticker", F.explode(leaves).alias("e")).select("ticker", F.col("e.path").alias("key"), F.col("e.json").alias("value_json"))
    deep = rows.where(F.col("_lists") > LISTS_IN_PLACE)
    return found if deep.isEmpty() else found.unionByName(_deep_lists(deep))


def _deep_lists(rows: DataFrame) -> DataFrame:
    """ticker, key, value_json of rows with lists in lists: each round opens one level of lists as rows of their own, then they are put together again."""
    docs = materialize(rows.select("ticker", "_depth", "_entries"), "modules").withColumn("_d", F.monotonically_increasing_id().cast("string"))
    docs = materialize(docs, "docs")
    owners, rounds = docs.select("_d", "ticker"), []
    while True:
        leaves = docs.select("_d", "_depth", F.posexplode(_opened(F.col("_entries"), F.col("_depth"))).alias("pos", "e")).select("_d", "_depth", "pos", F.col("e.path").alias("path"), F.col("e.v").alias("v"))
        leaves = materialize(leaves, "leaves")
        listed = leaves.where(_items(F.col("v")).isNotNull()).select("_d", "_depth", "pos", F.posexplode(_items(F.col("v"))).alias("i", "x"))
        listed = listed.withColumns({"_entries": _entries(fields_of(F.col("x"))), "child": F.concat_ws("/", "_d", "pos", "i")})
        listed = materialize(listed.withColumn("opens", F.size("_entries") > 0), "items")
        rounds.append((leaves, listed))
        docs = listed.where("opens").select(F.col("child").alias("_d"), "_depth", "_entries")
        if docs.isEmpty():
            break
    told = None  # _d and the JSON of the items that became documents of the round below
    for leaves, listed in reversed(rounds):
        whole = listed.select("_d", "pos", "i", "child", "opens", F.to_json("x").alias("own"))
        if told is not None:
            whole = whole.join(told.withColumnRenamed("_d", "child"), "child", "left")
        else:
            whole = whole.withColumn("json", F.lit(None).cast("string"))
        whole = whole.withColumn("json", F.when(F.col("opens"), F.coalesce("json", F.lit("{}"))).otherwise(F.col("own")))
        lists = whole.groupBy("_d", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "json"))).alias("l"))
        lists = lists.select("_d", "pos", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["json"]), ","), F.lit("]")).alias("list"))
        flat = leaves.join(lists, ["_d", "pos"], "left").select("_d", "pos", "path", F.coalesce("list", F.to_json("v")).alias("json"))
        fields = F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", "json"))), lambda x: _named(x["path"], x["json"]))
        told = materialize(flat, "flat") if leaves is rounds[0][0] else materialize(flat.groupBy("_d").agg(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("json")), "told")
    return told.join(owners, "_d").select("ticker", F.col("path").alias("key"), F.col("json").alias("value_json"))


def _quoted(symbol: Column) -> Column:
    """A symbol as a pattern that stands for itself."""
    return F.regexp_replace(F.upper(symbol), r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def _number(c: Column) -> Column:
    bare = strip(F.regexp_replace(c, ",", ""))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def _pairs(html: Column, *patterns: Column, field: int = 1, value: int = 2) -> Column:
    """Arrays of (field, value) that the patterns find, one after the other."""
    found = [F.zip_with(F.regexp_extract_all(html, p, F.lit(field)), F.regexp_extract_all(html, p, F.lit(value)), lambda a, b: F.struct(a.alias("name"), b.alias("value"))) for p in patterns]
    return F.flatten(F.array(*found))


def _streamer_patterns() -> tuple[Column, Column, Column]:
    s = _quoted(F.col("symbol"))
    return (
        F.concat(F.lit('(?i)<fin-streamer[^>]+data-symbol="'), s, F.lit('"[^>]+data-field="([^"]+)"[^>]+value="([^"]+)"')),
        F.concat(F.lit('(?i)data-field="([^"]+)"[^>]+data-symbol="'), s, F.lit('"[^>]+value="([^"]+)"')),
        F.concat(F.lit('(?i)<fin-streamer[^>]+data-field="([^"]+)"[^>]+value="([^"]+)"[^>]+data-symbol="'), s, F.lit('"')),
    )


def scoped_quote_fields(pages: DataFrame) -> DataFrame:
    """page_id, html, symbol -> page_id, name, value (text): fields that belong to the symbol.

    Later embedded blocks go before earlier ones, streamer tags before blocks; tags with turned attributes only fill gaps.
    """
    block = F.concat(F.lit('(?i)"symbol"\\s*:\\s*"'), _quoted(F.col("symbol")), F.lit('"[\\s\\S]{0,4000}'))
    rows = pages.where(text_or_empty(F.col("symbol")) != "").withColumn("_b", F.regexp_extract_all(text_or_empty(F.col("html")), block, F.lit(0)))

    def field(b: Column, name: str) -> Column:
        whole = F.regexp_extract(b, rf'"{name}"\s*:\s*(?:\{{\s*"raw"\s*:\s*([^,}}]+)|"([^"]+)"|(-?[0-9]+(?:\.[0-9]+)?))', 0)
        raw = lambda w: F.coalesce(*[F.nullif(F.regexp_extract(w, p, 1), F.lit("")) for p in (r'"raw"\s*:\s*([^,}]+)$', rf'^"{name}"\s*:\s*"([^"]+)"$', r":\s*(-?[0-9.]+)$")])
        return F.struct(F.lit(name).alias("name"), F.regexp_replace(strip(let(whole, raw)), r'^"+|"+$', "").alias("value"))

    blocks = F.flatten(F.transform("_b", lambda b, i: F.transform(F.array(*[field(b, n) for n in QUOTE_FIELDS]), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), i.alias("prio")))))
    direct, turned, _ = _streamer_patterns()
    html = text_or_empty(F.col("html"))
    tags = F.transform(_pairs(html, direct), lambda p, i: F.struct(p["name"].alias("name"), p["value"].alias("value"), (i + 1_000_000).alias("prio")))
    gaps = F.transform(_pairs(html, turned), lambda p, i: F.struct(p["name"].alias("name"), p["value"].alias("value"), (-1 - i).alias("prio")))
    found = rows.select("page_id", F.explode(F.concat(blocks, tags, gaps)).alias("f")).select("page_id", "f.*").where("value is not null")
    best = found.groupBy("page_id", "name").agg(F.max_by("value", "prio").alias("value"), F.max("prio").alias("prio"))
    plain = F.when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col("value").try_cast("double"))
    number = F.when(F.col("prio").between(0, 999_999), plain).otherwise(_number(F.col("value")))
    return best.select("page_id", "name", F.coalesce(double_text(number), "value").alias("value"))


def streamer_fields(pages: DataFrame) -> DataFrame:
    """page_id, html, symbol -> page_id, name, value (text): first value of each field over three orders of attributes."""
    clean = lambda v: F.regexp_replace(strip(v), r"[,$]", "")
    rows = pages.where(text_or_empty(F.col("symbol")) != "").select("page_id", F.posexplode(_pairs(text_or_empty(F.col("html")), *_streamer_patterns())).alias("pos", "p"))
    first = rows.groupBy("page_id", F.col("p.name").alias("name")).agg(F.min_by("p.value", "pos").alias("v"))
    number = clean(F.col("v"))
    return first.select("page_id", "name", F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), double_text(number.try_cast("double"))).otherwise(strip(F.col("v"))).alias("value"))


def page_price(html: Column) -> Column:
    """The first pattern that is found decides; not above 0: null."""
    found = [F.nullif(F.regexp_extract(text_or_empty(html), p, 1), F.lit("")) for p in PRICE_PATTERNS]
    price = F.coalesce(*found).try_cast("double")
    return F.when(price > 0, price)


def regular_price(pages: DataFrame) -> DataFrame:
    """page_id, price: the symbol's own price if above 0, else the page's."""
    own = scoped_quote_fields(pages).where("name = 'regularMarketPrice'").select(F.col("page_id").alias("_p"), F.col("value").try_cast("double").alias("_own"))
    rows = pages.select("page_id", page_price(F.col("html")).alias("_any")).join(own, F.col("page_id") == F.col("_p"), "left")
    return rows.select("page_id", F.when(F.col("_own") > 0, F.col("_own")).otherwise(F.col("_any")).alias("price"))


def page_quote_fields(pages: DataFrame) -> DataFrame:
    """page_id, html, symbol, candidates -> asp.* keys: streamer fields, then scoped ones, then the marked price; candidates."""
    qsp = F.regexp_extract(text_or_empty(F.col("html")), r'(?i)data-test="qsp-price"[^>]*>([^<]+)<', 1)
    price = F.regexp_replace(strip(qsp), r"[,$]", "").try_cast("double")
    marked = pages.select("page_id", F.lit("regularMarketPrice").alias("name"), F.when(price != 0, double_text(price)).alias("value")).where("value is not null")
    layers = [(streamer_fields(pages), 1), (scoped_quote_fields(pages), 2), (marked, 3)]
    rows = layers[0][0].withColumn("prio", F.lit(1))
    for layer, prio in layers[1:]:
        rows = rows.unionByName(layer.withColumn("prio", F.lit(prio)))
    out = rows.groupBy("page_id", "name").agg(F.max_by("value", "prio").alias("value")).withColumn("name", F.concat(F.lit("asp."), "name"))
    if "candidates" in pages.columns:
        listed = pages.select("page_id", F.posexplode("candidates").alias("i", "c"))
        out = out.unionByName(listed.select("page_id", F.concat(F.lit("asp.price_candidate_"), F.col("i").cast("string")).alias("name"), double_text(F.col("c").cast("double")).alias("value")))
    return out


def is_news(name: Column) -> Column:
    return (name == "news") | name.startswith("vision.news") | name.contains(".news.") | name.endswith(".news")


def merge_quote_sources(flat: DataFrame) -> DataFrame:
    """ticker, name, value, prio -> the value of the highest prio; page prices that differ from a vision price go; no news."""
    rows = flat.where(~is_news(F.col("name"))).groupBy("ticker", "name").agg(F.max_by("value", "prio").alias("value"))
    number = F.regexp_replace(F.col("value"), r"[,$]", "").try_cast("double")
    seen = rows.where((F.col("name") == "vision.regularMarketPrice") & (number != 0)).select(F.col("ticker").alias("_t"), number.alias("_v"))
    rows = rows.join(seen, F.col("ticker") == F.col("_t"), "left")
    stale = F.col("_v").isNotNull() & F.col("name").isin(*STALE_KEYS) & ~F.coalesce(number == F.col("_v"), F.lit(False))
    return rows.where(~stale).select("ticker", "name", "value")


def smart_quote(flat: DataFrame) -> DataFrame:
    """ticker with eight fields, each the first of its keys that is neither 0 nor empty."""
    keys = list(dict.fromkeys(k for ks in SMART.values() for k in ks))
    named = {k: f"k{i}" for i, k in enumerate(keys)}
    wide = flat.where(F.col("name").isin(*keys)).groupBy("ticker").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(c) for k, c in named.items()])
    told = lambda c: F.when(~c.isin("", "null", "false") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c)
    out = []
    for field, ks in SMART.items():
        value = F.coalesce(*[told(F.col(named[k])) for k in ks])
        out.append((value if field == "shortName" else value.try_cast("double")).alias(field))
    return wide.select("ticker", *out)


def quote_price(flat: DataFrame, page_prices: DataFrame | None = None) -> DataFrame:
    """ticker, price: the first of the price keys above 0, else the page's, four decimals."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(PRICE_KEYS) for x in (k, i)]), F.col("name"))
    rows = flat.select("ticker", rank.alias("r"), F.col("value").try_cast("double").alias("v")).where("r is not null and v > 0")
    best = rows.groupBy("ticker").agg(F.min_by("v", "r").alias("price"))
    if page_prices is not None:
        more = page_prices.select(F.col("ticker").alias("_t"), F.col("price").alias("_p"))
        best = best.join(more, F.col("ticker") == F.col("_t"), "full_outer").select(F.coalesce("ticker", "_t").alias("ticker"), F.coalesce("price", "_p").alias("price"))
    return best.select("ticker", rounded(F.col("price"), 4).alias("price"))


def has_quote_price(flat: DataFrame) -> DataFrame:
    number = F.regexp_replace(F.col("value"), r"[,$]", "").try_cast("double")
    priced = F.col("name").endswith("regularMarketPrice") & (F.coalesce(number, F.lit(0.0)) != 0)
    return flat.groupBy("ticker").agg(F.bool_or(priced).alias("has_price"))


def rss_articles(feeds: DataFrame, limit: int = NEWS_LIMIT) -> DataFrame:
    """feed_id, rss -> feed_id, pos, title, link, summary, publisher: the first ``limit`` (1 to 25) items with a title."""
    items = F.regexp_extract_all(text_or_empty(F.col("rss")), F.lit(r"(?i)<item>([\s\S]*?)</item>"), F.lit(1))
    part = lambda b, tag: F.regexp_extract(b, rf"(?i)<{tag}>(?:<!\[CDATA\[)?([\s\S]*?)(?:\]\]>)?</{tag}>", 1)
    titled = F.slice(F.filter(items, lambda b: b.rlike(r"(?i)<title>[\s\S]*?</title>")), 1, max(1, min(25, limit)))
    rows = feeds.select("feed_id", F.posexplode(titled).alias("pos", "b"))
    title = strip(F.regexp_replace(part(F.col("b"), "title"), f"{SPACE}+", " "))
    link = strip(F.regexp_extract("b", r"(?i)<link>([\s\S]*?)</link>", 1))
    summary = F.left(strip(F.regexp_replace(part(F.col("b"), "description"), "<[^>]+>", " ")), F.lit(SUMMARY))
    return rows.select("feed_id", "pos", title.alias("title"), link.alias("link"), summary.alias("summary"), F.lit(PUBLISHER).alias("publisher"))


def html_articles(pages: DataFrame, limit: int = NEWS_LIMIT) -> DataFrame:
    """page_id, html -> page_id, pos, title, link, publisher: linked headlines, or bare ones on pages without any."""
    linked = r'(?i)<a[^>]+href="([^"]+)"[^>]*>[\s\S]{0,200}?<h3[^>]*>([^<]{8,240})</h3>'
    html = text_or_empty(F.col("html"))
    pairs = _pairs(html, F.lit(linked))
    bare = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h3[^>]*>([^<]{12,240})</h3>"), F.lit(1)), lambda t: F.struct(F.lit("").alias("name"), t.alias("value")))
    rows = pages.select("page_id", F.posexplode(F.when(F.size(pairs) > 0, pairs).otherwise(bare)).alias("at", "p"))
    rows = rows.select("page_id", "at", strip(F.regexp_replace("p.value", f"{SPACE}+", " ")).alias("title"), strip(F.col("p.name")).alias("link"))
    once = rows.groupBy("page_id", "title").agg(F.min(F.struct("at", "link")).alias("f")).select("page_id", "title", "f.at", "f.link")
    order = Window.partitionBy("page_id").orderBy("at")
    out = once.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < limit)
    return out.select("page_id", "pos", "title", "link", F.lit(PUBLISHER).alias("publisher"))
