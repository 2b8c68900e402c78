"""Model replies: parsing, salvage, merging, flattening, aliases, and the shop payload in a reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions.text import let, strip, text_or_empty
from pricetide.functions.trees import fields_of, nesting
from pricetide.sources.work import materialize

#: Fields that a broken reply can still give.
SALVAGED_TEXTS = ("product_name", "title", "availability", "seller")
SALVAGED_NUMBERS = ("price", "original_price", "rating", "review_count")


def salvage_reply(text: Column) -> Column:
    """A struct of the fields found in a truncated reply; null without a price other than 0, a product_name or a title."""
    found = {k: F.nullif(F.regexp_extract(text, rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")) for k in SALVAGED_TEXTS}
    found = {k: F.replace(v, F.lit('\\"'), F.lit('"')) for k, v in found.items()}
    found |= {k: F.regexp_extract(text, rf'"{k}"\s*:\s*([\d.]+)', 1).try_cast("double") for k in SALVAGED_NUMBERS}
    good = (F.coalesce(found["price"], F.lit(0.0)) != 0) | found["product_name"].isNotNull() | found["title"].isNotNull()
    return F.when(text.contains("{") & good, F.struct(*[v.alias(k) for k, v in found.items()]))


def parse_replies(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """-> parsed (JSON text of an object), how (direct, wrapped, inner, salvaged or failed), error."""
    clean = strip(F.regexp_replace(text_or_empty(F.col(raw)), r"```(?:json)?\s*", ""))
    clean = F.regexp_replace(strip(F.regexp_replace(clean, r"`+\z", "")), r",\s*([\]}])", "$1")
    rows = replies.withColumn("_r", let(clean, _outcome))
    rows = rows.withColumn("parsed", F.col("_r.parsed")).withColumn("how", F.col("_r.how"))
    return rows.withColumn("error", F.when(F.col("how") == "failed", F.lit("json_parse_failed"))).drop("_r")


def _outcome(clean: Column) -> Column:
    """Parsed as it stands, else the widest object in it, else what can be salvaged."""
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    said = lambda parsed, how: F.struct(parsed.alias("parsed"), F.lit(how).alias("how"))
    tried = lambda text: F.try_parse_json(F.nullif(text, F.lit("")))

    def salvaged(_: Column) -> Column:
        return let(salvage_reply(clean), lambda s: F.when(s.isNotNull(), said(F.to_json(s), "salvaged")).otherwise(said(F.lit(None).cast("string"), "failed")))

    def inner(_: Column) -> Column:
        whole = tried(F.regexp_extract(clean, r"(?s)\{.*\}", 0))
        return let(whole, lambda w: F.when(is_object(w), said(F.to_json(w), "inner")).otherwise(salvaged(w)))

    wrapped = lambda v: F.concat(F.lit('{"result":'), F.to_json(v), F.lit("}"))
    return let(tried(clean), lambda v: F.when(is_object(v), said(F.to_json(v), "direct")).when(v.isNotNull(), said(wrapped(v), "wrapped")).otherwise(inner(v)))


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("plain")


def _fields(v: Column) -> Column:
    """The fields of an object but nulls and marked ones; null for all else, and for objects that tell of an error."""

    def told(m: Column) -> Column:
        failed = F.coalesce(~F.try_variant_get(F.try_element_at(m, F.lit("_error")), "$", "string").isin("", "0", "false"), F.lit(False))
        return F.when(~failed, F.filter(F.map_entries(m), lambda x: ~x["key"].startswith("_") & ~F.coalesce(F.is_variant_null(x["value"]), F.lit(True))))

    return let(fields_of(v), told)


def _nodes(v: Column, depth: Column) -> Column:
    """(p, v) of everything below an object, at any depth: p is the names that lead to it."""
    kind = "array<struct<p: array<string>, v: variant>>"
    below = lambda e: F.transform(F.coalesce(_fields(e["v"]), F.array().cast("array<struct<key: string, value: variant>>")), lambda x: F.struct(F.concat(e["p"], F.array(x["key"])).alias("p"), x["value"].alias("v")))
    start = F.struct(F.array(F.struct(F.array().cast("array<string>").alias("p"), v.alias("v"))).cast(kind).alias("last"), F.array().cast(kind).alias("all"))

    def step(a: Column, _: Column) -> Column:
        return let(F.flatten(F.transform(a["last"], below)), lambda n: F.struct(n.alias("last"), F.concat(a["all"], n).alias("all")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), depth)), start, step, lambda a: a["all"])


def _union(lists: Column) -> Column:
    """JSON lists in order -> one JSON list without repeats; plain items that read the same count as repeats."""
    items = F.flatten(F.transform(lists, lambda j: F.try_parse_json(j).try_cast("array<variant>")))
    said = F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    first = let(said, lambda s: F.filter(F.transform(items, lambda v, i: F.when(F.array_position(s, F.get(s, i)) == i + 1, F.to_json(v))), lambda j: j.isNotNull()))
    return F.concat(F.lit("["), F.array_join(first, ","), F.lit("]"))


def _quoted_name(name: Column) -> Column:
    return let(F.to_json(F.array(name)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def _written(leaves: DataFrame) -> DataFrame:
    """_k, _p, _j of the leaves of trees -> _k, merged: one JSON text of each tree. In order of their paths each leaf shuts the objects that
    it has left since the leaf before, opens those that it is in, and names itself."""
    order = Window.partitionBy("_k").orderBy("_p")
    rows = leaves.withColumns({"_b": F.lag("_p").over(order), "_n": F.row_number().over(order)})
    shared = F.coalesce(F.array_position(F.zip_with(F.col("_p"), F.coalesce("_b", F.array().cast("array<string>")), lambda a, b: F.coalesce(a == b, F.lit(False))), False) - 1, F.size("_p").cast("long")).cast("int")
    rows = rows.withColumn("_s", F.when(F.col("_b").isNull(), F.lit(0)).otherwise(shared))
    shut = F.when(F.col("_b").isNull(), F.lit("")).otherwise(F.concat(F.repeat(F.lit("}"), F.size("_b") - 1 - F.col("_s")), F.lit(",")))
    inner = F.transform(F.slice("_p", F.col("_s") + 1, F.size("_p") - 1 - F.col("_s")), lambda n: F.concat(_quoted_name(n), F.lit(":{")))
    piece = F.concat(shut, F.array_join(inner, ""), _quoted_name(F.element_at("_p", -1)), F.lit(":"), "_j")
    rows = rows.select("_k", F.struct("_n", piece.alias("t"), F.size("_p").alias("d")).alias("f")).groupBy("_k").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return rows.select("_k", F.concat(F.lit("{"), F.array_join(F.transform("f", lambda x: x["t"]), ""), F.repeat(F.lit("}"), F.element_at("f", -1)["d"])).alias("merged"))


def merge_partials(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """page, panel, parsed -> one merged JSON text for each page, panels in order.

    Of each field the first part that has it tells; lists of several parts unite without repeats, objects of several parts
    merge field by field, however deep. Parts that aren't objects or tell of an error don't count. All paths of all parts
    are one table: what stands at a path is decided once, and a path counts if everything above it is merged. So the steps are
    the same few at any depth, and a page with many parts is no one task's work until its text is written.
    """
    rows = parts.select(F.col(key).alias("_k"), F.struct("panel", "parsed").alias("_o"), F.explode(_nodes(F.try_parse_json("parsed"), nesting(F.col("parsed"), "{"))).alias("e"))
    nodes = rows.select("_k", "_o", F.col("e.p").alias("_p"), _kind(F.col("e.v")).alias("_c"), F.to_json("e.v").alias("_v"))
    lists = F.array_sort(F.collect_list(F.when(F.col("_c") == "array", F.struct("_o", F.col("_v").alias("j")))))
    paths = nodes.groupBy("_k", "_p").agg(F.min_by("_c", "_o").alias("_c"), F.min_by("_v", "_o").alias("_j"), F.count_if(F.col("_c") == "object").alias("_n"), lists.alias("_l"))
    united = F.when((F.col("_c") == "array") & (F.size("_l") > 1), _union(F.transform("_l", lambda x: x["j"]))).otherwise(F.col("_j"))
    paths = materialize(paths.select("_k", "_p", ((F.col("_c") == "object") & (F.col("_n") > 1)).alias("_m"), united.alias("_j")), "paths")
    above = paths.where(F.size("_p") > 1).select("_k", "_p", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda n: F.slice("_p", F.lit(1), n))).alias("_a"))
    kept_whole = paths.where("not _m").select("_k", F.col("_p").alias("_a"))
    dead = above.join(kept_whole, ["_k", "_a"], "left_semi").select("_k", "_p").distinct()
    live = paths.join(dead, ["_k", "_p"], "left_anti")
    inside = live.where(F.size("_p") > 1).select("_k", F.slice("_p", F.lit(1), F.size("_p") - 1).alias("_p")).distinct()
    bare = live.where("_m").join(inside, ["_k", "_p"], "left_anti").select("_k", "_p", F.lit("{}").alias("_j"))
    leaves = live.where("not _m").select("_k", "_p", "_j").unionByName(bare)
    pages = parts.select(F.col(key).alias("_k")).distinct()
    return pages.join(_written(leaves), "_k", "left").select(F.col("_k").alias(key), F.coalesce("merged", F.lit("{}")).alias("merged"))


def flatten_reply(replies: DataFrame, key: str = "page_id", parsed: str = "parsed", prefix: str = "vision", skip: tuple[str, ...] = ("news",)) -> DataFrame:
    """key, name, value: one level of objects opened as prefix.key.field; marked and skipped keys and nested nulls left out."""
    rows = replies.select(F.col(key).alias("_k"), F.try_parse_json(F.col(parsed)).alias("_v"))
    spark = replies.sparkSession
    tops = spark.sql("SELECT _k, t.key AS k, t.value AS v FROM {rows}, LATERAL variant_explode_outer(_v) AS t WHERE t.key IS NOT NULL", rows=rows)
    tops = tops.where(~F.col("k").startswith("_") & ~F.col("k").isin(*skip))
    nested = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    plain = tops.where(~nested).select("_k", F.concat(F.lit(f"{prefix}."), "k").alias("name"), F.col("v").cast("string").alias("value"))
    inner = spark.sql("SELECT _k, k, t.key AS f, t.value AS w FROM {rows}, LATERAL variant_explode(v) AS t", rows=tops.where(nested))
    inner = inner.where(~F.coalesce(F.is_variant_null("w"), F.lit(True))).select("_k", F.concat(F.lit(f"{prefix}."), "k", F.lit("."), "f").alias("name"), F.col("w").cast("string").alias("value"))
    return plain.unionByName(inner).withColumnRenamed("_k", key)


def promote_aliases(flat: DataFrame, aliases: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows for alias targets (src, dst, pos) that have no value yet, from the first source that has one, beside all rows."""
    have = flat.where("value is not null").select(F.col(key).alias("_k"), F.col("name").alias("_n"))
    offered = flat.where("value is not null").join(aliases, flat["name"] == aliases["src"])
    best = offered.groupBy(key, "dst").agg(F.min(F.struct("pos", "value")).alias("b"))
    fresh = best.join(have, (best[key] == have["_k"]) & (best["dst"] == have["_n"]), "left_anti").select(key, F.col("dst").alias("name"), F.col("b.value").alias("value"))
    filled = fresh.select(F.col(key).alias("_k"), F.col("name").alias("_n"))
    kept = flat.join(filled, (flat[key] == filled["_k"]) & (flat["name"] == filled["_n"]), "left_anti")
    return kept.unionByName(fresh)


#: A listing as a reply may spell it.
SPELT = "struct<product_name: string, title: string, name: string, price: string, original_price: string, list_price: string, seller: string, product_url: string, url: string, availability: string, rating: string, review_count: string>"


def reply_listings(replies: DataFrame, key: str = "payload_id", parsed: str = "parsed") -> DataFrame:
    """A payload's products, or the payload itself as one listing, as rows for ``normalize_listings``."""
    items = F.from_json(F.get_json_object(parsed, "$.products"), f"array<{SPELT}>")
    rows = replies.select(key, "query", items.alias("_items"), F.from_json(parsed, SPELT).alias("_one"))
    rows = rows.select(key, "query", F.posexplode(F.when(F.size("_items") > 0, F.col("_items")).otherwise(F.array("_one"))).alias("pos", "_i"))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"_i.{n}"), F.lit("")) for n in names])
    return rows.select(
        key, "query", "pos", first("product_name", "title", "name").alias("product_name"), first("price").alias("price"),
        first("original_price", "list_price").alias("original_price"), first("seller").alias("seller"), first("product_url", "url").alias("product_url"),
        first("availability").alias("availability"), first("rating").alias("rating"), first("review_count").alias("review_count"),
    )


def reply_to_shop(replies: DataFrame) -> DataFrame:
    """payload_id, query, parsed -> the payload's cheapest usable listing and its list, source ``vision``."""
    from pricetide.operators.listings import dedupe_listings, normalize_listings, rollup_listings

    return rollup_listings(dedupe_listings(normalize_listings(reply_listings(replies)))).withColumn("price_source", F.lit("vision"))


def has_signal(parsed: Column) -> Column:
    """A price or a product_name that is not empty, or products."""
    v = F.try_parse_json(parsed)
    price = F.try_variant_get(v, "$.price", "string")
    told = F.coalesce(~price.isin("", "0", "0.0", "false"), F.lit(False)) | F.coalesce(F.try_variant_get(v, "$.product_name", "string") != "", F.lit(False))
    return told | F.coalesce(F.size(F.try_variant_get(v, "$.products", "array<variant>")) > 0, F.lit(False))


def explode_reply_list(replies: DataFrame, field: str, key: str = "page_id", parsed: str = "parsed") -> DataFrame:
    """Entries with a name or title of a reply's list: key, pos, name, entry (JSON), and how many the reply has."""
    items = F.try_variant_get(F.try_parse_json(F.col(parsed)), f"$.{field}", "array<variant>")
    rows = replies.select(key, F.posexplode(items).alias("pos", "_i"))
    name = F.coalesce(*[F.nullif(F.try_variant_get("_i", f"$.{n}", "string"), F.lit("")) for n in ("name", "title", "card_name", "strategy_name")])
    rows = rows.select(key, "pos", name.alias("name"), F.to_json("_i").alias("entry")).where("name is not null")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_entries"))
    return rows.join(sizes, key)
