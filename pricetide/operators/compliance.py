"""Gates, block classification, outcomes, events, admission and robots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions.helpers import admit
from pricetide.functions.text import text_or_empty

#: Source types and statuses that may not be used.
REJECTED_TYPES = ("google_shopping", "google_shopping_scrape")
INACTIVE = ("paused", "blocked_or_rate_limited", "disallowed_by_robots", "disallowed_by_terms", "error")
#: What blocked pages say, in the order in which it decides.
STRONG = ("robot or human", "verify you are human", "robot check", "px-captcha", "please verify you are a human")
KEYWORDS = (
    ("captcha", "captcha_detected"), ("verify you are human", "captcha_detected"), ("unusual traffic", "access_denied"),
    ("access denied", "access_denied"), ("bot detection", "access_denied"), ("login required", "login_required"),
    ("sign in to continue", "login_required"), ("rate limit", "rate_limited"), ("robot check", "captcha_detected"),
    ("robot or human", "captcha_detected"), ("px-captcha", "captcha_detected"), ("please enable javascript", "access_denied"),
    ("something went wrong", "access_denied"), ("error page | ebay", "access_denied"),
)
SHORT_WORDS = ("captcha", "security", "sign in")
ERROR_WORDS = ("access denied", "something went wrong", "error page | ebay")
TITLE_WORDS = ("robot", "blocked", "access denied", "captcha")
BODY_WORDS = ("robot or human", "robot check", "verify you are human", "unusual traffic", "access denied", "px-captcha", "please enable javascript", "automated access")
KNOWN_RETAILERS = ("ebay", "walmart", "amazon", "target", "bestbuy")
#: Marks of a wall's vendor, in order.
VENDORS = {
    "perimeterx": ("px-captcha", "perimeterx", "human-challenge", "_pxhd", "_px3", "captcha.px-cdn.net", "press & hold", "press and hold"),
    "datadome": ("datadome", "captcha-delivery.com", "geo.captcha-delivery.com", "dd-captcha", "datadome-captcha"),
    "recaptcha": ("g-recaptcha", "recaptcha", "data-sitekey"),
    "cloudflare": ("cf-challenge", "cloudflare", "just a moment", "turnstile"),
}
#: Marks of a product page and its least size, by retailer; titles of error pages; trusted backends.
PROFILES = (
    ("amazon", ["s-search-result", 'data-component-type="s-search-result"', "priceToPay"], 20000),
    ("walmart", ["product-title", "currentprice", "product-price", "data-item-id", "search-result"], 8000),
    ("ebay", ["s-item__title", "s-card", "srp-river-results", 'itemprop="price"', "s-card__price", "srp-results", "s-item__price"], 12000),
    ("bestbuy", ["sku-title", "product-list-container", "priceView", "customerPrice"], 8000),
    ("target", ["ProductCardWrapper", 'data-test="product-title"', "current-price", "product-card", "ProductCard", 'data-test="product-grid"', "styles__StyledTitleLink"], 10000),
    ("yahoo_finance", ['data-test="qsp-price"', 'fin-streamer[data-field="regularMarketPrice"][value', "quote-header-info"], 12000),
)
ERROR_TITLES = ("error page", "something went wrong", "robot or human", "access denied")
UNBLOCKERS, GRID = ("brightdata_scraping_browser", "browser_grid"), "browser_grid"
#: Tier names, detection hits by block reason, canonical reasons.
TIERS = {1: "static_api", 2: "js_rendered", 3: "advanced_antibot", 4: "bank_grade"}
HITS = {
    "captcha": ["captcha"], "cloudflare_challenge": ["captcha", "js_pow"], "turnstile_challenge": ["captcha", "js_pow"],
    "datadome_block": ["behavioral_ml", "browser_fingerprint"], "access_denied": ["ip_reputation", "automation_signals"],
    "blocked": ["behavioral_ml"], "login_wall": ["cookie_session"], "rate_limited": ["request_patterns"], "ip_blocked": ["ip_reputation"],
}
REASONS = {"captcha": "captcha_required", "cloudflare_challenge": "turnstile_challenge", "access_denied": "access_denied", "blocked": "access_denied", "login_wall": "access_denied"}
BAD_EVENTS = ("captcha_detected", "access_denied", "rate_limited")
MANAGED = "managed_retailer_search"
#: Seconds between requests and requests a minute where a source sets none.
DELAY, PER_MINUTE = 10.0, 6


def _has(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def source_gate(source_type: Column, status: Column) -> tuple[Column, Column]:
    """Whether a source may be used, and why not."""
    reason = (
        F.when(source_type.isin(*REJECTED_TYPES), "google_shopping_direct_scrape_rejected")
        .when(status.isin(*INACTIVE), F.concat(F.lit("source_status_"), status))
        .when(F.coalesce(status, F.lit("")) != "active", "source_not_active")
        .otherwise("ok")
    )
    return reason == "ok", reason


def classify_block(text: Column, http_status: Column, url: Column) -> Column:
    """The reason a response counts as blocked, or ``ok``; the first rule that holds decides."""
    text = text_or_empty(text)
    head, body, size = F.lower(F.left(text, F.lit(4000))), F.lower(F.left(text, F.lit(12_000))), F.length(text)
    rule = F.when(http_status == 403, "access_denied").when(http_status == 429, "rate_limited")
    rule = rule.when(F.lower(text_or_empty(url)).contains("/blocked"), "access_denied").when(_has(head, STRONG), "captcha_detected")
    for word, reason in KEYWORDS:
        rule = rule.when((size < 15_000) & body.contains(word), reason)
    rule = rule.when((size < 2000) & _has(body, SHORT_WORDS), "captcha_detected").when((size < 2500) & _has(head, ERROR_WORDS), "access_denied")
    return rule.otherwise("ok")


def escalation_decision(reason: Column, tier: Column) -> tuple[Column, Column]:
    """(escalate, stop): blocked answers escalate from tier 1 and stop from tier 4 on."""
    hit = reason != "ok"
    return hit & (tier == 1), hit & (tier >= 4)


def likely_blocked(url: Column, title: Column, text: Column, char_count: Column, retailer: Column) -> Column:
    """Pages that answered but look like a wall."""
    head, where = F.left(text_or_empty(text), F.lit(12_000)), F.lower(text_or_empty(url))
    size = F.coalesce(F.nullif(char_count, F.lit(0)), F.length(head))
    short = F.coalesce(retailer.isin(*KNOWN_RETAILERS), F.lit(False)) & (size < 2000)
    return _has(where, ("/blocked", "challenge")) | _has(F.lower(text_or_empty(title)), TITLE_WORDS) | _has(F.lower(head), BODY_WORDS) | short | ((size < 2500) & _has(F.lower(head), SHORT_WORDS))


def wall_vendor(html: Column, url: Column, text: Column) -> Column:
    blob = F.lower(F.concat_ws("\n", text_or_empty(url), text_or_empty(html), text_or_empty(text)))
    rule = F
    for vendor, marks in VENDORS.items():
        rule = rule.when(_has(blob, marks), F.lit(vendor))
    return rule.otherwise(F.lit(None).cast("string"))


def profiles(spark) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), "retailer_key string, product_markers array<string>, min_usable_chars int")


def usable_pages(envelopes: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """envelopes with ``usable``: ok, and trusted, unprofiled, marked as a product page, or large and without an error title."""
    rows = envelopes.join(profile_rows, "retailer_key", "left")
    marked = lambda c: F.exists("product_markers", lambda m: F.lower(F.left(text_or_empty(c), F.lit(120_000))).contains(F.lower(m)))
    backend = text_or_empty(F.col("fetch_backend"))
    size = F.coalesce(F.nullif("char_count", F.lit(0)), F.nullif(F.length(text_or_empty(F.col("text"))), F.lit(0)), F.length(text_or_empty(F.col("html"))))
    large = backend.isin(*UNBLOCKERS) & (size >= F.col("min_usable_chars")) & ~_has(F.lower(text_or_empty(F.col("title"))), ERROR_TITLES)
    fine = (backend == GRID) | F.col("product_markers").isNull() | marked(F.col("html")) | marked(F.col("text")) | large
    return rows.withColumn("usable", F.coalesce(F.col("status") == "ok", F.lit(False)) & fine).drop("product_markers", "min_usable_chars")


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """source_id, url, text, http_status, tier, status, source_type, source_status, robots_ok, escalate_on_block -> event rows.

    event_type, message, final_status; an escalation is an event of its own beside the outcome.
    """
    allowed, gate = source_gate(F.col("source_type"), F.col("source_status"))
    rows = fetches.withColumn("_gate", gate).withColumn("_reason", classify_block(F.col("text"), F.col("http_status"), F.col("url")))
    escalate, stop = escalation_decision(F.col("_reason"), F.col("tier"))
    open_ = F.col("_gate") == "ok"
    robots = F.coalesce(F.col("robots_ok"), F.lit(True))
    failed = stop | (F.col("status") == "error")
    reason = F.when(stop, F.col("_reason")).otherwise(F.lit("fetch_failed"))
    event = lambda when, kind, message, final: F.when(when, F.struct(kind.alias("event_type"), message.alias("message"), F.lit(final).alias("final_status")))
    made = F.array(
        event(~open_, F.lit("source_paused"), F.col("_gate"), "rejected"),
        event(open_ & ~robots, F.lit("robots_disallowed"), F.lit("disallowed_by_robots"), "rejected"),
        event(open_ & robots & escalate & F.col("escalate_on_block"), F.lit("captcha_detected"), F.col("_reason"), "escalated"),
        event(open_ & robots & failed, F.when(reason.contains("captcha"), "captcha_detected").otherwise("access_denied"), reason, "blocked"),
        event(open_ & robots & ~failed & (F.col("status") == "ok"), F.lit("fetch_success"), F.lit("ok"), "ok"),
    )
    rows = rows.withColumn("_e", F.explode(F.filter(made, lambda e: e.isNotNull())))
    return rows.select("fetch_id", "source_id", "url", "http_status", "_e.event_type", "_e.message", "_e.final_status", "created_at")


def apply_event_status(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources that are not managed and had a bad event become blocked_or_rate_limited."""
    bad = events.where(F.col("event_type").isin(*BAD_EVENTS)).select("source_id").distinct().withColumn("_bad", F.lit(True))
    rows = sources.join(bad, "source_id", "left")
    hit = F.coalesce(F.col("_bad"), F.lit(False)) & (text_or_empty(F.col("source_type")) != MANAGED)
    return rows.withColumn("status", F.when(hit, "blocked_or_rate_limited").otherwise(F.col("status"))).drop("_bad")


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    return events.orderBy(F.desc("created_at"), "event_id").limit(n)


def annotate_envelope(envelopes: DataFrame) -> DataFrame:
    """tier, status, block_reason -> tier_name, detection_hits, canonical_reason."""
    mapped = lambda values, c: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), c)
    hits = mapped({k: F.array(*map(F.lit, v)) for k, v in HITS.items()}, F.coalesce(F.nullif("block_reason", F.lit("")), F.lit("blocked")))
    blocked = (text_or_empty(F.col("block_reason")) != "") | (F.col("status") == "blocked")
    reason = F.when(text_or_empty(F.col("block_reason")) == "", "blocked").otherwise(F.coalesce(mapped({k: F.lit(v) for k, v in REASONS.items()}, F.col("block_reason")), F.col("block_reason")))
    return envelopes.withColumns({
        "tier_name": F.coalesce(mapped({k: F.lit(v) for k, v in TIERS.items()}, F.col("tier")), F.lit("js_rendered")),
        "detection_hits": F.when(blocked, F.coalesce(hits, F.array(F.lit("behavioral_ml")))).otherwise(F.array().cast("array<string>")),
        "canonical_reason": reason,
    })


ADMITTED = "domain string, request_id long, requested_at double, admitted boolean, started_at double, reason string"


def admit_requests(requests: DataFrame) -> DataFrame:
    """domain, request_id, requested_at (seconds), delay, max_rpm -> admitted, started_at, reason; in time order per domain.

    Admission depends on all that was admitted before, so a domain is one task; its rows are times and numbers only.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["requested_at", "request_id"])
        delays = [float(d) if d and d == d else DELAY for d in pdf["delay"]]
        limits = [int(m) if m and m == m else PER_MINUTE for m in pdf["max_rpm"]]
        starts, *_ = admit(pdf["requested_at"].tolist(), delays, limits)
        out = pdf[["domain", "request_id", "requested_at"]].copy()
        out["admitted"] = [s is not None for s in starts]
        out["started_at"] = [float("nan") if s is None else s for s in starts]
        out["reason"] = ["rate_limited" if s is None else "ok" for s in starts]
        return out

    done = requests.groupBy("domain").applyInPandas(one, ADMITTED)
    return done.withColumn("started_at", F.when(F.col("admitted"), F.col("started_at")))


def robots_rules(texts: DataFrame, agent: str) -> DataFrame:
    """host_key, rules (text) -> host_key, for_agent: the rules (pos, allow, path) of the group that speaks to ``agent``, in order.

    The first group that names the agent counts, else the first for all agents; a host without either has none.
    """
    found = texts.select("host_key", F.posexplode(F.split("rules", r"\r\n|[\r\n]")).alias("pos", "line"))
    said = F.regexp_extract_all(F.regexp_replace("line", "#.*", ""), F.lit(r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$"), F.lit(1))
    told = F.regexp_extract(F.regexp_replace("line", "#.*", ""), r"^\s*[A-Za-z-]+\s*:\s*(.*?)\s*$", 1)
    found = found.select("host_key", "pos", F.lower(F.get(said, 0)).alias("field"), told.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host_key").orderBy("pos")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    found = found.withColumn("_begins", begins.cast("int")).withColumn("_group", F.sum("_begins").over(order))
    is_agent = F.col("field") == "user-agent"
    rule = F.struct("pos", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))
    groups = found.where("_group > 0").groupBy("host_key", "_group").agg(
        F.collect_set(F.when(is_agent, F.lower("value"))).alias("_agents"), F.array_sort(F.collect_list(F.when(~is_agent, rule))).alias("rules")
    )
    me = F.lit(agent.split("/")[0].lower())
    named = F.exists("_agents", lambda a: (a != "*") & (a != "") & me.contains(a))
    fit = groups.withColumn("_far", F.when(named, 0).when(F.array_contains("_agents", "*"), 1)).where("_far is not null")
    return fit.groupBy("host_key").agg(F.min_by("rules", F.struct("_far", "_group")).alias("for_agent"))


def robots_gate(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """url -> allowed, reason, by the rules text (host_key, rules) of its scheme and host; a missing text allows nothing.

    The first rule whose path begins the url's path decides; without one the url is allowed.
    """
    host = F.concat(F.parse_url("url", F.lit("PROTOCOL")), F.lit("://"), F.parse_url("url", F.lit("AUTHORITY")))
    rules = rules.where("rules is not null")
    known = rules.select("host_key", F.lit(True).alias("_known")).join(robots_rules(rules, agent), "host_key", "left")
    rows = urls.withColumn("host_key", host).join(known, "host_key", "left")
    path = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*(.*)$", 1)
    rows = rows.withColumn("_path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    hit = F.get(F.filter("for_agent", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), 0)
    reason = F.when(F.col("_known").isNull(), "robots_unavailable").when(F.coalesce(hit["allow"], F.lit(True)), "allowed_by_robots").otherwise("disallowed_by_robots")
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "allowed_by_robots").drop("_known", "_path", "for_agent")
