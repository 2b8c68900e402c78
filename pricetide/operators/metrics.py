"""Dashboards, spend, failure classes, circuits, health ratios and profiles of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.numbers import rounded

#: Cost of a success by provider, and what failures say.
COSTS = {
    "brightdata_scraping_browser": 0.02, "brightdata_unlocker": 0.015, "external_scrapfly": 0.01, "proxy_http": 0.005,
    "captcha_browser": 0.003, "browser_grid": 0.001, "js_browser": 0.001, "http_impersonate": 0.0,
}
PAID = ("brightdata_scraping_browser", "brightdata_unlocker", "external_scrapfly")
SUSPENSION = r"(?i)customer_suspended|account is suspended|auth failed|billing|insufficient.?balance|quota.?exceeded"
WALL = r"(?i)captcha|access_denied|no_product_list|login_required|rate_limited|verify you are human|robot check|bot detection|blocked"
QUEUE = r"browser_grid_timeout|browser_grid_enqueue"
MAX_FAILURES = 5


def cost_of(provider: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv]), provider), F.lit(0.0))


def known_status(status: Column) -> Column:
    return F.when(status.isin("ok", "blocked", "error"), status).otherwise("error")


def provider_dashboard(log: DataFrame) -> DataFrame:
    """provider, status, latency_ms -> attempts, success, blocked, errors, rates, latency and costs of each provider."""
    rows = log.select("provider", known_status(F.col("status")).alias("status"), F.coalesce(F.col("latency_ms").cast("long"), F.lit(0)).alias("ms"))
    counts = rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "ok").alias("success"),
        F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("ms").alias("ms"),
    )
    cost = cost_of(F.col("provider"))
    return counts.select(
        "provider", "attempts", "success", "blocked", "errors",
        rounded(100 * F.col("blocked") / F.col("attempts"), 1).alias("block_rate_pct"), rounded(100 * F.col("success") / F.col("attempts"), 1).alias("success_rate_pct"),
        rounded(F.col("ms") / F.col("attempts"), 0).cast("long").alias("avg_latency_ms"), cost.alias("cost_per_success_usd"), rounded(F.col("success") * cost, 4).alias("total_cost_usd"),
    )


def retailer_dashboard(log: DataFrame) -> DataFrame:
    """retailer_key with the counts of each status."""
    rows = log.where(F.coalesce("retailer_key", F.lit("")) != "").withColumn("status", known_status(F.col("status")))
    return rows.groupBy("retailer_key").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "blocked", "error")])


def daily_spend(log: DataFrame, budget: float = 0.0) -> DataFrame:
    """day, spend, over_budget (only with a budget above 0) from the successes of each UTC day."""
    rows = log.where(F.col("status") == "ok").groupBy(F.window("created_at", "1 day").alias("w")).agg(F.sum(cost_of(F.col("provider"))).alias("spend"))
    over = F.col("spend") > budget if budget > 0 else F.lit(False)
    return rows.select(F.to_date("w.start").alias("day"), rounded(F.col("spend"), 4).alias("spend"), over.alias("over_budget"))


def classify_failure(error: Column) -> Column:
    """ignored_queue, ignored_wall, suspension or other."""
    said = F.coalesce(error, F.lit(""))
    wall = (F.lower(F.trim(said)) == "ok") | said.rlike(WALL)
    return F.when(said.rlike(QUEUE), "ignored_queue").when(wall, "ignored_wall").when(said.rlike(SUSPENSION), "suspension").otherwise("other")


def circuit_state(log: DataFrame, max_failures: int = MAX_FAILURES, spend: DataFrame | None = None) -> DataFrame:
    """provider, seq (order), ok, error -> failures since the last success, disabled_reason, is_open.

    ``spend`` (what ``daily_spend`` gives): a last day over its budget disables the paid providers.

    Two hash aggregates instead of a sort of each provider: the last success first, then what failed after it.
    """
    last = log.groupBy("provider").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    rows = log.join(last, "provider").withColumn("kind", F.when(~F.col("ok"), classify_failure(F.col("error"))))
    counted = F.coalesce(F.col("kind").isin("suspension", "other"), F.lit(False)) & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))
    out = rows.groupBy("provider").agg(F.count_if(counted).alias("failures"), F.coalesce(F.bool_or(F.col("kind") == "suspension"), F.lit(False)).alias("_s"))
    if spend is None:
        out = out.withColumn("_over", F.lit(False))
    else:
        out = out.crossJoin(spend.agg(F.coalesce(F.max_by("over_budget", "day"), F.lit(False)).alias("_over")))  # one row
    budget = F.col("_over") & F.col("provider").isin(*PAID)
    reason = F.when(budget, "daily_budget_exceeded").when(F.col("_s"), "suspended_or_billing")
    out = out.withColumn("disabled_reason", reason)
    return out.withColumn("is_open", F.col("disabled_reason").isNotNull() | (F.col("failures") >= max_failures)).drop("_s", "_over")


def endpoint_health(log: DataFrame, keys: list[str]) -> DataFrame:
    """ok / (ok + failures since the last ok) of each key, 0.5 without any, two decimals."""
    last = log.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    rows = log.join(last, keys)
    failed = ~F.col("ok") & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))
    out = rows.groupBy(*keys).agg(F.count_if("ok").alias("successes"), F.count_if(failed).alias("failures"))
    total = F.col("successes") + F.col("failures")
    return out.withColumn("health", F.when(total == 0, F.lit(0.5)).otherwise(rounded(F.col("successes") / total, 2)))


def field_groups(flat: DataFrame, key: str = "ticker") -> DataFrame:
    """How many keys of a record begin with each path segment, and how many it has."""
    rows = flat.groupBy(key, F.split("name", r"\.")[0].alias("field_group")).agg(F.countDistinct("name").alias("n_fields"))
    totals = rows.groupBy(key).agg(F.sum("n_fields").alias("field_count"))
    return rows.join(totals, key)


def fetch_tally(log: DataFrame, run: str = "run_id") -> DataFrame:
    return log.groupBy(run).agg(F.count_if(F.col("status") == "ok").alias("saved"), F.count_if(F.col("status") != "ok").alias("errors"))
