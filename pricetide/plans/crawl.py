"""From a fetch log to events, source states, dashboards and circuits."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import compliance, metrics


class CrawlReport(NamedTuple):
    """Event rows, sources after them, and the dashboards of the log."""

    events: DataFrame
    sources: DataFrame
    providers: DataFrame
    retailers: DataFrame
    spend: DataFrame
    circuits: DataFrame


def log_to_dashboards(fetches: DataFrame, sources: DataFrame, log: DataFrame, budget: float = 0.0) -> CrawlReport:
    """Fetches (see ``compliance.fetch_outcomes``), their sources, and the log of attempts (provider, retailer_key, status, error, latency_ms, created_at, seq).

    The day's spend decides with the failures whether a paid provider's circuit is open.
    """
    events = compliance.fetch_outcomes(fetches)
    spend = metrics.daily_spend(log, budget)
    circuits = metrics.circuit_state(log.withColumn("ok", F.col("status") == "ok"), spend=spend)
    return CrawlReport(events, compliance.apply_event_status(sources, events), metrics.provider_dashboard(log), metrics.retailer_dashboard(log), spend, circuits)
