"""Structured Streaming forms of the running counters: dashboards, daily spend, circuits, admission, fresh fetches, result lines.

Each takes a streaming DataFrame and returns one; the caller chooses sink, trigger and checkpoint folder. Circuits and fresh
fetches need the RocksDB state store.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricetide.functions.helpers import admit
from pricetide.functions.numbers import rounded
from pricetide.functions.text import fetch_key
from pricetide.operators import pages
from pricetide.operators.compliance import DELAY, PER_MINUTE
from pricetide.operators.metrics import MAX_FAILURES, PAID, classify_failure, cost_of, provider_dashboard
from pricetide.sources import formats
from pricetide.streaming.state import Circuits, NewestFetch

#: The longest time to live of a fetch.
LONGEST_LIFE = "1 day"


def stream_dashboard(log: DataFrame) -> DataFrame:
    """The running dashboard of each provider, with its rates and costs; output mode update or complete. State is one row a provider."""
    return provider_dashboard(log)


def stream_daily_spend(log: DataFrame, budget: float = 0.0) -> DataFrame:
    """Spend of each UTC day; a day's counter lives two days past its end. Output mode update."""
    rows = log.where(F.col("status") == "ok").withWatermark("created_at", "2 days")
    spent = rows.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.sum(cost_of(F.col("provider"))).alias("spend"))
    over = F.col("spend") > budget if budget > 0 else F.lit(False)
    return spent.select(F.to_date("w.start").alias("day"), rounded(F.col("spend"), 4).alias("spend"), over.alias("over_budget"))


def stream_fresh_fetches(fetches: DataFrame, lateness: str = LONGEST_LIFE) -> DataFrame:
    """Fetches (url, fetched_at, ...) -> fetch_key, the columns of ``fetches``, expires_at and live: a change log of fresh fetches.

    A fetch that is newer than what is known of its url comes out as live, and once more as not live when the watermark passes
    its time to live, which depends on the url's domain. The last row of a key with ``expires_at`` after a moment is what
    ``pages.fresh_fetches`` gives for it, whatever the order of arrival. Rows later than ``lateness`` may be dropped; by default
    that is the longest life there is, so a dropped row is one that no longer lives. Output mode update.
    """
    columns = [F.col(f"`{c}`") for c in fetches.columns]
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    ends = F.unix_seconds("fetched_at") + pages.fresh_seconds(F.col("url"))
    rows = fetches.where(F.col("fetched_at").isNotNull()).withWatermark("fetched_at", lateness).select(
        fetch_key(F.col("url")).alias("fetch_key"), "fetched_at", F.unix_micros("fetched_at").alias("us"), pages.fetch_seq(fetches).alias("seq"),
        pages.row_digest(fetches).alias("digest"), ends.alias("expires"), F.to_json(F.struct(*columns), whole).alias("row"),
    )
    made = rows.groupBy("fetch_key").transformWithStateInPandas(NewestFetch(), NewestFetch.OUT, "Update", "EventTime")
    back = F.from_json("row", fetches.schema, whole)
    return made.withColumn("_row", back).select("fetch_key", *[F.col(f"_row.`{c}`").alias(c) for c in fetches.columns], F.timestamp_seconds("expires").alias("expires_at"), "live")


PARTIAL = "provider string, newest long, ok_us long, ok_seq long, failed_us array<long>, failed_seq array<long>, suspended boolean, days array<long>, micros array<long>"


def _partial_circuits(batches):
    """One row a provider for all rows of a task: its last success, the counted failures after it, and the cost of each day."""
    held: dict[str, dict] = {}
    for b in batches:
        for r in b.to_pylist():
            one = held.setdefault(r["provider"], {"provider": r["provider"], "newest": r["us"], "ok": None, "failed": [], "suspended": False, "spent": {}})
            at = (r["us"], r["seq"])
            one["newest"] = max(one["newest"], r["us"])
            if r["micros"]:
                day = r["us"] // Circuits.DAY_US
                one["spent"][day] = one["spent"].get(day, 0) + r["micros"]
            if r["ok"]:
                one["ok"] = at if one["ok"] is None else max(one["ok"], at)
            elif r["kind"] in ("suspension", "other"):
                one["failed"].append(at)
                one["suspended"] |= r["kind"] == "suspension"
    rows = []
    for one in held.values():
        failed = [x for x in one["failed"] if one["ok"] is None or x > one["ok"]]
        ok = one["ok"] or (None, None)
        rows.append([one["provider"], one["newest"], *ok, [x[0] for x in failed], [x[1] for x in failed], one["suspended"], list(one["spent"]), list(one["spent"].values())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def stream_circuits(log: DataFrame, max_failures: int = MAX_FAILURES, budget: float = 0.0, lateness_seconds: int = 2 * 86_400) -> DataFrame:
    """provider, created_at, seq, ok, error -> the circuits of all providers after each batch that has rows; output mode update.

    However the rows are cut into batches and in whatever order they come, the last row of a provider is what
    ``metrics.circuit_state`` says of them in order of (created_at, seq), with the spend of the last day against ``budget``:
    the paid providers are open beyond it. Each task reduces its rows to one a provider, so the one state that knows them all
    reads few rows. Rows more than ``lateness_seconds`` older than the newest come too late to count.
    """
    cost = F.when(F.col("ok"), F.round(cost_of(F.col("provider")) * 1_000_000).cast("long"))
    rows = log.select(
        "provider", F.unix_micros("created_at").alias("us"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("ok"), F.lit(False)).alias("ok"),
        F.when(F.coalesce(F.col("ok"), F.lit(False)), F.lit(None)).otherwise(classify_failure(F.col("error"))).alias("kind"), cost.alias("micros"),
    ).where("provider is not null and us is not null")
    partial = rows.mapInArrow(_partial_circuits, PARTIAL)
    processor = Circuits(max_failures, round(budget * 1_000_000), PAID, lateness_seconds * 1_000_000)
    return partial.withColumn("every", F.lit(True)).groupBy("every").transformWithStateInPandas(processor, Circuits.OUT, "Update", "None")


def stream_admission(requests: DataFrame) -> DataFrame:
    """domain, request_id, requested_at (seconds), delay, max_rpm -> admitted, started_at.

    The state is the last start, the starts of a minute, and the time up to which requests, refused ones too, have waited.
    """

    def step(key, batches, state: GroupState):
        last, recent, clock = state.get if state.exists else (None, [], None)
        rows = pd.concat(list(batches)).sort_values(["requested_at", "request_id"])
        delays = [float(d) if d and d == d else DELAY for d in rows["delay"]]
        limits = [int(m) if m and m == m else PER_MINUTE for m in rows["max_rpm"]]
        starts, last, recent, clock = admit(rows["requested_at"].tolist(), delays, limits, last, list(recent), clock)
        state.update((last, recent, clock))
        out = rows[["domain", "request_id", "requested_at"]].copy()
        out["admitted"] = [s is not None for s in starts]
        out["started_at"] = [s if s is not None else float("nan") for s in starts]
        yield out

    out = "domain string, request_id long, requested_at double, admitted boolean, started_at double"
    return requests.groupBy("domain").applyInPandasWithState(step, out, "last double, recent array<double>, clock double", "append", GroupStateTimeout.NoTimeout)


def stream_result_lines(results: DataFrame, path: str, checkpoint: str):
    """Each micro-batch's retailer lines and summaries as text files in a folder of its own, once (see ``sources.formats``)."""
    formats.register(results.sparkSession)
    return formats.result_rows(results).writeStream.format("result_lines").option("path", path).option("checkpointLocation", checkpoint)
