"""Packing by optimal length buckets.

The histogram of all lengths goes to the driver, where dynamic programming chooses the BUCKETS upper bounds that make padding
least. It has a bin for each length that occurs, so the bounds are the best there are; lengths that differ add up, so a
corpus of b bytes has at most sqrt(2 b) of them (14 million for 100 TB, were each there once). In a bucket of bound L a batch
takes as many documents as fit the token budget when each is padded to L. Documents are numbered within their bucket by
slices, so that no bucket, however full, is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import materialize, row_id, running_sum

BUCKETS, BUDGET, SLICE_ROWS = 16, 1 << 18, 10_000


def _cheapest(cost: np.ndarray, largest: np.ndarray, docs: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each last bin j the least ``cost[i]`` + padding of bins i + 1..j in one bucket, and its i (-1 for none).

    The best i never falls as j rises, so each j need only look between those of its neighbours: the middle ones of all open
    stretches are worked out at once, then the middles of the halves.
    """
    n = len(largest)
    best, cut = cost.copy(), np.full(n, -1)
    choice, lo, hi = np.zeros(n, np.int64), np.array([1]), np.array([n - 1])
    while len(lo):
        mid = (lo + hi) // 2
        left = np.where(lo > 1, choice[lo - 1], 0)
        right = np.minimum(mid - 1, np.where(hi < n - 1, choice[np.minimum(hi + 1, n - 1)], n))
        right = np.maximum(right, left)
        size = right - left + 1
        first = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(first - left, size)
        j = np.repeat(mid, size)
        ways = cost[i] + largest[j] * (docs[j + 1] - docs[i + 1]) - (total[j + 1] - total[i + 1])
        least = np.minimum.reduceat(ways, first)
        at = np.flatnonzero(ways == np.repeat(least, size))
        choice[mid] = i[at[np.searchsorted(at, first)]]
        better = least < best[mid]
        best[mid[better]], cut[mid[better]] = least[better], choice[mid[better]]
        lo, hi = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi])
        open_ = lo <= hi
        lo, hi = lo[open_], hi[open_]
    return best, cut


def best_bounds(largest: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets`` of them, with the least padding of ``count`` documents of each length, lengths rising."""
    n = len(largest)
    if float(largest[-1]) * float(count.sum()) >= 2.0**62:  # beyond whole numbers of 64 bits
        largest, count = largest.astype(float), count.astype(float)
    docs, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(largest * count)])
    cost, cuts = largest * docs[1:] - total[1:], []
    for _ in range(min(buckets, n) - 1):
        cost, cut = _cheapest(cost, largest, docs, total)
        cuts.append(cut)
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            bounds.append(int(largest[j]))
            j = cut[j]
    return sorted([*bounds, int(largest[j])])


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, keep: list[str] | None = None, stored_order: bool = False) -> DataFrame:
    """Every row's ``keep`` columns (default doc_id) with n_tokens, bucket, bound, batch, place and padding.

    ``length`` is a document's number of tokens; it defaults to the bytes of the text, a byte-level model's tokens. Null and
    empty texts have length 0 and are packed as well. A document over the budget is a batch of its own. ``batch`` numbers the
    batches of a bucket from 0, ``place`` the documents of a batch. Documents follow one another in a bucket by a hash of
    where they stand, or with ``stored_order`` as they stand in the files of ``docs``. Ties, repeated rows and ids that repeat
    or are null each have a place of their own. An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    length = F.octet_length("text") if length is None else length
    n = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n_tokens")
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    try:
        at = [F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_h")] if stored_order else []
        rows = docs.select(*kept, n, *at)
    except AnalysisException:  # not read from files
        at = []
    if not at:
        rows = docs.select(*kept, n, F.lit("").alias("_f"), F.xxhash64(row_id(docs)).alias("_h"))
    rows = materialize(rows, "lengths")
    bins = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    columns = [bins[c].to_numpy().astype(np.int64) for c in ("n_tokens", "n")]
    bounds = best_bounds(*columns, buckets) if len(bins) else [0]
    slices = max(1, -(-int(columns[1].sum()) // SLICE_ROWS))
    slice_of = F.struct("_f", F.expr(f"_h div {SLICE_ROWS}") if at else F.pmod("_h", F.lit(slices)))
    bound_list = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = rows.withColumn("_bounds", bound_list).withColumn("bucket", F.expr("size(filter(_bounds, b -> b < n_tokens))"))
    rows = rows.withColumn("bound", F.expr("_bounds[bucket]")).drop("_bounds").withColumn("_one", F.lit(1).cast("long")).withColumn("_slice", slice_of)
    placed = running_sum(rows, ["bucket"], "_slice", ["_h", *[f"_k{i}" for i in range(len(keep))], "n_tokens"], "_one", "_row")
    size = F.expr(f"greatest(1, {budget} div greatest(bound, 1))")
    placed = placed.withColumn("_size", size)
    return placed.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "bucket", "bound",
        F.expr("_row div _size").alias("batch"), F.expr("_row % _size").alias("place"), F.expr("bound - n_tokens").alias("padding"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
