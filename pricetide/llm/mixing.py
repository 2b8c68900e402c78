"""Mixing sources to target weights by Pfair scheduling.

A source's documents form a stream of blocks of BLOCK_BYTES. In a period of T slots, T the sum of the weights, which are whole
numbers, a source of weight w runs w blocks: block q of the period is released at its slot floor(q T / w) and due by its slot
ceil((q + 1) T / w); one block runs in each slot, the released one of earliest deadline. So at no time is a source a whole
block away from its share. Blocks of sources of one weight have the same windows, so the schedule is worked out for weights,
of which there are few (their sum over sources is T), and a source takes its own place among those of its weight: any number
of sources is scheduled, none apart from the others.
When a source ends, its slots are left out, from the middle of a period on, and the others go on in the proportion of their
weights. A new phase, with a schedule of the sources that are left, begins with the period after sources of a small part of
the weight have ended (see ``phases``). Every block has a moment in this order; slots number the moments that have a block.
No document is left out or repeated.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import ROW, materialize, numbered, row_id, running_sum

BLOCK_BYTES = 1 << 18
#: Slots of a period, at least, and for each source (for weights made from sizes); power of a source's size that makes its weight.
PERIOD, SLOTS_EACH, POWER = 1000, 4, 0.7
#: Slots of a period of given weights at most (about): beyond it they are rounded to that many.
LONGEST = 100_000
#: The slots (about) worked out for all phases; beyond it, the least part of the weight that ends before a new phase is.
STEPS, ENDED = 5_000_000, 1 / 256
#: Documents, blocks or sources that one window sorts (about); blocks of a source that are listed at once.
SLICE_ROWS, LISTED = 10_000, 4096


def whole_numbers(shares: np.ndarray, counts: np.ndarray, period: int) -> np.ndarray:
    """Whole numbers of at least 1 in proportion to ``shares``, each of which ``counts`` sources have: about ``period`` in all, largest remainders round up."""
    exact = shares * (period / float(shares @ counts))
    down = np.maximum(1, np.floor(exact)).astype(np.int64)
    spare = period - int(down @ counts)
    for k in np.argsort(-(exact - np.floor(exact)), kind="stable"):
        if counts[k] <= spare and exact[k] >= 1:
            down[k] += 1
            spare -= int(counts[k])
    return down


def whole_given(shares: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Given weights as whole numbers in the same proportion: exact where their period is LONGEST slots at most, else rounded to it."""
    if (shares == np.floor(shares)).all():
        whole = [int(x) for x in shares]
        common = math.gcd(*whole)
        if sum(w // common * int(c) for w, c in zip(whole, counts, strict=True)) <= LONGEST:
            return np.array([w // common for w in whole], np.int64)
    for slots in (PERIOD // 10, PERIOD):  # decimal shares such as 0.3 and 0.7 come out exact
        rounded = whole_numbers(shares, counts, slots)
        if np.allclose(rounded * float(shares @ counts), shares * float(rounded @ counts), rtol=1e-9, atol=0):
            return rounded // math.gcd(*rounded.tolist())
    return whole_numbers(shares, counts, max(LONGEST, SLOTS_EACH * int(counts.sum())))


def scheduled(shares: dict) -> dict:
    """``whole_given`` for weights by source."""
    return dict(zip(shares, whole_given(np.array(list(shares.values()), float), np.ones(len(shares), np.int64)).tolist(), strict=True))


class Kind(NamedTuple):
    """``m`` sources of weight w that run c blocks in a period, w but for those that end in it; ``before``: sources of that weight with more blocks."""

    w: int
    c: int
    m: int
    before: int


def windows(kinds: list[Kind]) -> list[tuple[list[int], list[int]]]:
    """For each kind the slots from which and by which its blocks of one period run.

    After the part v of a period a source has done w v of its blocks, c at most. Block q is the work from v = q / w to
    (q + 1) / w; its window is the slots that all sources' work together takes meanwhile.
    """
    ending = sorted((k for k in kinds if k.c < k.w), key=lambda k: k.c / k.w)
    out = []
    for w, c, _, _ in kinds:
        rate, done, at, low, high = sum(k.w * k.m for k in kinds), 0, 0, [], []
        for q in range(c + 1):  # all work by v = q / w is (rate q + done w) / w
            while at < len(ending) and ending[at].c * w <= q * ending[at].w:
                rate, done, at = rate - ending[at].w * ending[at].m, done + ending[at].c * ending[at].m, at + 1
            work = rate * q + done * w
            low.append(work // w)
            high.append(-(-work // w))
        out.append((low[:c], high[1:]))
    return out


def kind_slots(kinds: list[Kind]) -> list[tuple[list[int], list[int], list[int]]]:
    """For each kind its blocks' slots in one period, and the slots from which and by which they run: earliest deadline first.

    With m sources of a kind, entries q m to q m + m - 1 are of their blocks q.
    """
    spans = windows(kinds)
    waiting = [(spans[k][0][0], spans[k][1][0], k, 0) for k in range(len(kinds))]
    heapq.heapify(waiting)
    ready: list[list[int]] = []
    out: list[list[int]] = [[] for _ in kinds]
    for t in range(sum(k.c * k.m for k in kinds)):
        while waiting and waiting[0][0] <= t:
            _, due, k, q = heapq.heappop(waiting)
            heapq.heappush(ready, [due, k, q, kinds[k].m])
        _, k, q, _ = first = ready[0]
        out[k].append(t)
        first[3] -= 1
        if not first[3]:
            heapq.heappop(ready)
            if q + 1 < kinds[k].c:
                heapq.heappush(waiting, (spans[k][0][q + 1], spans[k][1][q + 1], k, q + 1))
    return [(slots, *span) for slots, span in zip(out, spans, strict=True)]


def period(weights: dict) -> dict:
    """source -> the slots of one period in which its blocks run."""
    by: dict[int, list] = {}
    for s in sorted(weights, key=str):
        by.setdefault(weights[s], []).append(s)
    found = kind_slots([Kind(w, w, len(own), 0) for w, own in by.items()])
    return {s: slots[r :: len(own)] for own, (slots, _, _) in zip(by.values(), found, strict=True) for r, s in enumerate(own)}


class Phase(NamedTuple):
    """Periods ``first`` to ``end`` (not in it) of ``slots`` moments each, from moment ``start`` on, and the kinds of sources in them.

    If it is ``shared``, sources that end in it count as going on; their moments are left out.
    """

    first: int
    end: int
    start: int
    slots: int
    shared: bool
    kinds: list[Kind]


def phases(weights: np.ndarray, blocks: np.ndarray, counts: np.ndarray) -> list[Phase]:
    """The phases of ``counts`` sources of each weight and number of blocks.

    Each period in which sources end is a phase, and so are the periods between. If the slots of all of them were more than
    STEPS, a phase goes on until sources of ENDED of its weight have ended, or of twice that and so on: the work is bounded.
    """
    lasts = -(-blocks // weights)
    order = np.argsort(lasts, kind="stable")
    weights, blocks, counts, lasts = weights[order], blocks[order], counts[order], lasts[order]
    ended = np.concatenate([[0], np.cumsum(weights * counts)])
    bounds = np.unique(np.concatenate([[0], blocks // weights, lasts])) if len(lasts) else np.zeros(1, np.int64)
    left = ended[-1] - ended[np.searchsorted(lasts, bounds, side="right")]  # the weight that goes on from each bound
    chosen, part = list(range(len(bounds))), ENDED
    while len(chosen) > 2 and left[chosen].sum() > STEPS:
        chosen, part = [0], part * 2
        while chosen[-1] < len(bounds) - 1:
            k = int(np.searchsorted(-left, -left[chosen[-1]] * (1 - min(part, 1.0)), side="left"))
            chosen.append(min(len(bounds) - 1, max(chosen[-1] + 1, k)))
    out, start = [], 0
    for x, y in zip(bounds[chosen].tolist(), bounds[chosen[1:]].tolist(), strict=False):
        at = int(np.searchsorted(lasts, x, side="right"))
        w, b, n = weights[at:], blocks[at:], counts[at:]
        shared = y > x + 1 and bool((b < y * w).any())
        c = w if shared else np.minimum(w, b - x * w)
        found: dict[tuple[int, int], int] = {}
        for one, few, m in zip(w.tolist(), c.tolist(), n.tolist(), strict=True):
            found[one, few] = found.get((one, few), 0) + m
        kinds, before = [], {}
        for one, few in sorted(found, reverse=True):  # of one weight, those that run more blocks have more of them
            kinds.append(Kind(one, few, found[one, few], before.get(one, 0)))
            before[one] = before.get(one, 0) + found[one, few]
        slots = sum(k.c * k.m for k in kinds)
        out.append(Phase(x, y, start, slots, shared, kinds))
        start += (y - x) * slots
    return out


def _before(rows: DataFrame, total: int, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over those before each in its group: by ranges where there are many, so that no group is sorted in one task."""
    if total <= SLICE_ROWS:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    ranged = rows.repartitionByRange(-(-total // SLICE_ROWS), *group, *order).withColumn("_part", F.spark_partition_id())
    return running_sum(materialize(ranged, "ranged"), group, "_part", order, value, out).drop("_part")


def _moments(sizes: DataFrame, plan: list[Phase], n_sources: int) -> DataFrame:
    """_source, block, at, from and due: when each block of each source runs, is released and is due, ended sources' moments not left out."""
    spark = sizes.sparkSession
    told = [(k, p.first, p.end, p.start, p.slots, p.shared) for k, p in enumerate(plan)]
    table = spark.createDataFrame(told, "phase int, first long, end long, start long, slots long, shared boolean")  # STEPS rows at most (see phases)
    entries = materialize(_entries(spark, plan), "entries")
    own = sizes.select("_source", "weight", "blocks", F.xxhash64("_source").alias("_h"), F.lit(1).alias("_one"))
    own = _before(own, n_sources, ["weight"], [F.desc("blocks"), "_h", "_source"], "_one", "rank")
    some = own.select("_source", "weight", "blocks", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {LISTED}"))).alias("_c"))
    each = some.select("_source", "weight", "blocks", "rank", F.explode(F.sequence(F.expr(f"_c * {LISTED}"), F.expr(f"least(blocks, (_c + 1) * {LISTED}) - 1"))).alias("block"))
    each = each.withColumns({"p": F.expr("block div weight"), "q": F.expr("block % weight")})
    each = each.join(F.broadcast(table), (F.col("p") >= F.col("first")) & (F.col("p") < F.col("end")))
    each = each.withColumn("c", F.expr("if(shared, weight, least(weight, blocks - p * weight))"))
    each = each.join(entries.select("phase", "weight", "c", "m", "before"), ["phase", "weight", "c"]).withColumn("j", F.expr("cast(q * m + rank - before as int)"))
    spread = entries.select("phase", "weight", "c", "m", "low", "high", F.posexplode("at").alias("j", "slot"))
    spread = spread.select("phase", "weight", "c", "j", "slot", F.expr("low[cast(j div m as int)]").alias("low"), F.expr("high[cast(j div m as int)]").alias("high"))
    each = each.join(spread, ["phase", "weight", "c", "j"]).withColumn("base", F.expr("start + (p - first) * slots"))
    return each.selectExpr("_source", "block", "base + slot as at", "base + low as from", "base + high as due")


def _entries(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """phase, weight, c, m, before and the slots of each kind: about STEPS numbers in all."""
    rows: dict[str, list] = {name: [] for name in ("phase", "weight", "c", "m", "before", "at", "low", "high")}
    for n, p in enumerate(plan):
        for k, found in zip(p.kinds, kind_slots(p.kinds), strict=True):
            for name, value in zip(rows, (n, *k, *found), strict=True):
                rows[name].append(value)
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3]
    return spark.createDataFrame(pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows)))


def _slots(moments: DataFrame, total: int) -> DataFrame:
    """_s, _b, slot, release, deadline: moments as numbers of blocks that run before them."""
    kinds = F.array(*[F.struct(F.col(c).alias("t"), F.lit(k).alias("kind")) for k, c in enumerate(("from", "due", "at"))])
    points = moments.select("_source", "block", F.explode(kinds).alias("e")).select("_source", "block", "e.t", "e.kind", (F.col("e.kind") == 2).cast("int").alias("_run"))
    counted = _before(points, 3 * total, [], ["t", "kind", "_source", "block"], "_run", "_at")
    one = lambda k, name: F.max(F.when(F.col("kind") == k, F.col("_at"))).alias(name)
    return counted.groupBy(F.col("_source").alias("_s"), F.col("block").alias("_b")).agg(one(0, "release"), one(1, "deadline"), one(2, "slot"))


def mix(docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Every row's ``keep`` columns (default doc_id, source) with n_bytes, block, release, deadline and slot.

    ``weights`` are numbers over 0 by source, whole or not; others are refused with a ValueError. Without them a source weighs
    the POWER of its bytes. A source without a given weight weighs as the least given one. Null is a source of its own. Null
    and empty texts have 0 bytes and fall in the block of the row before.
    A text longer than a block fills the blocks it covers and stands in the first. Ties and repeated rows each have their own
    place. Of the sources the driver sees how many there are of each weight and number of blocks. An empty table gives an empty
    result.
    """
    if weights is not None and (not weights or not all(w is not None and math.isfinite(w) and w > 0 for w in weights.values())):
        raise ValueError(f"target weights are finite numbers over 0, one source at least: {weights}")
    keep = keep or ["doc_id", "source"]
    sized = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("source").alias("_source"), F.xxhash64(row_id(docs)).alias("_h"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    sized = materialize(sized, "sized")
    spark = docs.sparkSession
    sizes = sized.groupBy("_source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_bytes").alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("share", F.pow(F.greatest(F.lit(1), "bytes"), F.lit(POWER)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_g string, share double")
        sizes = sizes.join(given, F.col("_source").eqNullSafe(F.col("_g")), "left").drop("_g").withColumn("share", F.coalesce("share", F.lit(float(min(weights.values())))))
    sizes = materialize(sizes.withColumn("blocks", F.greatest(F.lit(1), F.expr(f"(bytes + {block_bytes - 1}) div {block_bytes}"))), "sources")
    kinds = sizes.groupBy("share", "blocks").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).orderBy("share", "blocks").toArrow()
    share, blocks, counts = (kinds[c].to_numpy() for c in ("share", "blocks", "n"))
    values, at = np.unique(share, return_inverse=True)
    sources = np.bincount(at, counts, len(values)).astype(np.int64)
    n_sources, n_blocks, n_rows = int(counts.sum()), int(blocks @ counts), int(kinds["rows"].to_numpy().sum())
    if not len(values):
        whole = np.zeros(0, np.int64)
    elif weights is None:
        whole = whole_numbers(values, sources, max(PERIOD, SLOTS_EACH * n_sources))
    else:
        whole = whole_given(values, sources)
    known = spark.createDataFrame(list(zip(values.tolist(), whole.tolist(), strict=True)), "share double, weight long")
    plan = phases(whole[at], blocks, counts)
    slots = materialize(_slots(_moments(sizes.join(known, "share"), plan, n_sources), n_blocks), "slots")
    n = max(1, -(-n_rows // SLICE_ROWS))
    sliced = sized.withColumn("_slice", F.pmod("_h", F.lit(n)))
    placed = running_sum(sliced, ["_source"], "_slice", ["_h", *[f"_k{i}" for i in range(len(keep))], "n_bytes"], "n_bytes", "_start")
    ends = sizes.select(F.col("_source").alias("_e"), (F.col("blocks") - 1).alias("_last"))
    placed = placed.join(ends, F.col("_source").eqNullSafe(F.col("_e"))).withColumn("block", F.least(F.expr(f"_start div {block_bytes}"), "_last"))
    found = placed.join(slots, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "block", "release", "deadline", "slot")


def mixed_order(docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of ``docs`` in the order of their slots: written, part files follow one another in that order."""
    slots = mix(numbered(docs), weights, block_bytes, [ROW]).select(ROW, F.col("slot").alias(f"{ROW}_slot"))
    placed = numbered(docs).join(materialize(slots, "slots"), ROW)
    order = [f"{ROW}_slot", ROW]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
