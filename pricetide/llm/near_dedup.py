"""MinHash near-duplicates by a signature-coordinate inverted join.

Each document is posted under its (coordinate, value) pairs. Pairs at the similarity asked for collide in at least MATCHES of
COORDINATES coordinates (all but 2 in 10^8 of them at a similarity of exactly 0.8), so a document with fewer than MATCHES
postings that any other document shares has no partner, and of the s it shares, only the s - MATCHES + 1 rarest are needed:
two documents that collide often enough meet under one of those (prefix filter over a global order of rarity). For documents
that meet, the collisions of the whole signatures are counted, a stretch of coordinates at a time; a pair that can no longer
reach MATCHES is skipped. Pairs that reach it are confirmed on the full shingle sets.

Documents with one word sequence are represented by one of them. Within a list, every member is first compared with the list's
most typical one of about its size (the one whose postings most documents share). Then only members of lists that are still
in different components are compared, inside tasks: a list's members are packed in blocks with their signatures, and only
pairs that reach MATCHES and whose sets can be similar enough leave the task: a bitmap of each set tells how many shingles at
least the other one lacks, so this bound loses nothing. Of these, one for each two components comes first and the others
follow if it fails.
A group of thousands of near copies so costs rows in proportion to its members, not to its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import ROW, keep_rows, materialize, row_id, without
from pricetide.llm.shingles import _odd, distinct, groups, sequence_key

COORDINATES, MATCHES = 64, 32
#: Members of a block, coordinates compared before pairs are skipped, pairs compared at once, bits of a set's bitmap.
BLOCK, STRIDE, AT_ONCE, BITS = 256, 16, 1 << 16, 2048
_TURNS = _odd(COORDINATES)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """uid, doc_id, n (distinct shingles), seq (digest of the word sequence), sig (COORDINATES ints; empty if n is 0)."""

    def tasks(batches):
        for b in batches:
            sigs, ns = [], []
            for _, words, counts in groups(b.column(2)):
                hashes, sizes = distinct(words, counts, width)
                some = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[some]
                sig = np.empty((len(starts), COORDINATES), np.uint64)
                for k in range(COORDINATES if len(starts) else 0):
                    sig[:, k] = np.minimum.reduceat(hashes * _TURNS[k], starts)
                sigs.append((sig >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel())
                ns.append(sizes)
            n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
            values = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * COORDINATES)]), pa.int32()), values)
            seq = pa.array([sequence_key(t.as_py()) for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), seq, lists], ["uid", "doc_id", "n", "seq", "sig"])

    rows = docs.select(row_id(docs).alias("uid"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tasks, "uid long, doc_id long, n long, seq binary, sig array<int>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int) -> DataFrame:
    """uid, the distinct shingle hashes of the wanted documents' whole texts, and bits: which of BITS places they fall on."""

    def tasks(batches):
        for b in batches:
            for row, words, counts in groups(b.column(1)):
                hashes, sizes = distinct(words, counts, width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes.view(np.int64)))
                places = np.zeros((len(counts), BITS), bool)
                places[np.repeat(np.arange(len(counts)), sizes), (hashes >> np.uint64(20)) % np.uint64(BITS)] = True
                bits = pa.array([row_.tobytes() for row_ in np.packbits(places, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(counts)), lists, bits], ["uid", "hashes", "bits"])

    rows = docs.select(row_id(docs).alias("uid"), "text")
    return keep_rows(rows, wanted, "left_semi", n_wanted, "uid").select("uid", "text").mapInArrow(tasks, "uid long, hashes array<long>, bits binary")


def prefixes(reps: DataFrame, matches: int) -> DataFrame:
    """uid, n, pop, key: the postings under which two documents that agree often enough are sure to meet.

    ``pop`` adds up how many documents share each of the document's postings.
    """
    posted = reps.select("uid", "n", F.posexplode("sig").alias("c", "v"))
    posted = posted.select("uid", "n", F.expr("shiftleft(cast(c as long), 32) | (v & 4294967295L)").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    met = posted.join(shared.hint("shuffle_hash"), "key")
    own = Window.partitionBy("uid")
    met = met.withColumn("s", F.count(F.lit(1)).over(own)).withColumn("pop", F.sum("f").over(own)).where(F.col("s") >= matches)
    rank = F.row_number().over(own.orderBy("f", "key"))
    return met.withColumn("r", rank).where(F.col("r") <= F.col("s") - matches + 1).select("uid", "n", "pop", "key")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("uid").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("uid").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.expr(f"100L * i >= {percent}L * (size(ha) + size(hb) - i)")).select("a", "b")


def _sum(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """uid -> root (the smallest uid of its component) for every node of ``edges`` (a, b), by large-star and small-star steps.

    Each step is a two-phase aggregate and a join, written to shared storage; the number of steps grows with the logarithm of
    the size of the largest component.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        ways = edges.select("a", "b").union(edges.select("b", "a"))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = ways.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        edges = materialize(small.where("a <> b").distinct(), "stars")
        after = _sum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("uid"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("uid"), F.col("b").alias("root")).union(roots)


def collisions(left: np.ndarray, right: np.ndarray, matches: int) -> np.ndarray:
    """How many coordinates collide, row by row; -1 where it is less than ``matches``.

    After each stretch of coordinates the rows that can't reach ``matches`` with all that are left are skipped.
    """
    out, alive, counts = np.full(len(left), -1), np.arange(len(left)), np.zeros(len(left), np.int64)
    for at in range(0, COORDINATES, STRIDE):
        counts = counts + (left[alive, at : at + STRIDE] == right[alive, at : at + STRIDE]).sum(1)
        may = counts + COORDINATES - min(at + STRIDE, COORDINATES) >= matches
        alive, counts = alive[may], counts[may]
    out[alive] = counts
    return out


def collided(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) with ``matches`` collisions or more."""
    left, right = (reps.select(F.col("uid").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.join(left, "a").join(right, "b").where(same >= matches).select("a", "b")


class _Members:
    """The columns of packed members."""

    def __init__(self, packed: pa.StructArray):
        self.uid, self.root, self.n, self.open = (packed.field(c).to_numpy(zero_copy_only=False) for c in ("uid", "root", "n", "open"))
        self.sig = packed.field("sig").flatten().to_numpy().reshape(-1, COORDINATES)
        self.bits = np.frombuffer(b"".join(packed.field("bits").to_pylist()), np.uint64).reshape(len(self.uid), BITS // 64)


def _reach(left: _Members, right: _Members, i: np.ndarray, j: np.ndarray, percent: int, matches: int):
    """(a, b, root of a, root of b, collisions) of the pairs of rows i, j that are in two components, near in size, collide often enough, and can be similar enough."""
    n, m = left.n[i], right.n[j]
    fine = (left.root[i] != right.root[j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    i, j = i[fine], j[fine]
    count = collisions(left.sig[i], right.sig[j], matches)
    i, j, count = i[count >= 0], j[count >= 0], count[count >= 0]
    lack = [np.bitwise_count(x & ~y).sum(1, dtype=np.int64) for x, y in ((left.bits[i], right.bits[j]), (right.bits[j], left.bits[i]))]
    common = np.minimum(left.n[i] - lack[0], right.n[j] - lack[1])  # at most
    may = 100 * common >= percent * (left.n[i] + right.n[j] - common)
    i, j, count = i[may], j[may], count[may]
    turn = left.root[i] > right.root[j]
    ends = [np.where(turn, y, x) for x, y in ((left.uid[i], right.uid[j]), (right.uid[j], left.uid[i]), (left.root[i], right.root[j]), (right.root[j], left.root[i]))]
    return [*ends, count]


def _one_for_two(found: list[np.ndarray]) -> list[np.ndarray]:
    """For each two components the pair that collides most."""
    order = np.lexsort((found[1], found[0], -found[4], found[3], found[2]))
    found = [x[order] for x in found]
    first = np.r_[True, (found[2][1:] != found[2][:-1]) | (found[3][1:] != found[3][:-1])][: len(order)]
    return [x[first] for x in found]


def met(lists: DataFrame, roots: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, matches: int, one_for_two: bool) -> DataFrame:
    """a, b, ra, rb, c: pairs under one key in two components that collide ``matches`` times or more and can be linked; with ``one_for_two`` at least one for each two components of a task.

    Lists inside one component are left alone. Of a list of more than BLOCK members, those outside its largest component
    meet all of them, block by block.
    """
    placed = lists.select("key", "uid", "n").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    placed = materialize(placed, "placed")
    by_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    sizes = by_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("roots"))
    sizes = sizes.where("roots > 1").select("key", F.col("top.root").alias("top"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    sizes = materialize(sizes, "mixed")  # a table of its own, so that the join can split a hot list's rows
    members = placed.join(sizes, "key").withColumn("block", F.expr("pmod(xxhash64(uid), blocks)")).withColumn("open", F.col("root") != F.col("top"))
    members = members.join(reps.select("uid", "sig"), "uid").join(sets.select("uid", "bits"), "uid")
    members = members.select("key", "block", "blocks", "open", F.struct("uid", "root", "n", "open", "sig", "bits").alias("m"))
    members = materialize(members, "members")
    packed = members.groupBy("key", "block", "blocks").agg(F.collect_list("m").alias("right"))  # about BLOCK members, by hash
    asked = members.where("open and blocks > 1").groupBy("key", F.col("block").alias("own"), "blocks").agg(F.collect_list("m").alias("left"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    names = ["a", "b", "ra", "rb", "c"]

    def said(found: list[np.ndarray]) -> pa.RecordBatch:
        found = _one_for_two(found) if one_for_two else found
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names)

    def within(batches):
        for b in batches:
            own, ends = _Members(b.column(0).flatten()), b.column(0).offsets.to_numpy() - b.column(0).offsets[0].as_py()
            size = np.diff(ends)
            later = np.repeat(ends[1:], size) - np.arange(len(own.uid)) - 1  # members after each in its list
            until, at = np.cumsum(later), 0
            while at < len(later):
                to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + AT_ONCE, "right")))
                i = np.repeat(np.arange(at, to), later[at:to])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
                yield said(_reach(own, own, i, j, percent, matches))
                at = to

    def across(batches):
        for b in batches:
            for r in range(b.num_rows):
                left, right = _Members(b.column(0)[r].values), _Members(b.column(1)[r].values)
                i, j = (x.ravel() for x in np.indices((len(left.uid), len(right.uid))))
                once = ~right.open[j] | (left.uid[i] < right.uid[j])
                yield said(_reach(left, right, i[once], j[once], percent, matches))

    schema = ", ".join(f"{c} long" for c in names)
    short = packed.where("blocks = 1").select("right").mapInArrow(within, schema)
    return short.unionByName(asked.join(packed, ["key", "block", "blocks"]).select("left", "right").mapInArrow(across, schema))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (uid, root) after ``links`` (ra, rb) between roots; a document alone is its own root."""
    found = materialize(components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "joined")
    moved = found.select(F.col("uid").alias("_old"), F.col("root").alias("_new"))
    old = roots.join(moved, F.col("root") == F.col("_old"), "left").select("uid", F.coalesce("_new", "root").alias("root"))
    return materialize(old.unionByName(found.join(roots.select("uid"), "uid", "left_anti")), "roots")


def linked(docs: DataFrame, reps: DataFrame, width: int, percent: int, matches: int) -> DataFrame:
    """uid -> root over representatives."""
    lists = materialize(prefixes(reps, matches), "prefixes")
    wanted = materialize(lists.select("uid").distinct(), "wanted")
    sets = materialize(shingle_sets(docs, wanted, wanted.count(), width), "sets")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    first = lists.withColumn("size", size)
    pivots = first.groupBy("key", "size").agg(F.max(F.struct("pop", "uid")).alias("p")).select("key", "size", F.col("p.uid").alias("a"))
    stars = first.join(materialize(pivots, "pivots"), ["key", "size"]).where("uid <> a").select(F.least("a", "uid").alias("a"), F.greatest("a", "uid").alias("b")).distinct()
    tested = materialize(collided(stars, reps, matches), "stars")
    roots = materialize(components(confirmed(tested, sets, percent)), "roots")
    for one_for_two in (True, False):
        pairs = met(lists, roots, reps, sets, percent, matches, one_for_two)
        if one_for_two:
            pairs = pairs.groupBy("ra", "rb").agg(F.max(F.struct("c", "a", "b")).alias("m")).select("ra", "rb", "m.a", "m.b")
        else:
            pairs = pairs.select("ra", "rb", "a", "b").distinct()
        pairs = pairs.select("ra", "rb", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        links = confirmed(pairs.select("a", "b"), sets, percent).join(pairs, ["a", "b"]).select("ra", "rb").distinct()
        roots = joined(roots, links)
        tested = tested.unionByName(pairs.select("a", "b"))
    return roots


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, matches: int = MATCHES, with_uid: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept.

    A document with fewer words than ``width`` has its whole sequence as its one shingle; one without words (null, empty,
    blank) has none and is linked with nothing. Rows that repeat are linked; of rows that repeat the smallest doc_id too,
    exactly one is kept. Null doc_ids sort after all others. ``docs`` is a stored table: it is read twice. An empty table
    gives an empty result; other columns are not read.
    """
    rows = materialize(sketch(docs, width), "sketch")
    first = rows.where("n > 0").groupBy("seq").agg(F.min(F.struct("uid", "n", "sig")).alias("m"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(first.select("m.*", "seq", "copies"), "representatives")
    roots = materialize(linked(docs, reps.select("uid", "n", "sig"), width, percent, matches), "components")
    joined = reps.select("uid", "seq", "copies").join(roots, "uid", "left").where("copies > 1 or root is not null")
    joined = joined.select("seq", F.coalesce("root", "uid").alias("root"))
    placed = rows.select("uid", "doc_id", "n", "seq").join(joined, "seq", "left")
    placed = materialize(placed.select("uid", "doc_id", "n", "root"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    grouped, alone = placed.where("root is not null"), placed.where("root is null")
    least = materialize(grouped.groupBy("root").agg(F.min(order).alias("m")), "least")
    m_type = least.schema["m"].dataType
    whole = grouped.join(least, "root").unionByName(alone.withColumn("m", F.lit(None).cast(m_type)))
    return whole.select(
        *(["uid"] if with_uid else []),
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("m").isNull(), F.col("doc_id")).otherwise(F.col("m.doc_id")).alias("component_id"),
        (F.col("m").isNull() | (F.col("m.uid") == F.col("uid"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, all others as they are, with the columns of ``docs``."""
    groups_of = near_groups(docs, width, percent, with_uid=True)
    return without(docs, materialize(groups_of.where("not kept").select(F.col("uid").alias(ROW)), "near-copies"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
