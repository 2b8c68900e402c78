"""Ranked lexical search: MaxScore over blocks of documents, with bounds from stored pair lists.

Documents are cut in blocks of at most BLOCK. A block keeps, for each term that the items ask for, the list of its documents
with how often it stands there, from which follow their impacts (what the term adds to a score) and the largest impact; for
chosen pairs of an item's terms it also keeps the largest joint impact and, where it is short, the list of documents that hold
both. A search of a block first sets aside terms whose
bounds together stay below the k-th best score so far. Terms that are set aside as a pair count by their joint maximum, never
more than the sum of the two and often much less, or, where even that is too much, by the larger of the two while their
common documents are scored as candidates. Only documents in the lists of the other terms, and those common ones, are scored.
All bounds are exact integers, so no document that belongs to the result is skipped.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import materialize, row_id

#: Documents of a block, term occurrences that close a block early, bytes of item texts searched at once (about).
BLOCK, OCCURRENCES, ROUND_BYTES = 16_384, 8_000_000, 16 << 20
#: An item's terms, most frequent first, are paired with so many that follow; a pair's list is short under 1 / SHORT of its terms' lists.
PARTNERS, SHORT = 4, 4
#: Weight and impact, fixed values of the score.
SATURATION, LENGTH_SHARE, TF_SCALE = 20, 50, 1_000_000_000

_capitals = bytes(range(0x41, 0x5B))
_breaks = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_folded = bytes.maketrans(_breaks + _capitals, b" " * len(_breaks) + _capitals.lower())


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and all characters beyond ASCII of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_folded).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    return _bytes(x, np.min_scalar_type(int(x.max(initial=0))).newbyteorder("<"))


def _wide(raw, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_narrow``."""
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else "<u1").astype(np.int64)


def _rows(batches):
    """Rows one after another, their binary values where Arrow has them: no list of a whole batch."""
    for b in batches:
        for i in range(b.num_rows):
            values = [c[i] for c in b.columns]
            yield {name: v.as_buffer() if pa.types.is_binary(v.type) else v.values.to_numpy() for name, v in zip(b.schema.names, values, strict=True)}


BLOCKS = "n_docs long, n_terms long, terms array<int>, counts array<int>, docs binary, nulls binary, lengths binary, at binary, tf binary"


def _postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """A row for each block: how many documents and terms it has, and the lists of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of about ROUND_BYTES of texts

    def closed(docs_, nulls, lengths, found, sizes, total):
        hits = np.concatenate(found) if found else np.zeros((0, 2), np.int32)
        key = hits[:, 0].astype(np.int64) * BLOCK + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(key)
        key, tf = key[order], hits[order, 1]
        names, counts = np.unique(key // BLOCK, return_counts=True)
        row = [*total, names.astype(np.int32), counts.astype(np.int32), _bytes(np.array(docs_, np.int64), "<i8"), bytes(nulls)]
        row += [_bytes(np.array(lengths, np.int64), "<i8"), _bytes(key % BLOCK, "<u2"), _narrow(tf)]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    def tasks(batches):
        number = {t: i for i, t in enumerate(shared.value)}.get
        empty = lambda: ([], [], [], [], [], [0, 0])
        block, held = empty(), 0
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                often = Counter(words)
                hits = np.array([[number(t, -1) for t in often], list(often.values())], np.int32).T
                hits = hits[hits[:, 0] >= 0]
                block[5][0] += 1
                block[5][1] += len(words)
                if len(hits):
                    doc = doc.as_py()
                    for part, value in zip(block, (doc or 0, doc is None, len(words), hits, len(hits)), strict=False):
                        part.append(value)
                    held += int(hits[:, 1].sum())
                if len(block[0]) == BLOCK or held >= OCCURRENCES:
                    yield closed(*block)
                    block, held = empty(), 0
        if block[5][0]:
            yield closed(*block)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tasks, BLOCKS)


class Block:
    """Lists, impacts and pair lists of one block, by term number."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, at: np.ndarray, impact: np.ndarray, docs: np.ndarray, nulls: np.ndarray):
        self.row = {int(t): i for i, t in enumerate(names)}
        self.ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.at, self.impact, self.docs, self.nulls = at, impact, docs, nulls
        self.largest = np.maximum.reduceat(impact, self.ends[:-1]) if len(names) else np.zeros(0, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, np.ndarray | None]] = {}
        self.sums = np.zeros(len(docs), np.int64)
        self.read = 0

    def span(self, row: int) -> slice:
        return slice(self.ends[row], self.ends[row + 1])

    def common(self, a: int, b: int) -> tuple[int, np.ndarray]:
        """The largest joint impact of two terms (0 if no document holds both) and the documents that hold both."""
        one, two = self.span(self.row[a]), self.span(self.row[b])
        if one.stop - one.start > two.stop - two.start:
            one, two = two, one
        place = np.searchsorted(self.at[two], self.at[one])
        place[place == two.stop - two.start] = 0
        both = self.at[two][place] == self.at[one]
        joint = self.impact[one][both] + self.impact[two][place[both]]
        return int(joint.max(initial=0)), self.at[one][both]

    def add_pairs(self, pairs) -> None:
        for a, b in pairs:
            if a in self.row and b in self.row:
                joint, both = self.common(a, b)
                held = sum(self.ends[self.row[t] + 1] - self.ends[self.row[t]] for t in (a, b))
                self.pairs[a, b] = joint, both if SHORT * len(both) < held else None  # a longer one saves nothing over the terms' own

    def surely(self, present: list[int], k: int) -> int:
        """A score that k documents of the block reach at least: the k-th largest impact of one of the terms."""
        best = 0
        for r in present:
            if self.ends[r + 1] - self.ends[r] >= k:
                one = self.impact[self.span(r)]
                best = max(best, int(np.partition(one, len(one) - k)[len(one) - k]))
        return best

    def units(self, item: list[int], pairs: list[tuple[int, int]]):
        """The item's terms of this block as disjoint pairs, those of largest saving first, and single terms."""
        largest, free, out = self.largest, {t: self.row[t] for t in item if t in self.row}, []
        saving = []
        for p in pairs:
            if p in self.pairs:
                a, b = int(largest[self.row[p[0]]]), int(largest[self.row[p[1]]])
                top = max(self.pairs[p][0], a, b)
                if top < a + b:
                    saving.append((top - a - b, p, top, max(a, b)))
        for _, (a, b), joint, larger in sorted(saving):
            if a in free and b in free:
                rows = (free.pop(a), free.pop(b))
                out.append((joint, larger, rows, self.pairs[a, b][1]))
        return out + [(int(largest[r]), int(largest[r]), (r,), None) for r in free.values()]

    def search(self, item: list[int], pairs: list[tuple[int, int]], least: int, k: int):
        """(scores, places) of all documents that can be among the k best of this block and score ``least`` or more."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        units = self.units(item, pairs)
        least = max(least, 1, self.surely([r for u in units for r in u[2]], k))
        length = lambda u: int(sum(self.ends[r + 1] - self.ends[r] for r in u[2]))
        units.sort(key=lambda u: u[0] / max(1, length(u)))
        aside, asked, candidates, bound = [], [], [], 0
        for u in units:
            joint, larger, rows, both = u
            if bound + joint < least:
                bound += joint
                aside.append(u)
            elif both is not None and bound + larger < least:
                bound += larger
                aside.append(u)
                candidates.append(both)
            else:
                asked += rows
        if not asked and not candidates:
            return none
        sums = self.sums
        for r in asked:
            s = self.span(r)
            sums[self.at[s]] += self.impact[s]
            self.read += s.stop - s.start
        spans = [self.at[self.span(r)] for r in asked] + candidates
        few = np.unique(np.concatenate(spans)) if len(spans) > 1 else spans[0]
        scores = sums[few]
        for x in spans:
            sums[x] = 0
        rest = sum(u[0] for u in aside)
        for joint, _, rows, _ in sorted(aside, key=lambda u: -u[0]):
            alive = scores + rest >= least
            few, scores = few[alive], scores[alive]
            if not len(few):
                return none
            for r in rows:
                s = self.span(r)
                place = np.searchsorted(self.at[s], few)
                place[place == s.stop - s.start] = 0
                hit = self.at[s][place] == few
                scores = scores + np.where(hit, self.impact[s][place], 0)
                self.read += int(hit.sum())
            rest -= joint
        alive = scores >= least
        return scores[alive], few[alive]


INDEX = "terms array<int>, counts array<int>, docs binary, nulls binary, lengths binary, at binary, tf binary, pair binary, joint binary, sizes binary, both binary"


def _opened(r: dict, weights: np.ndarray, n: int, total: int) -> Block:
    """The block of a row with its impacts, from the weights by term number, the documents and all their terms."""
    names, counts, at = r["terms"].astype(np.int64), r["counts"], np.frombuffer(r["at"], "<u2").astype(np.int32)
    m = LENGTH_SHARE + (LENGTH_SHARE * np.frombuffer(r["lengths"], "<i8") * n) // total
    tf = _wide(r["tf"], len(at))
    impact = np.repeat(weights[names], counts) * ((TF_SCALE * tf) // (1000 * tf + SATURATION * m[at]))
    return Block(names, counts, at, impact, np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["nulls"], bool))


def _index(postings: DataFrame, weights: np.ndarray, n: int, total: int, pairs: np.ndarray) -> DataFrame:
    """Blocks with the largest joint impact of each pair of terms, and the documents of both where they are few."""
    shared = postings.sparkSession.sparkContext.broadcast((weights, pairs))

    def tasks(batches):
        weights, pairs = shared.value
        for r in _rows(batches):
            block = _opened(r, weights, n, total)
            here = np.isin(pairs, r["terms"]).all(axis=1)
            block.add_pairs(map(tuple, pairs[here].tolist()))
            lists = [x for _, x in block.pairs.values() if x is not None]
            made = [_bytes(np.flatnonzero(here), "<i4"), _bytes(np.array([x[0] for x in block.pairs.values()], np.int64), "<i8")]
            made.append(_bytes(np.array([-1 if x is None else len(x) for _, x in block.pairs.values()]), "<i4"))
            made.append(_bytes(np.concatenate(lists or [np.zeros(0)]), "<u2"))
            values = [pa.array([v], pa.list_(pa.int32())) for v in (r["terms"], r["counts"])]
            values += [pa.array([v], pa.binary()) for v in [*[r[c].to_pybytes() for c in ("docs", "nulls", "lengths", "at", "tf")], *made]]
            yield pa.RecordBatch.from_arrays(values, [c.split()[0] for c in INDEX.split(", ")])

    kept = postings.where("size(terms) > 0").select("terms", "counts", "docs", "nulls", "lengths", "at", "tf")
    return kept.mapInArrow(tasks, INDEX)


def _with_pairs(block: Block, r: dict, pairs: np.ndarray) -> Block:
    """The block with the pair lists of its row."""
    sizes, both, joint = np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["both"], "<u2").astype(np.int32), np.frombuffer(r["joint"], "<i8").tolist()
    ends = np.cumsum(np.maximum(sizes, 0)).tolist()
    for pair, j, size, end in zip(pairs[np.frombuffer(r["pair"], "<i4")].tolist(), joint, sizes.tolist(), ends, strict=True):
        block.pairs[tuple(pair)] = j, None if size < 0 else both[end - size : end]
    return block


def _best(found, k: int):
    """The k best of (scores, nulls, docs): highest score, then smaller doc_id, none last."""
    scores, nulls, docs = found
    if len(scores) > 4 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, nulls, docs = scores[some], nulls[some], docs[some]
    order = np.lexsort((docs, nulls, -scores))[:k]
    return scores[order], nulls[order], docs[order]


def _searched(index: DataFrame, asked: list[tuple[int, list[int]]], weights: np.ndarray, n: int, total: int, pairs: np.ndarray, k: int) -> DataFrame:
    """uid, doc_id, score: each task's k best documents of every item."""
    shared = index.sparkSession.sparkContext.broadcast((asked, weights, pairs))

    def tasks(batches):
        asked, weights, pairs = shared.value
        own = [partners(item) for _, item in asked]
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(asked)
        for r in _rows(batches):
            block = _with_pairs(_opened(r, weights, n, total), r, pairs)
            for i, (_, item) in enumerate(asked):
                old = best[i]
                least = int(old[0][-1]) if len(old[0]) == k else 1
                scores, places = block.search(item, own[i], least, k)
                if len(scores):
                    new = scores, block.nulls[places], block.docs[places]
                    best[i] = _best([np.concatenate(x) for x in zip(old, new, strict=True)], k)
        for (uid, _), (scores, nulls, docs) in zip(asked, best, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), uid)), pa.array(docs, mask=nulls), pa.array(scores)], ["uid", "doc_id", "score"])

    return index.mapInArrow(tasks, "uid long, doc_id long, score long")


def partners(item: list[int]) -> list[tuple[int, int]]:
    """Pairs of an item's terms, which come most frequent first: each with the PARTNERS that follow; the smaller number first."""
    return [(min(a, b), max(a, b)) for i, a in enumerate(item) for b in item[i + 1 : i + 1 + PARTNERS]]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items``, whole texts of both.

    Equal scores go to the smaller doc_id, a null doc_id last. Null and empty texts have no terms: such a document is not
    counted, such an item has no rows. Rows that repeat are documents, and items, of their own. An empty table gives an empty
    result; other columns are not read. ``items`` is a stored table; its texts go in rounds of about ROUND_BYTES, each of which
    reads the documents once, so what is broadcast doesn't grow with either table.
    """
    spark = docs.sparkSession

    def tokenised(batches):
        for b in batches:
            found = [sorted(set(terms(x.as_py()))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["uid", "terms"])

    named = items.select(row_id(items).alias("uid"), "item_id", F.col("text").cast("binary").alias("text"))
    size = named.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    rounds = max(1, -(-size // ROUND_BYTES))
    asked = named.select("uid", "text").mapInArrow(tokenised, "uid long, terms array<binary>")
    asked = materialize(asked.withColumn("round", F.pmod(F.xxhash64("uid"), F.lit(rounds))), "items")
    parts = [_round(docs, asked.where(F.col("round") == r), k) for r in range(rounds)]
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return top.join(named.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")


def _round(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = [(r["uid"], [bytes(t) for t in r["terms"]]) for r in asked.select("uid", "terms").toArrow().to_pylist()]  # about ROUND_BYTES
    vocabulary = sorted({t for _, item in rows for t in item})
    number = {t: i for i, t in enumerate(vocabulary)}
    postings = materialize(_postings(docs, vocabulary), "postings")
    n, total = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    each = postings.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[each["terms"].to_numpy()] = each["df"].to_numpy()
    weights = np.array([weight(n, int(x)) for x in df], np.int64)
    items = [(uid, sorted((i for t in item if df[i := number[t]]), key=lambda i: (-df[i], i))) for uid, item in sorted(rows)]
    pairs = sorted({p for _, item in items for p in partners(item)})
    pairs = np.array(pairs, np.int64).reshape(-1, 2)
    index = materialize(_index(postings, weights, n, max(total, 1), pairs), "index")
    return materialize(_searched(index, items, weights, n, max(total, 1), pairs, k), "found")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {
    "op13_ranked_search": f"""
with d as (select doc_id, {_WORDS} as words from documents where text is not null),
sizes as (select doc_id, len(words)::bigint as n from d where len(words) > 0),
totals as (select count(*)::bigint as n_all, sum(n)::bigint as l_all from sizes),
tf as (select doc_id, word, count(*)::bigint as tf from (select doc_id, unnest(words) as word from d) group by all),
asked as (select distinct item_id, word from (select item_id, unnest({_WORDS}) as word from benchmark where text is not null)),
weights as (select word, floor(1000 * ln((2.0 * n_all + 2) / (2 * df + 1)))::bigint as w
  from (select word, count(*)::bigint as df from tf group by word), totals),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::bigint as score
  from asked join tf using (word) join weights using (word) join sizes using (doc_id), totals group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50"""
}
