"""Toxicity by nearest labelled examples: exact weighted TF-IDF cosine over a block-max inverted index.

The space: all words, and beginnings of longer words, that stand in LEAST_DOCS labelled texts. A term weighs its idf times the
strength of its tie to the label, either way (the root of its chi-square, LEAST_TIE at least), so none is left out and all
examples are in the index. Examples are cut in blocks of BLOCK, and each frequent term has the largest weight of each block.
A search adds up the lists of the other terms, text by text; what the frequent ones can add to a block at most follows from the block
maxima, so their lists are only added up in blocks that can still reach the k-th best: the neighbours are exact. Votes are
weighted by distance and calibrated by an isotonic fit on votes of the examples, each without itself and in a space whose
weights come from the other half of the examples, so that its label has no part in them.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import fold, share

#: Labelled rows learned from (about), examples to a block, neighbours, letters of a beginning.
SAMPLE, BLOCK, NEIGHBOURS, BEGINNING = 6_000, 64, 15, 5
#: Labelled texts in which a term of the space stands at least; least weight of a term by its tie to the label.
LEAST_DOCS, LEAST_TIE = 2, 0.1
#: Terms in more than one of so many examples are frequent; texts searched at once; blocks that set the first k-th best.
FREQUENT, TEXTS, FIRST = 12, 64, 6
NEAR = 0.05
#: Texts of either half (a, b) and label (0, 1).
COUNTS = ("a0", "a1", "b0", "b1")
_words = re.compile(r"\w+").findall


def terms(text: str | None) -> list[str]:
    words = _words(text.lower()) if text else []
    return words + [w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING]


def beginnings(vocabulary: dict[str, int]) -> np.ndarray:
    """For each term number that of the word's beginning; -1 where there is none."""
    out = np.full(len(vocabulary), -1, np.int32)
    for word, i in vocabulary.items():
        if len(word) > BEGINNING and word[-1] != "*":
            out[i] = vocabulary.get(word[:BEGINNING] + "*", -1)
    return out


def vector(text: str | None, vocabulary: dict[str, int], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of the vocabulary that stand in the text, rising, and how often each does: a word of the vocabulary leads to its beginning by number."""
    words = _words(text.lower()) if text else []
    found = np.array([vocabulary.get(w, -1) for w in words], np.int64)
    rest = [vocabulary.get(words[i][:BEGINNING] + "*", -1) for i in np.flatnonzero(found < 0).tolist() if len(words[i]) > BEGINNING]
    found = np.concatenate([found, begins[found[found >= 0]], np.array(rest, np.int64)])
    return np.unique(found[found >= 0], return_counts=True)


class Index:
    """Unit vectors of the examples, by term and block. The lists are made where they are used; term numbers and counts travel."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, rate: float):
        self.idf, self.rate, self.size = idf, rate, len(rows)
        self.ids, self.labels = np.asarray(ids, np.int64), np.asarray(labels, float)
        self.ends = np.cumsum([0, *[len(at) for at, _ in rows]])
        self.terms = np.concatenate([at for at, _ in rows] or [np.zeros(0)]).astype(np.int32)
        counts = np.concatenate([n for _, n in rows] or [np.zeros(0, np.int64)])
        self.counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
        self.steps = (np.array([0.0]), np.array([rate]))
        self._lists()

    _travels = ("idf", "rate", "size", "ids", "labels", "ends", "terms", "counts", "steps")

    def __getstate__(self):
        return {k: self.__dict__[k] for k in self._travels}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._lists()

    def _lists(self):
        n, t, w = self.size, self.terms, (1 + np.log(np.maximum(self.counts, 1).astype(float))) * self.idf[self.terms]
        own = np.repeat(np.arange(n), np.diff(self.ends))
        norms = np.sqrt(np.bincount(own, w * w, n))
        w = w / norms[own]
        often = np.bincount(t, minlength=len(self.idf)) > max(1, n / FREQUENT)
        self.row = np.where(often, np.cumsum(often) - 1, -1)  # of a frequent term in ``whole``
        mass = np.bincount(own, np.where(often[t], w * w, 0.0), n)
        self.order = np.argsort(-mass, kind="stable")  # alike in frequent terms, so that block maxima say something
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.named, self.marked = self.ids[self.order], self.labels[self.order]
        self.place = place
        self.starts = np.arange(0, n, BLOCK)
        at = place[own[often[t]]]
        self.whole = np.zeros((len(self.starts), int(often.sum()), BLOCK)).transpose(1, 0, 2)  # a block's weights lie together
        self.whole[self.row[t[often[t]]], at // BLOCK, at % BLOCK] = w[often[t]]
        self.largest = self.whole.max(axis=2, initial=0.0)
        rare = np.flatnonzero(~often[t])
        key = t[rare].astype(np.int64) << 32 | self.counts[rare]
        rare = rare[np.argsort(key, kind="stable")]
        # A list is the bytes of the places of its examples, by rising count: its weights are one number for each count.
        places = place[own[rare]].astype(np.min_scalar_type(n))
        raw, self.kind, at = places.tobytes(), places.dtype, np.concatenate([[0], np.cumsum(np.bincount(t[rare], minlength=len(self.idf)))]) * places.itemsize
        self.lists = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        runs, self.long = np.unique(key, return_counts=True)
        self.by_count = 1 + np.log((runs & 0xFFFFFFFF).astype(float))
        self.cut = np.searchsorted(runs >> 32, np.arange(len(self.idf) + 1))
        self.norms = np.where(norms > 0, norms, 1.0)[self.order]

    def unit(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts.astype(float))) * self.idf[at]
        norm = float(np.sqrt(w @ w))
        return w / norm if norm else w

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.ends[i], self.ends[i + 1])
        return self.terms[span].astype(np.int64), self.counts[span].astype(np.int64)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None):
        """(places, cosines) of each text's k nearest examples with a cosine over 0, ties to the smaller id; ``but``: an example to leave out for each."""
        m, n = len(texts), self.size
        if not n or not m:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        asked, sums = np.zeros((m, len(self.whole))), np.empty((m, n))
        for i, (at, counts) in enumerate(texts):
            w, row = self.unit(at, counts), self.row[at]
            asked[i, row[row >= 0]] = w[row >= 0]
            sums[i] = self._added(at[row < 0], w[row < 0])
        out = None if but is None else (np.arange(m), self.place[np.array(but)])
        if out:
            sums[out] = 0.0
        bound = asked @ self.largest + np.maximum.reduceat(sums, self.starts, axis=1)
        still = np.ones(bound.shape, bool)
        first = np.argsort(-bound, axis=1)[:, :FIRST]
        due = np.zeros(bound.shape, bool)
        due[np.arange(m)[:, None], first] = True
        kth = np.zeros(m)
        for last in (False, True):
            if last:
                if n > k:
                    kth = np.partition(sums, n - k, axis=1)[:, n - k]
                due = still & (bound >= kth[:, None] - 1e-9)
            for b in np.flatnonzero(due.any(0)):
                rows, span = np.flatnonzero(due[:, b]), slice(self.starts[b], min(n, self.starts[b] + BLOCK))
                sums[rows, span] += (asked[rows] @ self.whole[:, b])[:, : span.stop - span.start]
            still &= ~due
            if out:
                sums[out] = 0.0
        found = []
        top = np.maximum.reduceat(sums, self.starts, axis=1)
        if top.shape[1] > k:  # the k-th of the blocks' best is no more than the k-th best
            kth = np.maximum(kth, np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k])
        for one, least in zip(sums, kth, strict=True):
            few = np.flatnonzero((one > 0) & (one >= least - 1e-11))
            top = few[np.lexsort((self.named[few], -np.round(one[few], 12)))[:k]]
            found.append((top, np.minimum(one[top], 1.0)))
        return found

    def _added(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the lists of a text's terms add to each example: text by text, so that what is worked on stays in the processor's cache."""
        start, runs = self.cut[at], self.cut[at + 1] - self.cut[at]
        ends = np.cumsum(runs)
        run = np.repeat(start - ends + runs, runs)
        run += np.arange(len(run))
        weights = np.repeat(np.repeat(w * self.idf[at], runs) * self.by_count[run], self.long[run])
        places = np.frombuffer(b"".join([self.lists[i] for i in at.tolist()]), self.kind)
        return np.bincount(places, weights, self.size) / self.norms

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Places without a neighbour vote as the examples without any term do. Rounded, so that the calibration takes no last bit for a step."""
        w, none = 1 / (NEAR + 1 - cosine), (NEIGHBOURS - len(found)) / (NEAR + 1)
        return round(float((w @ self.marked[found] + none * self.rate) / (w.sum() + none)), 12)

    def calibrated(self, vote) -> np.ndarray:
        return np.clip(np.interp(vote, *self.steps), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Rising steps closest to y by weight, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i], x[i], y[i] * weight[i], weight[i]])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], max(pools[-1][1], last[1]), pools[-1][2] + last[2], pools[-1][3] + last[3]]
    level = [(p[2] + 0.5 * 0.02) / (p[3] + 0.02) for p in pools]
    return np.array([v for p in pools for v in (p[0], p[1])]), np.array([v for v in level for _ in (0, 1)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, int], Index]:
    """Vocabulary and index from ``labels`` (doc_id, toxic 0/1) and their texts in ``docs``; about ``sample`` labelled rows.

    Labels that are null are left out; a document labelled twice counts as toxic if any label says so.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = usable.where(share(sample, usable.count(), "doc_id")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about SAMPLE rows

    def document_counts(batches):
        """How many texts of each half and label hold a term; the empty term stands in all."""
        seen = [Counter() for _ in range(4)]
        for b in batches:
            for text, y, h in zip(b.column("text"), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
                seen[2 * h + y].update({"", *terms(text.as_py())})
        words = list(set().union(*seen))
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[w] for w in part], pa.int64()) for c in seen]], ["term", *COUNTS])

    counts = texts.mapInArrow(document_counts, "term string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
    counts = counts.where(F.expr(f"{' + '.join(COUNTS)} >= {LEAST_DOCS}") | (F.col("term") == "")).toArrow()  # terms of about SAMPLE texts
    names = np.array(counts["term"].to_pylist(), object)
    order = np.argsort(names, kind="stable")
    names, held_in = names[order], np.array([counts[c].to_numpy() for c in COUNTS], float).reshape(4, -1)[:, order]
    totals = held_in[:, 0] if len(names) and names[0] == "" else np.zeros(4)
    names, held_in = names[1:], held_in[:, 1:]
    order = np.argsort(-held_in.sum(0), kind="stable")  # terms looked up most have their entries and lists side by side
    names, held_in = names[order].tolist(), held_in[:, order]
    idf = term_weights(held_in[0::2].sum(0), held_in[1::2].sum(0), totals[0::2].sum(), totals[1::2].sum())
    space = docs.sparkSession.sparkContext.broadcast(names)
    held: dict[str, int] = {}

    def vectors(batches):
        if not held:
            held.update({w: i for i, w in enumerate(space.value)})
        for b in batches:
            found = [sorted((held[w], n) for w, n in Counter(filter(held.__contains__, terms(text.as_py()))).items()) for text in b.column("text")]
            made = [pa.array([np.array([x[i] for x in row], kind).tobytes() for row in found], pa.binary()) for i, kind in ((0, ">i4"), (1, "<i4"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("half"), *made], ["doc_id", "toxic", "half", "at", "n"])

    made = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic", "half").mapInArrow(vectors, "doc_id long, toxic int, half int, at binary, n binary").toArrow()
    space.destroy()
    rows = sorted(zip(*[made[c].to_pylist() for c in ("at", "doc_id", "toxic", "n", "half")], strict=True), key=lambda r: r[:2])
    zero = [r[2] for r in rows if not r[0]]
    rows = [r for r in rows if r[0]]
    rate = (sum(zero) + 0.02) / (len(zero) + 1) if zero or rows else 0.02
    index_of = lambda weights: Index(weights, [(np.frombuffer(r[0], ">i4"), np.frombuffer(r[3], "<i4")) for r in rows], [r[1] for r in rows], [r[2] for r in rows], rate)
    index = index_of(idf)
    votes = np.zeros(len(rows))
    for h in (0, 1):
        mine, other = [i for i, r in enumerate(rows) if r[4] == h], 2 * (1 - h)
        if mine:
            weights = term_weights(held_in[other], held_in[other + 1], totals[other], totals[other + 1])
            votes[mine] = _votes(docs.sparkSession, index_of(weights), mine)
    if rows:
        x = np.array([*votes, index.vote(np.zeros(0, np.int64), np.zeros(0))])
        y = np.array([*[r[2] for r in rows], rate], float)
        index.steps = isotonic(x, y, np.array([*[1.0] * len(rows), max(1.0, len(zero))]))
    return {w: i for i, w in enumerate(names)}, index


def term_weights(n0: np.ndarray, n1: np.ndarray, all0: float, all1: float) -> np.ndarray:
    """idf times the strength of each term's tie to the label, from how many texts of either label hold it; a term of none counts as one of one."""
    n = np.maximum(n0 + n1, 1)
    idf = np.log((1 + all0 + all1) / n)
    if all0 and all1:
        chi2 = (all0 + all1) * (n1 * (all0 - n0) - n0 * (all1 - n1)) ** 2 / (all0 * all1 * n * np.maximum(all0 + all1 - n, 1))
        idf = idf * np.maximum(np.sqrt(chi2), LEAST_TIE)
    return np.maximum(idf, 1e-9)


def _votes(spark: SparkSession, index: Index, chosen: list[int]) -> np.ndarray:
    """The vote on each of the ``chosen`` examples by the others."""
    shared = spark.sparkContext.broadcast((index, np.array(chosen, np.int64)))

    def alone(batches):
        own, at = shared.value
        for b in batches:
            ids, votes = at[b.column(0).to_numpy()].tolist(), []
            for a in range(0, len(ids), TEXTS):
                part = ids[a : a + TEXTS]
                votes += [own.vote(*found) for found in own.nearest([own.example(i) for i in part], but=part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.float64())], ["id", "vote"])

    voted = spark.range(0, len(chosen), 1, -(-len(chosen) // 500)).mapInArrow(alone, "id long, vote double").toArrow()
    shared.destroy()
    votes = np.zeros(len(chosen))
    votes[voted["id"].to_numpy()] = voted["vote"].to_numpy()
    return votes


def score_documents(docs: DataFrame, model: tuple[dict[str, int], Index], keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default doc_id) of every row with score, predicted and the evidence: nearest examples' doc_ids.

    Null, empty and unknown texts have no neighbour and get the calibrated rate of examples without any term. Whole texts are
    read; ties of cosine go to the earlier example.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0], beginnings(model[0]), model[1]))  # the terms and vectors of about SAMPLE examples
    kept = docs.select(*[F.col(c) for c in (keep or ["doc_id"])], F.col("text").alias("_whole_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", score double, predicted int, evidence array<long>"

    def tasks(batches):
        vocabulary, begins, index = shared.value
        for b in batches:
            texts, votes, evidence = b.column(b.num_columns - 1), [], []
            for a in range(0, len(texts), TEXTS):
                part = [vector(text.as_py(), vocabulary, begins) for text in texts[a : a + TEXTS]]
                found = index.nearest(part)
                votes += [index.vote(*f) for f in found]
                evidence += [index.named[places].tolist() for places, _ in found]
            scores = index.calibrated(np.array(votes))
            made = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "score", "predicted", "evidence"])

    return kept.mapInArrow(tasks, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold(5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(5) != 0)
    return score_documents(docs, fit(docs, labels), ["doc_id", "held_out"])
