"""Document quality by Bradley-Terry pairwise ranking.

Labels give preferences: a document marked good is preferred to one marked bad. A document's strength is a linear function of
features that no language or topic enters (repetition, capitals, symbols, tables, word and line lengths), and the chance that
one is preferred to another is the logistic function of the difference of their strengths; weights minimise the logistic loss
over sampled preference pairs. The cut between keep and drop is the quantile of the labelled strengths whose level makes the
fewest mistakes. Every document also gets the share of all documents that are weaker.
"""

from __future__ import annotations

from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import fold, materialize, share

#: Labelled rows learned from (about, of each label), preference pairs of each, weight of the penalty.
SAMPLE, PARTNERS, PENALTY = 4_000, 8, 1e-3
#: The score at the cut; strengths are counted in bins of 1/128 up to STRONG either way.
CUT, STRONG, BINS = 0.3, 32.0, 8_192
SYMBOLS = "#$%&*+/<=>@[]\\^_`{}~"


def features(text: str | None) -> list[float] | None:
    """Shares and means of a whole text, each also as its root; None where there is no word."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return None
    lines = [x for x in text.split("\n") if x.strip()]
    counts, pairs = Counter(words), max(1, n - 1)
    found = [
        sum(map(eq, words, words[1:])) / pairs,
        1 - len(counts) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / pairs,
        max(counts.values()) / n,
        sum(map(str.isupper, words)) / n,
        1 - sum(map(str.isalpha, words)) / n,
        sum(map(str.isdigit, words)) / n,
        sum(map(text.count, SYMBOLS)) / n,
        text.count("|") / n,
        text.count("!") / n,
        (text.count(".") + text.count("?")) / n,
        text.count(",") / n,
        (len(text) - text.count(" ")) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
    ]
    return [*found, *[x**0.5 for x in found], float(np.log1p(n))]


WIDTH = len(features("x"))  # type: ignore[arg-type]


class Model(NamedTuple):
    """Weights on standardised features, the cut between strengths, and the score of all if labels prefer nothing."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    flat: float | None

    def strengths(self, texts) -> np.ndarray:
        """A text without a word has the mean features of the labelled ones."""
        rows = [features(t) for t in texts]
        x = np.array([r if r is not None else self.mean for r in rows], float).reshape(-1, WIDTH)
        return ((x - self.mean) / self.scale) @ self.weights


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> np.ndarray:
    """Weights of least mean logistic loss on the differences of features, by Newton's method."""
    x = better - worse
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(x @ w, -60, 60)))  # chance that the worse one is preferred
        gradient = penalty * w - x.T @ p / len(x)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def preferences(good: int, bad: int, partners: int = PARTNERS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs: every row of either label meets ``partners`` of the other, all in turn of a shuffled order."""
    rng, n = np.random.default_rng(seed), max(good, bad)
    deal = lambda size: np.concatenate([rng.permutation(size) for _ in range(-(-n * partners // size))])[: n * partners]
    return deal(good), deal(bad)


def quantile_cut(strengths: np.ndarray, labels: np.ndarray) -> float:
    """Between the strengths at the quantile level that sets the fewest labels wrong; of equal levels, where the gap is widest."""
    order = np.argsort(strengths, kind="stable")
    s, y = strengths[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    gap = np.diff(edges)
    level = np.lexsort((-gap, np.where(gap > 0, wrong, len(s) + 1)))[0]
    return float((edges[level] + edges[level + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, quality 0/1) and their texts in ``docs``; about ``sample`` rows of each label.

    Labels that are null are left out, as are texts without a word; a document labelled twice is good only if all say so. If
    one of the two labels is missing nothing is preferred, and all documents score the share of good labels (0.5 without any).
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    usable = materialize(usable, "labels")
    sizes = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    chosen = F.lit(False)
    for y, n in sizes.items():
        chosen = chosen | ((F.col("quality") == y) & share(sample, n, "doc_id"))
    texts = docs.select("doc_id", "text").join(F.broadcast(usable.where(chosen)), "doc_id")  # about 2 x SAMPLE ids

    def tasks(batches):
        for b in batches:
            found = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    made = texts.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(tasks, "doc_id long, quality int, x array<double>").where("x is not null").toArrow().to_pylist()
    made.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in made], float).reshape(-1, WIDTH), np.array([r["quality"] for r in made], int)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    i, j = preferences(len(good), len(bad))
    weights = bradley_terry(z[good[i]], z[bad[j]])
    return Model(mean, scale, weights, quantile_cut(z @ weights, y), None)


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default doc_id) of every row with score, predicted and quantile, the share of all that are weaker.

    The score is the chance to be preferred to a document at the cut, moved so that the cut itself scores CUT. Whole texts are
    read. Null, empty and blank texts are as strong as the average labelled document. Equal texts score alike; quantiles are
    exact to the width of a bin, equal strengths share one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in (keep or ["doc_id"])], F.col("text").alias("_whole_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", _strength double"

    def tasks(batches):
        for b in batches:
            found = shared.value.strengths(t.as_py() for t in b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], [*b.schema.names[:-1], "_strength"])

    made = kept.mapInArrow(tasks, schema)
    bin_ = F.floor((F.greatest(F.lit(-STRONG), F.least(F.lit(STRONG), F.col("_strength") - F.lit(model.cut))) + STRONG) * (BINS / (2 * STRONG))).cast("int")
    made = materialize(made.withColumn("_bin", bin_), "strengths")
    counts = {r["_bin"]: r["count"] for r in made.groupBy("_bin").count().collect()}  # at most BINS + 1 rows
    at, below, total = {}, 0, sum(counts.values())
    for k in sorted(counts):
        at[k], below = (below + counts[k] / 2) / total, below + counts[k]
    weaker = docs.sparkSession.createDataFrame(list(at.items()), "_bin int, quantile double")
    chance = 1 / (1 + F.exp(F.lit(model.cut) - F.col("_strength") - F.lit(float(np.log(CUT / (1 - CUT))))))
    score = F.lit(model.flat) if model.flat is not None else chance
    return made.join(F.broadcast(weaker), "_bin", "left").withColumn("score", score).withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop("_bin", "_strength").select(*(keep or ["doc_id"]), "score", "predicted", "quantile")


def keep_best(scored: DataFrame, part: float) -> DataFrame:
    """The strongest ``part`` (0 to 1) of all rows: a threshold by quantile."""
    return scored.where(F.col("quantile") >= 1 - part)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold(5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(5) != 0)
    return score_documents(docs, fit(docs, labels), ["doc_id", "held_out"])
