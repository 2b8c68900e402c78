"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams per language are summed by Spark over a bounded, labelled sample; the log-probability matrix
(BUCKETS x languages) is broadcast in groups of GROUP languages, and batches are scored in numpy by gathering matrix rows at the hashed
positions and adding them up per document. Whole texts are scored; long ones in stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import fold, share

BUCKETS = 1 << 15
SIZES = (2, 3)
#: Labelled documents learned from per language (about), and languages counted, sent and scored at once.
SAMPLE, GROUP = 3000, 64
#: Code points handled at once; pseudo-count; n-grams after which more text adds no more confidence.
STRETCH, ALPHA, ENOUGH = 1 << 20, 0.5, 60
UND = "und"
_plain: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself for letters, blank for all others."""
    if not _plain:
        _plain.append(np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32))
    return _plain[0]


def stretches(texts):
    """(document numbers, first positions, code points, gram positions) for about STRETCH code points at a time.

    Each document, and each stretch of a long one, ends in two blanks more or in the next two characters, so no n-gram
    reaches into another document and none is lost.
    """
    docs, parts, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        text = text.lower()
        for a in range(0, len(text), STRETCH):
            part = text[a : a + STRETCH + 2]
            keep = min(STRETCH, len(text) - a)
            docs.append(k)
            parts.append(part + "  " * (len(part) == keep) + " " * (len(part) == keep + 1))
            size += len(part)
            if size >= STRETCH:
                yield _laid(docs, parts)
                docs, parts, size = [], [], 0
    if parts:
        yield _laid(docs, parts)


def _laid(docs, parts):
    points = _letters()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    own = np.ones(len(points), bool)
    own[ends - 1] = own[ends - 2] = False
    starts = (ends - sizes) - 2 * np.arange(len(parts))
    return np.array(docs), starts, points, own


def grams(points: np.ndarray, own: np.ndarray):
    """Hashed n-grams that begin at the document's own characters, one array per n; each begins once."""
    h = points * np.uint32(0x9E3779B1)
    for n in range(2, max(SIZES) + 1):
        moved = np.empty_like(points)
        moved[: len(points) - n + 1], moved[len(points) - n + 1 :] = points[n - 1 :], 32
        h = (h ^ (h >> np.uint32(15)) ^ moved) * np.uint32(0x85EBCA77 + 2 * n)
        if n in SIZES:
            yield ((h >> np.uint32(17)) & np.uint32(BUCKETS - 1))[own]


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray] | None:
    """Languages and their log-probability matrix, learned from rows that have a lang; None if there are none.

    ``docs`` needs text, lang and doc_id. About ``sample`` rows per language are used, chosen by a hash of the id.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    names = sorted(sizes)
    table = np.empty((len(names), BUCKETS))
    for a in range(0, len(names), GROUP):
        group = names[a : a + GROUP]
        table[a : a + GROUP] = _log_probabilities(labelled, {s: sizes[s] for s in group}, sample)
    return names, table


def _log_probabilities(labelled: DataFrame, sizes: dict[str, int], sample: int) -> np.ndarray:
    """The rows of the matrix for the languages of ``sizes``, in its order."""
    names = list(sizes)
    chosen = F.lit(False)
    for lang, size in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & share(sample, size, "doc_id"))
    index = {name: i for i, name in enumerate(names)}

    def tasks(batches):
        total = np.zeros((len(names), BUCKETS), np.int64)
        for b in batches:
            langs = [index[s] for s in b.column(0).to_pylist()]
            for owner, starts, points, own in stretches(b.column(1).to_pylist()):
                rows = np.array(langs)[owner]
                counts = np.diff(np.append(starts, own.sum()))
                where = np.repeat(rows, counts) * BUCKETS
                for h in grams(points, own):
                    total += np.bincount(where + h, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

    found = labelled.where(chosen).select("lang", "text").mapInArrow(tasks, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * BUCKETS)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(len(names), BUCKETS) + ALPHA
    return np.log(counts / counts.sum(1, keepdims=True))


def score(texts: list, names: list[str], table):
    """(predicted language, score) of each text."""
    sums, grams_of, letters = np.zeros((len(texts), len(names))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for owner, starts, points, own in stretches(texts):
        counts = np.diff(np.append(starts, own.sum()))
        np.add.at(letters, owner, np.add.reduceat((points[own] != 32).astype(np.int64), starts))
        np.add.at(grams_of, owner, counts * len(SIZES))
        for h in grams(points, own):
            for i in range(len(names)):
                np.add.at(sums[:, i], owner, np.add.reduceat(table[i].take(h), starts))
    if not names:
        return [UND] * len(texts), np.zeros(len(texts))
    sums *= np.minimum(1, ENOUGH / np.maximum(grams_of, 1))[:, None]
    odds = np.exp(sums - sums.max(1, keepdims=True))
    best = sums.argmax(1)
    sure = np.where(letters > 0, odds.max(1) / odds.sum(1), 0.0)
    return [names[i] if n else UND for i, n in zip(best, letters, strict=True)], sure


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row (default doc_id) with lang_pred and score.

    Texts that are null, empty or have no letter get ``und`` with score 0, as does every text when nothing was learned. Ties
    go to the first language by name. Only text and the kept columns are read.
    """
    names, table = model or ([], np.zeros((0, BUCKETS)))
    shared = [docs.sparkSession.sparkContext.broadcast(table[a : a + GROUP]) for a in range(0, len(names), GROUP)]
    kept = docs.select(*[F.col(c) for c in (keep or ["doc_id"])], F.col("text").alias("_whole_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", lang_pred string, score double"

    def tasks(batches):
        for b in batches:
            langs, sure = score(b.column(b.num_columns - 1).to_pylist(), names, [row for part in shared for row in part.value])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(sure, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(tasks, schema)


def with_language(docs: DataFrame, held_out=None) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out, then identify every row."""
    held_out = fold(4) == 2 if held_out is None else held_out
    model = fit(docs.where(~held_out))
    return identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@F.pandas_udf(T.BooleanType())
def _has_letter(texts: pd.Series) -> pd.Series:
    """Whether a text has a letter, as ``score`` counts them."""
    return texts.map(lambda t: any(map(str.isalpha, t or ""))).astype(bool)


def reject_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text has a language: ``und`` and scores under ``least`` go; the columns are those of ``docs``.

    When nothing was learned (no row has a usable lang), texts that have a letter stay.
    """
    model = fit(docs.where(fold(4) != 2))
    own = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)], F.col("text"))
    if model is None:
        found = rows.where(_has_letter("text"))
    else:
        found = identify(rows, model, own).where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)])
