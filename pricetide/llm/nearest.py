"""Approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional vectors are learned on a bounded sample, each on what the ones before leave over. Every vector
is encoded by a beam search over all codebooks and kept with the norm of its decoded form. A query makes one lookup table per
codebook; table sums over the stored norm rank the codes of all vectors, block by block, and the AGAIN best of a query are
scored again on the original vectors in double precision. Queries go in rounds of bounded size that are broadcast; a task
scans its blocks of codes and hands on the few best of each query, so original vectors only move for those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import BROADCAST_IDS, materialize, nullable, row_id, scratch, share

#: Vectors learned from (about), codebooks, entries of each (at most 256), kept beams.
SAMPLE, BOOKS, ENTRIES, BEAM = 8192, 20, 256, 4
#: Vectors of a block, queries of a round (about), candidates of a query that are scored again.
BLOCK, QUERIES, AGAIN = 16_384, 8192, 128


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """Codes of each row of ``x``: the best of ``beam`` partial sums is carried from codebook to codebook."""
    rest, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.uint8)
    for book in books:
        cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
        flat = cost.reshape(len(x), -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        rows, old, new = np.arange(len(x))[:, None], best // len(book), best % len(book)
        rest = rest[rows, old] - book[new]
        codes = np.concatenate([codes[rows, old], new[:, :, None].astype(np.uint8)], axis=2)
    return codes[np.arange(len(x)), (rest**2).sum(2).argmin(1)]


def learn(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, seed: int = 7) -> list[np.ndarray]:
    """Residual codebooks, then two rounds in which each is fitted anew to what the others leave of beam-searched codes."""
    rng, rest, out = np.random.default_rng(seed), sample.copy(), []
    for _ in range(books):
        book = _centres(rest, entries, rng)
        out.append(book)
        rest = rest - book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
    for _ in range(2):
        codes = np.concatenate([encode(part, out) for part in np.array_split(sample, -(-len(sample) // 1024))])
        rest = sample - sum(book[codes[:, m]] for m, book in enumerate(out))
        for m, book in enumerate(out):
            own = rest + book[codes[:, m]]
            sums, n = np.zeros_like(book), np.bincount(codes[:, m], minlength=len(book))
            np.add.at(sums, codes[:, m], own)
            fresh = book.copy()
            fresh[n > 0] = sums[n > 0] / n[n > 0, None]
            rest = own - fresh[codes[:, m]]
            out[m] = fresh
    return out


def taking_part(vectors: DataFrame) -> DataFrame:
    """uid (row), vec_id, dims, v (array<double>) of the vectors that are not null, hold no null or non-finite part, and aren't all zero."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("v", lambda x: x != 0.0)
    rows = vectors.select(row_id(vectors).alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine & some).select("uid", "vec_id", F.size("v").alias("dims"), "v")


def _matrix(lists, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _by_dims(batch: pa.RecordBatch, at: int):
    """(dims, row numbers, matrix) for each length of the vectors in column ``at``."""
    sizes = np.diff(batch.column(at).offsets.to_numpy())
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, _matrix(batch.column(at).take(pa.array(rows)), int(d))


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row. Powers of two bring each row near 1 first: no digit changes, and no square over- or underflows."""
    x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(1, keepdims=True))[1]) for z in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` without those that can be nobody's neighbour: of equal vectors, only the k + 1 of smallest ids can.

    The last id that can is found for each vector that is there more often; a hot vector's rows are cut to k + 1 in every
    task before they are shuffled.
    """
    digest = [F.xxhash64("v").alias("_a"), F.xxhash64(F.lit(1), "v").alias("_b")]
    order = Window.partitionBy("_a", "_b").orderBy("vec_id", "uid")
    last = rows.select("vec_id", "uid", *digest).withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k + 1)
    last = materialize(last.select("_a", "_b", F.struct("vec_id", "uid").alias("_last")), "last-of-equals")
    last = F.broadcast(last) if last.count() <= BROADCAST_IDS else last
    return rows.select("*", *digest).join(last, ["_a", "_b"], "left").where(F.col("_last").isNull() | (F.struct("vec_id", "uid") <= F.col("_last"))).drop("_a", "_b", "_last")


def _books(rows: DataFrame, sizes: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """Codebooks for each length of vectors, learned on about SAMPLE rows, or 64 of each length where there are many lengths."""
    cap, chosen = max(64, SAMPLE // max(1, len(sizes))), F.lit(False)
    for d, n in sizes.items():
        chosen = chosen | ((F.col("dims") == d) & share(cap, n, "uid"))
    sample = rows.where(chosen).select("uid", "v").toArrow().sort_by("uid").combine_chunks()
    found = {d: x for b in sample.to_batches() for d, _, x in _by_dims(b, 1)}
    return {d: learn(_scaled(x)) for d, x in found.items()}


def _encoded(rows: DataFrame, books, blocks: dict[int, int]) -> DataFrame:
    """dims and members (vec_id, uid, codes, norm) of each block. Lengths without a sampled vector have no codes."""

    def tasks(batches):
        for b in batches:
            codes, norms = np.empty(b.num_rows, object), np.zeros(b.num_rows, np.float32)
            for d, at, x in _by_dims(b, 3):
                own = books.value.get(d, [])
                found = np.concatenate([encode(part, own) for part in np.array_split(_scaled(x), -(-len(x) // 512))])
                codes[at] = [c.tobytes() for c in found]
                norms[at] = np.sqrt((sum((book[found[:, m]] for m, book in enumerate(own)), np.zeros_like(x)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(codes, pa.binary()), pa.array(norms)], ["uid", "vec_id", "dims", "codes", "norm"])

    coded = rows.select("uid", "vec_id", "dims", "v").mapInArrow(tasks, "uid long, vec_id long, dims int, codes binary, norm float")
    n = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("dims")) if blocks else F.lit(1)
    members = F.collect_list(F.struct("vec_id", "uid", "codes", "norm")).alias("members")  # about BLOCK rows, by hash
    return coded.groupBy("dims", F.pmod(F.xxhash64("uid"), n).alias("block")).agg(members).select("dims", "members")


def _best(guess, ids, uids, again):
    if len(guess) > again:
        some = np.flatnonzero(guess >= np.partition(guess, -again)[-again])
        guess, ids, uids = guess[some], ids[some], uids[some]
    top = np.lexsort((uids, ids, -guess))[:again]
    return guess[top], ids[top], uids[top]


def _scan(base: DataFrame, books, asked: dict[int, tuple[np.ndarray, np.ndarray]], again: int) -> DataFrame:
    """asker, guess, vec_id, uid: each task's ``again`` best candidates of every query of one round."""
    shared = base.sparkSession.sparkContext.broadcast(asked)  # about QUERIES vectors

    def tasks(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            for d, members in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d not in shared.value:
                    continue
                found, own = members.values, books.value.get(d, [])
                ids, uids = found.field("vec_id").to_numpy(), found.field("uid").to_numpy()
                codes = np.frombuffer(b"".join(found.field("codes").to_pylist()), np.uint8).reshape(len(ids), len(own)).T.copy()
                norms = np.maximum(found.field("norm").to_numpy().astype(float), 1e-12)
                for q_uid, q in zip(*shared.value[d], strict=True):
                    guess = np.zeros(len(ids))
                    for book, code in zip(own, codes, strict=True):
                        guess += (book @ q).take(code)
                    guess /= norms
                    other = uids != q_uid
                    old = best.get(q_uid)
                    if old is not None and len(old[0]) == again:
                        other &= guess >= old[0][-1]
                    some = np.flatnonzero(other)
                    new = (guess[some], ids[some], uids[some])
                    if old is not None:
                        new = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                    best[q_uid] = _best(*new, again)
        for q_uid, (guess, ids, uids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q_uid)), pa.array(guess), pa.array(ids), pa.array(uids)], ["asker", "guess", "vec_id", "uid"])

    return base.mapInArrow(tasks, "asker long, guess double, vec_id long, uid long")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, again: int = AGAIN) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by cosine of each row whose vec_id is divisible by ``every``.

    Candidates are all other rows, those that repeat a vec_id too; ties go to the smaller vec_id. Null, zero and non-finite
    vectors take no part; vectors of another length have no cosine with a query, so each length is searched among its own.
    Very large and very small components are exact as well. A query with fewer candidates returns them all. An empty table
    gives an empty result; other columns are not read. ``vectors`` is a stored table: it is read several times.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors)
    candidates = _candidates(rows, k)
    sizes = {r["dims"]: r["count"] for r in candidates.groupBy("dims").count().collect()}  # one row a length
    books = spark.sparkContext.broadcast(_books(candidates, sizes))  # BOOKS x ENTRIES vectors of each length
    base = materialize(_encoded(candidates, books, {d: -(-n // BLOCK) for d, n in sizes.items()}), "codes")
    asked = rows.where(F.col("vec_id") % every == 0)
    rounds = max(1, -(-asked.count() // QUERIES))
    path = scratch(spark, "queries")
    asked.withColumn("round", F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(rounds)).cast("int")).write.partitionBy("round").parquet(path)
    schema = nullable(asked.schema).add("round", "integer")
    parts = []
    for r in range(rounds):
        part = spark.read.schema(schema).parquet(path).where(F.col("round") == r).select("uid", "v").toArrow().combine_chunks()
        queries = {d: (b.column(0).to_numpy()[at], _scaled(x)) for b in part.to_batches() for d, at, x in _by_dims(b, 1)}
        parts.append(materialize(_scan(base, books, queries, again), "found"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("asker").orderBy(F.desc("guess"), "vec_id", "uid")
    found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= again).select("asker", "vec_id", "uid")
    mine = asked.select(F.col("uid").alias("asker"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    both = found.join(rows.select("uid", "v"), "uid").join(mine, "asker").select("asker", "query_id", "vec_id", "uid", "v", "q")

    def score(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for d, at, x in _by_dims(b, 4):
                out[at] = cosines(x, _matrix(b.column(5).take(pa.array(at)), d))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], ["asker", "query_id", "vec_id", "uid", "score"])

    scored = both.mapInArrow(score, "asker long, query_id long, vec_id long, uid long, score double")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "uid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
