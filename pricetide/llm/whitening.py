"""Embedding whitening with MLlib's BlockMatrix.

Entries become whole numbers, so counts and sums are exact. Centred rows are indexed into distributed blocks of about BLOCK
values; the transposed matrix times the matrix is the scatter, a table of dimensions x dimensions whose eigenvectors are found
on the driver; the matrix times the whitening matrix projects every row. A product puts the blocks of one of its partitions
together in memory and makes only about as many partitions as the root of those it is given, so rows go through it in panels
of PANEL blocks, and sums over many blocks are split SPLIT blocks at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import materialize

#: Values of a block (and most rows), blocks of a panel, blocks multiplied together before they are added.
BLOCK, BLOCK_ROWS, PANEL, SPLIT = 1 << 16, 1024, 2048, 32
#: Fixed values of the grid that entries are put on; entries of LARGEST or more have no place there.
GRID, OFFSET, LARGEST = 1024.0, 100_000, 2.0**52
COMPONENTS = 8
#: Eigenvalues below this part of the trace are rounding.
NOTHING = 1e-13
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, v (array<double>) of the vectors that hold numbers only."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return rows.where(F.col("v").isNotNull() & fine & (F.size("v") > 0)).select("vec_id", F.size("v").alias("dims"), "v")


def on_grid(lists, dims: int) -> np.ndarray:
    return np.floor(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * GRID).astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors: how many there are, and the exact sum of each dimension."""

    def tasks(batches):
        held: dict[int, list] = {}
        for b in batches:
            sizes = b.column(0).to_numpy()
            for d in np.unique(sizes).tolist():
                x = on_grid(b.column(1).take(pa.array(np.flatnonzero(sizes == d))), d)
                small = float(np.abs(x).max()) * len(x) < 2.0**62
                one = held.setdefault(d, [0, np.zeros(d, object)])
                one[0] += len(x)
                one[1] = one[1] + (x.sum(0) if small else x.astype(object).sum(0))
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums])], ["dims", "pos", "n", "s"])

    found = rows.select("dims", "v").mapInArrow(tasks, "dims int, pos int, n long, s string")
    found = found.groupBy("dims", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dims", "pos").collect()  # a row a dimension
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found:
        out.setdefault(r["dims"], (r["n"], []))[1].append(int(r["s"]))
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row, exact; None where it has more than 63 bits."""
    most = n * float(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 2.0**62 and len(sums) * (far := float(np.abs(x * n - np.array(sums, np.int64)).max(initial=0))) * far < 2.0**62:
        y = x * n - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    exact = [int(s) for s in ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)]
    return [s if s < 1 << 63 else None for s in exact]


def _blocks(rows: DataFrame, dims: int, n: int, sums: list[int]) -> DataFrame:
    """panel, at, ids, deviations, m, values (by column): the centred rows of one length, in blocks that are numbered through."""
    mean, most = np.array([s / n for s in sums]), max(1, min(BLOCK_ROWS, BLOCK // dims))
    fields = "number long, ids array<long>, deviations array<long>, m int, values array<double>"

    def tasks(batches):
        ids, parts, held, number = [], [], 0, 0

        def closed(size):
            nonlocal ids, parts, held, number
            x = np.concatenate(parts)
            own, rest = x[:size], x[size:]
            made = [[number], [ids[:size]], [deviations(own, n, sums)], [len(own)], [(own - mean).T.ravel()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.float64())]
            ids, parts, held, number = ids[size:], [rest], len(rest), number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], ["number", "ids", "deviations", "m", "values"])

        for b in batches:
            if b.num_rows:
                ids += b.column(0).to_pylist()
                parts.append(on_grid(b.column(1), dims))
                held += b.num_rows
                while held >= most:
                    yield closed(most)
        if held:
            yield closed(held)

    made = rows.where(F.col("dims") == dims).select("vec_id", "v").mapInArrow(tasks, fields)
    made = materialize(made.withColumn("task", F.spark_partition_id()), "blocks")
    counts = made.groupBy("task").count().orderBy("task").collect()  # a row a task
    start, total = {}, 0
    for r in counts:
        start[r["task"]], total = total, total + r["count"]
    first = rows.sparkSession.createDataFrame(list(start.items()), "task int, first long")
    whole = F.col("first") + F.col("number")
    return made.join(first, "task").select(F.floor(whole / PANEL).cast("int").alias("panel"), (whole % PANEL).cast("int").alias("at"), "ids", "deviations", "m", "values")


def _matrix(blocks: DataFrame, panel: int, cols: int, rows_per_block: int) -> BlockMatrix:
    own = blocks.where(F.col("panel") == panel).select("at", "m", "values").rdd
    made = own.map(lambda r: ((r["at"], 0), DenseMatrix(r["m"], cols, r["values"])))
    return BlockMatrix(made, rows_per_block, cols, PANEL * rows_per_block, cols)


def _scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """The transposed matrix times the matrix; the blocks are added up in groups, which MLlib's Python form has no argument for."""
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, max(1, -(-blocks // SPLIT)))
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def components(scatter: np.ndarray, n: int, k: int) -> tuple[np.ndarray, list[float]]:
    """The whitening matrix (dimensions x k) and what each component explains. A component without variance projects to 0."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2.0 * n))
    values, vectors, trace = values[::-1][:k], vectors[:, ::-1][:, :k], float(np.trace(scatter)) / n
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    some = values > NOTHING * trace
    scale = np.where(some, sign / np.sqrt(np.where(some, values, 1.0)), 0.0)
    return vectors * scale, [float(v) / trace if trace > 0 else 0.0 for v in np.maximum(values, 0.0)]


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and component up to ``k``.

    Null vectors, those with null or non-finite entries (or of 2^52 and more, which the grid does not hold) and empty ones are
    dropped. Vectors of different lengths have no common covariance: those of each length are whitened by themselves, so the
    jobs grow with the number of lengths. A component without variance is 0 in every row, and counts as an error of 1; vectors
    with fewer dimensions have fewer components. deviation is null where it has more than 63 bits. Rows that repeat, and
    repeated or null ids, all stay. An empty table gives an empty result; other columns are not read.
    """
    spark, rows = vectors.sparkSession, usable(vectors)
    parts = [_whitened(rows, d, n, sums, min(k, d)) for d, (n, sums) in sorted(_sums(rows).items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


def _whitened(rows: DataFrame, dims: int, n: int, sums: list[int], k: int) -> DataFrame:
    spark, high = rows.sparkSession, max(1, min(BLOCK_ROWS, BLOCK // dims))
    blocks = _blocks(rows, dims, n, sums)
    panels = {r["panel"]: r["count"] for r in blocks.groupBy("panel").count().collect()}  # a row a panel
    matrices = {p: _matrix(blocks, p, dims, high) for p in panels}
    scatter = sum((_scatter(m, panels[p]) for p, m in matrices.items()), np.zeros((dims, dims)))
    turn, explained = components(scatter, n, k)
    by = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, turn.T.ravel().tolist()))], 1), dims, k, dims, k)
    made = []
    for p, m in matrices.items():
        found = m.multiply(by).blocks.map(lambda x, p=p: (p, x[0][0], x[1].numRows, x[1].toArray().T.ravel().tolist()))
        made.append(spark.createDataFrame(found, "panel int, at int, m int, values array<double>"))
    made = materialize(reduce(DataFrame.unionByName, made), "whitened")
    square = sum((_scatter(_matrix(made, p, k, high), c) for p, c in panels.items()), np.zeros((k, k)))
    column = lambda j: F.aggregate(F.slice("values", F.col("m") * j + 1, F.col("m")), F.lit(0.0), lambda a, v: a + v)
    total = np.array([v or 0.0 for v in made.agg(*[F.sum(column(j)) for j in range(k)]).first()])  # 0 but for rounding
    error = float(np.abs((square - np.outer(total, total) / n) / n - np.eye(k)).max())
    both = blocks.select("panel", "at", "ids", "deviations").join(made, ["panel", "at"])
    each = both.select("m", "values", F.posexplode(F.arrays_zip("ids", "deviations")).alias("i", "z"))
    each = each.select(F.col("z.ids").alias("vec_id"), F.col("z.deviations").alias("deviation"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get("values", j * F.col("m") + F.col("i")))).alias("j", "whitened"))
    share = F.get(F.array(*[F.lit(e) for e in explained]), F.col("j"))
    return each.select("vec_id", (F.col("j") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
