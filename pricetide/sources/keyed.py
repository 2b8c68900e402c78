"""A versioned table in buckets of its key, for batches that change a small part of it.

Rows lie in buckets by a hash of the columns that batches have in common, such as a source or a product. An update reads the
buckets that its batch falls in, merges, and writes those buckets anew in a folder of its own; the other buckets are neither
read nor written. A manifest (one row a bucket: its folder, rows and a digest of them) says what is live, and a pointer that
one writer can make publishes it, so readers see the old version or the new one. Buckets whose rows come out the same keep
their files: the same batch twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.sources.versions import CommitConflict, Versions
from pricetide.sources.work import nullable

#: Buckets of a table, and attempts at a contested version.
BUCKETS, ATTEMPTS = 256, 20
MANIFEST = "bucket int, folder string, n long, a long, b decimal(38,0), buckets int"
BUCKET = "__bucket"


class KeyedTable:
    """Rows of ``schema`` at ``path`` in ``buckets`` buckets by the columns ``by``.

    ``spread`` columns, if given, deal the rows of one value of ``by`` over ``spread_over`` buckets, for values that hold a
    large part of the table. Both numbers stay as they were when the table was made.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: list[str], buckets: int = BUCKETS, spread: list[str] | None = None, spread_over: int = 1):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), nullable(schema), by
        self.buckets, self.spread, self.spread_over = buckets, spread or [], spread_over
        self.versions = Versions(spark, f"{self.path}/versions")

    def bucket(self) -> Column:
        at = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets))
        if self.spread:
            at = at * self.spread_over + F.pmod(F.xxhash64(F.lit(1), *self.spread), F.lit(self.spread_over))
        return at.cast("int")

    def version(self) -> int:
        return self.versions.newest()

    def manifest(self, version: int | None = None) -> dict[int, dict]:
        """bucket -> folder, n, a, b of every bucket that has rows: no more rows than buckets."""
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self.versions.name(version)}").collect()
        if any(r["buckets"] != self.buckets * self.spread_over for r in rows):
            raise ValueError(f"the table at {self.path} has {rows[0]['buckets']} buckets")
        return {r["bucket"]: r.asDict() for r in rows}

    def _rows(self, live: list[dict]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{r['folder']}/{BUCKET}={r['bucket']}" for r in live])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(list(self.manifest(version).values()))

    def _digests(self, folder: str) -> dict[int, dict]:
        """What the buckets written to ``folder`` hold, whatever the order of their rows."""
        schema = T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])
        row = F.struct(*[F.col(f"`{f.name}`") for f in self.schema])
        found = self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}").groupBy(BUCKET)
        found = found.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(row)).alias("a"), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(20,0)")).cast("decimal(38,0)").alias("b"))
        return {r[BUCKET]: {"bucket": r[BUCKET], "folder": folder, "n": r["n"], "a": r["a"], "b": r["b"]} for r in found.collect()}

    def update(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], in_place: bool = False) -> int:
        """Replace the rows of the buckets that ``batch`` falls in by merge(those rows, batch); returns the newest version.

        ``batch`` has the columns ``by`` (and ``spread``). A row that ``merge`` returns must belong to the bucket of a batch
        row. Another writer's commit in between means another attempt on top of it. Rows are dealt by bucket before they are
        written, unless ``merge`` leaves most of them ``in_place``, in the tasks that read their buckets.
        """
        asked = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # no more than there are buckets
        for _ in range(ATTEMPTS):
            version, following = self.version(), self.versions.following()
            live = self.manifest(version)
            merged = merge(self._rows([live[b] for b in asked if b in live]), batch)
            folder = uuid.uuid4().hex
            columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]
            merged = merged.select(*columns).withColumn(BUCKET, self.bucket())
            merged = merged if in_place else merged.repartition(F.col(BUCKET))  # one file a bucket
            merged.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
            made = self._digests(folder) if asked else {}
            if strange := made.keys() - set(asked):
                raise ValueError(f"the merge made rows of buckets that the batch does not touch: {sorted(strange)[:5]}")
            same = {b for b, r in made.items() if b in live and all(live[b][k] == r[k] for k in ("n", "a", "b"))}
            if len(same) == len([b for b in asked if b in live]) == len(made):
                self.versions.remove(f"{self.path}/data/{folder}")
                return version
            kept = [r for b, r in live.items() if b not in asked or b in same]
            try:
                self._commit(kept + [r for b, r in made.items() if b not in same], following)
            except CommitConflict:
                self.versions.remove(f"{self.path}/data/{folder}")
                continue
            return following
        raise CommitConflict(f"gave up after {ATTEMPTS} attempts; nothing was changed")

    def _commit(self, rows: list[dict], version: int) -> None:
        if not self.versions.is_free(version):
            raise CommitConflict(f"version {version} was committed by another writer")
        name, n = uuid.uuid4().hex, self.buckets * self.spread_over
        listed = [(r["bucket"], r["folder"], r["n"], r["a"], r["b"], n) for r in rows]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        try:
            self.versions.claim(version, name)
        except CommitConflict:
            self.versions.remove(f"{self.path}/manifests/{name}")
            raise

    def vacuum(self, older_than: int = 86_400) -> int:
        """Delete bucket folders that the newest version does not name and that are ``older_than`` seconds old; returns how many.

        Older versions can't be read after it. The age spares what a writer has yet to commit; 0 is safe for a single writer.
        """
        fs, at = self.versions.file_system(f"{self.path}/data")
        live = {(r["folder"], r["bucket"]) for r in self.manifest().values()}
        limit = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - older_than * 1000
        n = 0
        for job in fs.listStatus(at) if fs.exists(at) else []:  # one folder an update
            parts = [p for p in fs.listStatus(job.getPath()) if p.isDirectory()]
            gone = [p for p in parts if (job.getPath().getName(), int(p.getPath().getName().partition("=")[2])) not in live and p.getModificationTime() <= limit]
            n += len(gone)
            for p in [job] if len(gone) == len(parts) and job.getModificationTime() <= limit else gone:
                fs.delete(p.getPath(), True)
        return n
