"""Sharding by size-tiered compaction, with versioned manifests.

Arrivals are appended as small immutable shards. Shards of one size tier (sizes within a factor of FANOUT) are merged, as soon
as there are FANOUT of them, into files of about the target size; larger shards are left alone. What is live is said by a
manifest: each commit writes a whole new one aside and then claims the next version number with a small pointer file that only
one writer can make, so that readers see the old version or the new one and never a part. The pointer is written aside as well
and linked or renamed to its place whole; that needs a file system that does so at once and never over another file, as local
and network disks and HDFS do (an object store without it allows one writer at a time). A number whose pointer is broken all
the same is passed over once it is STALE seconds old, so that no dead writer stops the others. Manifests stay tables: names of
shards are joined to rows, not collected. Replaced shards can be deleted once no reader needs the version that named them.
"""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import BROADCAST_IDS, materialize, nullable, running_sum, scratch

FANOUT, TARGET_BYTES, FLOOR_BYTES = 4, 64 << 20, 64 << 10
#: Rows of a manifest that one window sorts and one manifest file holds (about); attempts at a contested version.
SLICE_ROWS, FILE_ROWS, ATTEMPTS = 10_000, 100_000, 20
#: Seconds after which a pointer without its whole content counts as left behind by a dead writer; characters of a whole one.
STALE, NAME_CHARS = 600, 32
MANIFEST = "shard string, bytes long, rows long, tier int, since int"


class CommitConflict(RuntimeError):
    """The version was taken by another writer."""


class ShardStore:
    """A folder of Parquet shards and manifest versions on any file system that Spark writes to.

    Rows come back as they were appended, whatever their columns are called and hold. Of writers that race for a version one
    wins; an append tries again on top of the winner, a compaction starts anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), nullable(schema)
        self.target, self.fanout = target_bytes, fanout

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _pointers(self) -> dict[int, tuple[bool, float]]:
        """version -> whether its pointer is whole, and the pointer's age in seconds."""
        fs, at = self._fs(f"{self.path}/versions")
        listed = fs.listStatus(at) if fs.exists(at) else []
        return {int(s.getPath().getName()[1:]): (s.getLen() == NAME_CHARS, time.time() - s.getModificationTime() / 1000) for s in listed if s.getPath().getName()[:1] == "v"}

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max([0, *(v for v, (whole, _) in self._pointers().items() if whole)])

    def _next(self) -> int:
        """The number after all versions, those that dead writers left broken included."""
        return 1 + max([0, *(v for v, (whole, age) in self._pointers().items() if whole or age >= STALE)])

    def manifest(self, version: int | None = None) -> DataFrame:
        """shard (path below the store), bytes, rows, tier and since (version that brought it) of every live shard."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.path}/versions/v{version:09d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")

    def _claim(self, version: int, name: str) -> None:
        """Make the pointer of ``version``, whole at once, or fail if it is there."""
        fs, at = self._fs(f"{self.path}/versions/v{version:09d}")
        fs.mkdirs(at.getParent())
        if fs.getScheme() == "file":
            to = at.toUri().getPath()
            aside = os.path.join(os.path.dirname(to), f".{name}")
            with open(aside, "w") as f:
                f.write(name)
            try:
                os.link(aside, to)
            except FileExistsError:
                raise CommitConflict(f"version {version} was committed by another writer") from None
            finally:
                os.remove(aside)
        else:
            self._rename(fs, at, name)

    def _rename(self, fs, at, name: str) -> None:
        sc = self.spark.sparkContext
        jvm = sc._jvm
        aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{name}")
        stream = fs.create(aside, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        never_over = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(aside, at, never_over)
        except Py4JJavaError as e:
            if fs.exists(at):
                raise CommitConflict(f"{at.getName()} was committed by another writer") from e
            raise
        finally:
            fs.delete(aside, False)

    def _commit(self, rows: DataFrame, version: int) -> None:
        """Publish ``rows`` as ``version``; CommitConflict if another writer was first or is about to finish."""
        if any(v >= version for v in self._pointers()):
            raise CommitConflict(f"version {version} was committed by another writer")
        name = uuid.uuid4().hex
        rows = rows.select("shard", "bytes", "rows", "tier", "since")
        n = rows.count()
        rows.repartition(max(1, -(-n // FILE_ROWS))).write.parquet(f"{self.path}/manifests/{name}")
        try:
            self._claim(version, name)
        except CommitConflict:
            self._remove(f"{self.path}/manifests/{name}")
            raise

    def _remove(self, folder: str) -> bool:
        fs, at = self._fs(folder)
        return fs.delete(at, True)

    def _tail(self, path: Column) -> Column:
        """A file's path below the store. These names hold no sign that any side of Spark would encode."""
        return F.regexp_extract(path, r"(shards/[0-9a-f]{32}/.*)$", 1)

    def _files(self, folder: str, since: int) -> DataFrame:
        """Manifest rows of the data files with rows below ``folder``; no column of theirs is read."""
        found = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(folder)
        about = found.metadataColumn("_metadata")
        sizes = found.select(self._tail(about["file_path"]).alias("shard"), about["file_size"].alias("bytes")).groupBy("shard", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        tier = F.expr(f"cast(greatest(0, floor(log(greatest(bytes, 1) / {FLOOR_BYTES}.0) / log({self.fanout}.0))) as int)")
        return sizes.select("shard", "bytes", "rows", tier.alias("tier"), F.lit(since).alias("since"))

    def _fresh(self, name: str) -> str:
        """A column name that the rows don't have."""
        have = {f.name.lower() for f in self.schema}
        while name.lower() in have:
            name += "_"
        return name

    def _new_folder(self) -> str:
        return f"{self.path}/shards/{uuid.uuid4().hex}"

    def append(self, arrivals: DataFrame, by: str | Column | None = None) -> int:
        """Add shards of ``arrivals``; with ``by`` each value of that column, null too, is an arrival with shards of its own."""
        folder, columns = self._new_folder(), [F.col(f"`{f.name}`") for f in self.schema]
        if by is None:
            arrivals.select(*columns).write.option("compression", "zstd").parquet(folder)
        else:
            own, value = self._fresh("arrival"), F.col(f"`{by}`") if isinstance(by, str) else by
            digest = F.sha2(F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("")), 256)
            arrivals.select(*columns, digest.alias(own)).write.option("compression", "zstd").partitionBy(own).parquet(folder)
        made = materialize(self._files(folder, 0).drop("since"), "arrived")
        for _ in range(ATTEMPTS):
            version, following = self.version(), self._next()
            try:
                self._commit(self.manifest(version).unionByName(made.withColumn("since", F.lit(following))), following)
            except CommitConflict:
                continue
            return following
        self._remove(folder)
        raise CommitConflict(f"gave up after {ATTEMPTS} attempts; none of the rows is stored")

    def _due(self, live: DataFrame) -> tuple[int, DataFrame] | None:
        """The lowest tier with FANOUT shards below the target size, and its shards with the merge group of each."""
        small = live.where(F.col("bytes") < F.lit(self.target // 2))
        due = small.groupBy("tier").count().where(F.col("count") >= self.fanout).orderBy("tier").first()
        if due is None:
            return None
        slices = max(1, -(-due["count"] // SLICE_ROWS))
        chosen = small.where(F.col("tier") == due["tier"]).withColumn("_slice", F.pmod(F.xxhash64("shard"), F.lit(slices)))
        placed = running_sum(chosen, [], "_slice", ["shard"], "bytes", "_at")
        return due["tier"], placed.select("shard", "rows", F.expr(f"_at div {self.target}").alias("grp"))

    def compact(self) -> int:
        """Merge every tier that has FANOUT shards below the target size; returns the newest version."""
        for _ in range(64 * ATTEMPTS):
            version, following = self.version(), self._next()
            live = self.manifest(version)
            due = self._due(live)
            if due is None:
                return version
            tier, plan = due[0], materialize(due[1], "merge")
            group, folder = self._fresh("merge"), self._new_folder()
            told = plan.agg(F.count(F.lit(1)), F.sum("rows"), F.max("grp")).first()
            dealt = plan.select("shard", F.col("grp").cast("int").alias(group))
            rows = self._rows(plan, dealt, told[0])
            rows.repartitionById(told[2] + 1, F.col(group)).write.option("compression", "zstd").partitionBy(group).parquet(folder)
            made = materialize(self._files(folder, following), "merged")
            made = made.withColumn("tier", F.greatest("tier", F.lit(tier + 1)))  # merged runs climb, so this ends
            if made.agg(F.sum("rows")).first()[0] != told[1]:
                raise RuntimeError(f"merging {told[1]} rows of version {version} gave another number; nothing was committed")
            try:
                self._commit(live.join(dealt.select("shard"), "shard", "left_anti").unionByName(made), following)
            except CommitConflict:
                self._remove(folder)
        raise CommitConflict("other writers were always first")

    def _rows(self, shards: DataFrame, named: DataFrame, n: int) -> DataFrame:
        """Rows of ``shards`` with the columns of ``named`` (shard, ...) but the shard; one path for each writing job, not shard."""
        folders = [r[0] for r in shards.select(F.substring("shard", 1, 39)).distinct().toLocalIterator()]
        if not folders:
            return self.spark.createDataFrame([], T.StructType([*self.schema, *[f for f in named.schema if f.name != "shard"]]))
        found = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{f}" for f in folders])
        at = self._fresh("stored_in")
        named = named.withColumnRenamed("shard", at)
        rows = found.withColumn(at, self._tail(found.metadataColumn("_metadata")["file_path"]))
        return rows.join(F.broadcast(named) if n <= BROADCAST_IDS else named, at).drop(at)

    def read(self, version: int | None = None, **named: Column) -> DataFrame:
        """The rows of a version; ``named`` adds columns worked out from the manifest, such as ``shard=F.col("shard")``."""
        live = self.manifest(version)
        return self._rows(live, live.select("shard", *[c.alias(k) for k, c in named.items()]) if named else live.select("shard"), live.count())

    def vacuum(self, older_than: int = 86_400) -> int:
        """Delete files that the newest version does not name and that are ``older_than`` seconds old; returns how many.

        Shards that a dead writer left without a version go as well.
        The age spares shards that a writer has yet to commit; 0 is safe for a single writer.
        """
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/shards")
        age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modificationTime")
        files = listed.select(self._tail(F.col("path")).alias("shard"), (age >= older_than).alias("old"))
        files = files.join(self.manifest().select("shard", F.lit(True).alias("live")), "shard", "left").withColumn("gone", F.col("old") & F.col("live").isNull())
        folders = materialize(files.groupBy(F.substring("shard", 1, 39).alias("folder")).agg(F.every("gone").alias("whole"), F.count_if("gone").alias("n")), "folders")
        n = 0
        for r in folders.where("whole").toLocalIterator():  # a folder is what one job wrote: merged and failed ones go whole
            n += r["n"] * self._remove(f"{self.path}/{r['folder']}")
        parted = folders.where("n > 0 and not whole").select("folder")
        for r in files.where("gone").join(parted, F.substring("shard", 1, 39) == F.col("folder")).select("shard").toLocalIterator():
            n += self._remove(f"{self.path}/{r[0]}")
        return n


def shard_documents(docs: DataFrame, path: str | None = None, arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> tuple[ShardStore, DataFrame]:
    """Append ``docs`` in ``arrivals`` batches (by a hash of doc_id), compact, and list every row with its shard.

    Rows are kept as they are: nulls, empty and long texts, repeated rows and further columns of any name included. Texts
    that are null count 0 bytes in the list. An empty table makes a version without rows.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, path or scratch(spark, "shards"), docs.schema, target_bytes)
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)))
    store.compact()
    store.vacuum(0)
    live, version = store.manifest(), store.version()
    n = live.count()
    sliced = live.select("shard", "bytes", F.lit(1).alias("_one"), F.pmod(F.xxhash64("shard"), F.lit(max(1, -(-n // SLICE_ROWS)))).alias("_slice"))
    numbered = running_sum(sliced, [], "_slice", ["shard"], "_one", "_no").select("shard", (F.col("_no") + 1).alias("shard_no"), F.col("bytes").alias("shard_bytes"))
    names = {c: store._fresh(c) for c in ("shard_no", "shard_bytes")}
    rows = store._rows(live, materialize(numbered.withColumnsRenamed(names), "numbered"), n)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return store, rows.select("doc_id", n_bytes, *[F.col(v).alias(k) for k, v in names.items()], F.lit(version).alias("version"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
