"""Tables between the steps of a plan, on storage that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: list[str] = []


def work_root(spark: SparkSession) -> str:
    """This application's part of the folder that ``spark.checkpoint.dir`` names.

    Where that is unset: a local folder of a session without executors elsewhere (tests), an error on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it names the folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pricetide-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/pricetide/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{uuid.uuid4().hex}/{name}"


def clean_work(spark: SparkSession) -> None:
    """Delete this application's work tables; call it once the results that read them are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table and read it back: cuts lineage, is worked out once, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)
