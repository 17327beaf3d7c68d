"""Session settings, the shared work folder and stored intermediate rows."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The seen set of a stream has no expiry; RocksDB keeps it on disk instead of on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Pages and vectors are wide rows, so Arrow batches are kept short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "lexloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the stages that run Python."""
    context = spark.sparkContext
    if any(os.path.basename(path).startswith("lexloom-") for path in context.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"lexloom-{context.applicationId}")
    context.addPyFile(shutil.make_archive(made, "zip", os.path.dirname(here), os.path.basename(here)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext.getCheckpointDir()
    if named or known:
        return named or os.path.dirname(known.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="lexloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's table, stream checkpoint or sink."""
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str, of: str) -> str:
    """The path of a table that this application makes once for each input `of`, and then finds again."""
    return f"{_work_folder(spark)}/{name}-{hashlib.sha256(of.encode()).hexdigest()[:32]}"


def _work_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lexloom/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Deletes what this application has stored under work paths, once nothing reads its results any more."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(_work_folder(spark))
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str = "rows", rows_per_file: int = 0) -> DataFrame:
    """Store the rows as a table in the shared folder and go on from there.

    Computes the rows once, ends their lineage, and lets Spark know their size; a lost executor costs only a rereading.
    Where rows are very wide, files are to have few of them, as Spark's reader holds up to 4,096 rows of a file at once.
    """
    path, writer = work_path(df.sparkSession, name), df.write
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, int]:
    """As written, with the number of rows, taken while they are written."""
    counted = Observation()
    stored = written(df.observe(counted, F.count(F.lit(1)).alias("n")), name)
    return stored, counted.get["n"]
