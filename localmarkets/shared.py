"""Shared folder and session helpers used by every job that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: Rows and bytes of an Arrow batch, and rows that the Parquet reader decodes at a time, while a table is written:
#: Spark and the Python worker hold a batch of texts at once, and the reader's column of texts is one array that
#: doubles until a batch fits in (some MB of texts at the 4,096 rows that Spark takes otherwise).
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 500,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
}
#: A table that is written needs nothing of its shuffles any more: their files go with the job, and not when the driver's heap is collected.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows of a table take many times its files, where values come back; by the files alone Spark would have the driver hold and broadcast them.
SIZED = {"spark.sql.sources.fileCompressionFactor": "10.0"}


@contextmanager
def _settings(spark: SparkSession, own: dict[str, object]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def small_batches(spark: SparkSession):
    """Batches within ``BATCH`` for the jobs that run inside."""
    return _settings(spark, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs on
    one machine (tests) a temporary folder is made and set as the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def without_shuffle_files(spark: SparkSession):
    """Jobs inside delete the files of their shuffles when they end."""
    return _settings(spark, CLEANED)


class Scratch:
    """The tables that ``cut_at`` writes while this is the innermost one open."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``cut``, a table that outlives the others."""
        out, path = cut_at(df, name)
        self.paths.remove(path)
        if len(_open) > 1:
            _open[-2].paths.append(path)
        return out


_open: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that are cut inside are deleted at the end, but those that are kept."""
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.pop()
        for path in own.paths:
            remove(spark, path)


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back; and where it is."""
    path = shared_path(df.sparkSession, name)
    if _open:
        _open[-1].paths.append(path)
    with _settings(df.sparkSession, BATCH | CLEANED | SIZED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later stages start from files."""
    return cut_at(df, name)[0]


def observed_cut(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, and aggregates over the rows, taken while they are written."""
    seen = Observation(name)
    out = cut(df.observe(seen, *[v.alias(n) for n, v in figures.items()]), name)
    return out, {n: v or 0 for n, v in seen.get.items()}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``cut_at`` wrote and that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
