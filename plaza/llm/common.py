"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular-expression class.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="plaza-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and go on from there; Spark's cleaner may delete it when it is out of use."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


class Scratch:
    """Intermediate tables as Parquet in the shared folder, deleted together at the end of the ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, 0
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_):
        discard(self.spark, self.folder)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names (in any case) an operator will add."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


_held: list = [None, None]


def worker_memory(key, make):
    """What a worker process keeps between tasks under ``key``. Only the last key's is kept, so operators don't add up."""
    if _held[0] != key:
        if _held[0] is not None:
            _held[:] = None, None
            _give_back()
        _held[:] = key, make()
    return _held[1]


def _give_back() -> None:
    """Give free memory back to the system, where its allocators can be told to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(rows):
    """``rows`` as a function over Arrow batches that gives memory back at its end; worker processes live on between tasks."""

    def run(batches):
        yield from rows(batches)
        _give_back()

    return run


def forget() -> None:
    """Let go of what ``worker_memory`` keeps; for operators that keep nothing themselves."""
    _held[:] = None, None


def or_empty(text) -> Column:
    return F.coalesce(text, F.lit(""))
