"""Versions of a set of tables that appear as a whole or not at all.

A release folder holds version folders and one pointer, ``CURRENT``. A version is
written by Spark's own committers, its files are listed with their sizes and
SHA-256 digests, and only then does the pointer change, by one rename over the
old one. A run that fails or is killed leaves the pointer, and so what readers
see, as it was; its folder is nobody's and goes with the next ``retire``. A
release that was made from an older version than the current one, or whose clock
is older, is refused.

All paths are those of the Hadoop file system, so a release can be wherever Spark
writes. Renaming over a file has to be atomic there, as on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT = "CURRENT"


class Stale(ValueError):
    """A release that would take the place of a newer one."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> dict | None:
    """The pointer: sequence, clock, tables (name to folder), manifest; null before the first release."""
    fs, at = _fs(spark, folder), _path(spark, f"{folder}/{CURRENT}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current version."""
    now = current(spark, folder)
    if now is None or name not in now["tables"]:
        raise ValueError(f"{folder} has no table {name}")
    return spark.read.parquet(f"{folder}/{now['tables'][name]}")


def inventory(spark: SparkSession, folder: str, tables: dict[str, str]) -> DataFrame:
    """file, bytes, sha256 of every file of the tables; each file is read in one task, so a table's files should be of usual size."""
    parts = [f"{folder}/{at}" for at in tables.values()]
    if not parts:
        return spark.createDataFrame([], "file string, bytes long, sha256 string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(parts)
    return files.select(F.concat_ws("/", F.slice(F.split("path", "/"), -3, 3)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], clock: str, based_on: int | None = None) -> dict:
    """Write ``tables`` as a new version and make it current; tables that it doesn't name stay as they are.

    ``clock`` is the time of the data as ISO text, and ``based_on`` the sequence
    that the tables were made from, if they were made from one: a release raises
    ``Stale`` when the current one has a later clock or another sequence.
    """
    before = current(spark, folder) or {"sequence": 0, "clock": "", "tables": {}}

    def refuse(now: dict) -> None:
        if clock < now["clock"] or (based_on is not None and based_on != now["sequence"]):
            raise Stale(f"{folder} is at {now['sequence']} of {now['clock']}")

    refuse(before)
    version = f"v-{uuid.uuid4().hex}"
    fs = _fs(spark, folder)
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{version}/{name}")
        places = {**before["tables"], **{name: f"{version}/{name}" for name in tables}}
        inventory(spark, folder, places).write.parquet(f"{folder}/{version}/manifest")
        pointer = {"sequence": before["sequence"] + 1, "clock": clock, "tables": places, "manifest": f"{version}/manifest"}
        out = fs.create(_path(spark, f"{folder}/{version}/pointer"), False)
        out.write(json.dumps(pointer).encode())
        out.close()
        now = current(spark, folder) or before
        refuse(now)
        if now["sequence"] != before["sequence"]:
            raise Stale(f"{folder} went on to {now['sequence']} meanwhile")
        files = spark._jvm.org.apache.hadoop.fs
        over = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        over[0] = files.Options.Rename.OVERWRITE
        files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, f"{folder}/{version}/pointer"), _path(spark, f"{folder}/{CURRENT}"), over)
    except BaseException:
        fs.delete(_path(spark, f"{folder}/{version}"), True)
        raise
    return pointer


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """file and state (missing, extra, changed) of each file that is not as the current manifest has it; no row when all are."""
    now = current(spark, folder)
    listed = spark.read.parquet(f"{folder}/{now['manifest']}")
    there = inventory(spark, folder, now["tables"]).withColumnsRenamed({"bytes": "bytes_", "sha256": "sha256_"})
    state = F.when(F.col("sha256_").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("sha256") != F.col("sha256_"), "changed")
    return listed.join(there, "file", "full").select("file", state.alias("state")).where("state is not null")


def retire(spark: SparkSession, folder: str) -> list[str]:
    """Delete the version folders that the current version doesn't use; their names. Not while another release is being written."""
    now = current(spark, folder)
    used = {place.split("/")[0] for place in [*now["tables"].values(), now["manifest"]]} if now else set()
    fs = _fs(spark, folder)
    names = [status.getPath().getName() for status in fs.listStatus(_path(spark, folder))]
    gone = sorted(n for n in names if n.startswith("v-") and n not in used)
    for name in gone:
        fs.delete(_path(spark, f"{folder}/{name}"), True)
    return gone
