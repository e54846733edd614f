"""JSON, script, CSV and calendar texts as rows, and back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaza.functions.text import either, escape_ics


def scan_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON payload under a declared schema; an empty table if it isn't there."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Quoted CSV with a header; blank rows are dropped."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.dropna("all")


def records(payload: Column, schema: StructType) -> Column:
    """The records of a payload, whichever of the known names holds them."""
    kind = f"array<{schema.simpleString()}>"
    names = ("records", "events", "results", "items", "posts")
    whole = F.from_json(payload, ", ".join(f"{n} {kind}" for n in names))
    return F.coalesce(*[whole[n] for n in names])


def json_rows(texts: DataFrame, column: str, schema: StructType) -> DataFrame:
    return texts.select(F.inline(records(F.col(column), schema)))


def script_payload(column) -> Column:
    """The JSON of a script ``window.NAME = {...};``."""
    return F.regexp_extract(either(column), "(?s)^\\s*window\\.[A-Za-z0-9_]+\\s*=\\s*(.*?);?\\s*$", 1)


def script_rows(texts: DataFrame, column: str, schema: StructType) -> DataFrame:
    return texts.select(F.inline(records(script_payload(column), schema)))


def ics_event(uid: Column, start: Column, summary: Column) -> Column:
    """One VEVENT; lines end in CR LF."""
    stamp = F.date_format(start, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART:"), stamp), F.concat(F.lit("SUMMARY:"), escape_ics(summary)), F.lit("END:VEVENT"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='plaza-')).rstrip('/')}/plaza-{uuid.uuid4().hex}"
