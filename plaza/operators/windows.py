"""Questions about neighbouring rows of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaza.functions.text import either


def follows(rows: DataFrame, key: list[str], order: list, step: str, name: str = "follows") -> DataFrame:
    """Rows with whether the number ``step`` is one above that of the row before; null for the first of a key."""
    before = F.lag(step).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn(name, either(step) - before == 1)


def islands(rows: DataFrame, key: list[str], day: str) -> DataFrame:
    """key, first, last, days: the runs of consecutive days of each key; a day that occurs twice counts once."""
    days = rows.select(*key, day).distinct()
    run = F.date_sub(day, F.row_number().over(Window.partitionBy(*key).orderBy(day)))
    return days.withColumn("_run", run).groupBy(*key, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("days")).drop("_run")


def full_blocks(rows: DataFrame, key: list[str], day: str, size: int) -> DataFrame:
    """key and the first day of every block of ``size`` consecutive days."""
    runs = islands(rows, key, day).where(F.col("days") >= size)
    return runs.select(*key, F.explode(F.sequence("first", F.date_sub("last", size - 1))).alias(day))


def key_counts(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows with how many rows have their key; counts are made first, so a hot key's rows aren't gathered."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias(name)), key)
