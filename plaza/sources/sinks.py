"""Writers of release files. Tables are written by Spark; each reader gives back what its writer wrote."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plaza.functions.text import either, escape_html
from plaza.sources import release


def write_script(rows: DataFrame, folder: str, name: str) -> None:
    """``rows`` as lines ``window.NAME.push(...);``, the twin of a JSON-lines table that a page can load."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name} is no script name")
    rows.select(F.concat(F.lit(f"window.{name}.push("), F.to_json(F.struct(*rows.columns)), F.lit(");")).alias("value")).write.text(folder)


def read_script(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    body = F.regexp_extract("value", r"^window\.[A-Za-z0-9_]+\.push\((.*)\);$", 1)
    return spark.read.text(folder).select(F.from_json(body, schema).alias("row")).select("row.*")


def write_twins(rows: DataFrame, folder: str, name: str) -> None:
    """The same rows as JSON lines under ``json`` and as a script under ``script``."""
    rows.write.json(f"{folder}/json")
    write_script(rows, f"{folder}/script", name)


def twins_agree(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """One row: rows that only one twin has, and whether there are none."""
    a, b = spark.read.schema(schema).json(f"{folder}/json"), read_script(spark, f"{folder}/script", schema)
    side = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    both = side(a, b, "only_left").crossJoin(side(b, a, "only_right"))  # two tables of one row
    return both.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def write_tables(rows: DataFrame, folder: str, key: str, children: list[str], clock: str = "") -> None:
    """``rows`` as a parent table and one child table for each nested array, as a relational export has them: a new version of the release at ``folder``.

    A field of a child named like the key or ``ordinal`` (in any case) is written as ``item_`` and its name.
    """
    tables = {"parent": rows.drop(*children)}
    for child in children:
        items = rows.select(key, F.posexplode(child).alias("ordinal", "item"))
        fields = [F.col("item")[f].alias(f"item_{f}" if f.lower() in (key.lower(), "ordinal") else f) for f in items.schema["item"].dataType.names]
        tables[child] = items.select(key, "ordinal", *fields)
    release.publish(rows.sparkSession, folder, tables, clock)


def upsert(spark: SparkSession, folder: str, table: str, rows: DataFrame, keys: list[str], clock: str = "") -> None:
    """Replace or insert ``rows`` in a table of a release, as its next version; a release made meanwhile is not overwritten but raises."""
    now = release.current(spark, folder)
    old = release.table(spark, folder, table)
    fresh = old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
    release.publish(spark, folder, {table: fresh}, clock or now["clock"], now["sequence"])


def report(rows: DataFrame, title: str, heads: list[str]) -> DataFrame:
    """part and line of a Markdown report: title, heads and rule (parts 0 to 2), then one line of the table a row (part 3)."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|"))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    top = rows.sparkSession.createDataFrame([(0, f"# {title}"), (1, line(heads)), (2, line(["---"] * len(heads)))], "part int, line string")
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    return top.union(rows.select(F.lit(3).alias("part"), body.alias("line")))


def page(title, body, canonical) -> Column:
    """A page of a site, all values escaped."""
    return F.concat(
        F.lit("<!doctype html><html><head><title>"), escape_html(title), F.lit('</title><link rel="canonical" href="'), escape_html(canonical), F.lit('"></head><body><h1>'),
        escape_html(title), F.lit("</h1><p>"), escape_html(body), F.lit("</p></body></html>"),
    )


def sitemap(urls: DataFrame, column: str = "url", most: int = 40_000) -> DataFrame:
    """part and text of each file of a sitemap; urls are dealt by hash, about ``most`` to a file, as a file may hold 50,000."""
    parts = max(1, -(-urls.count() // most))
    part = F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    entry = F.concat(F.lit("<url><loc>"), escape_html(either(column)), F.lit("</loc></url>"))
    body = F.array_join(F.array_sort(F.collect_list("e")), "")
    return urls.select(part.alias("part"), entry.alias("e")).groupBy("part").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>")).alias("text"))


def promotable(files: DataFrame, allowed: list[str]) -> DataFrame:
    """``files`` (path, old_sha256, new_sha256) with ``state``: refused (no allowed pattern, an absolute path or one that climbs), unchanged or promoted.

    ``allowed``: paths in which ``*`` stands for a part without a slash.
    """
    rules = [F.col("path").rlike("^" + "[^/]*".join(map(re.escape, a.split("*"))) + "$") for a in allowed]
    ok = F.lit(False)
    for r in rules:
        ok = ok | r
    climbs = F.col("path").rlike(r"(^|/)\.\.?(/|$)|^/|\\|^[A-Za-z]:|//")
    return files.withColumn("state", F.when(climbs | ~ok, "refused").when(F.col("old_sha256").eqNullSafe(F.col("new_sha256")), "unchanged").otherwise("promoted"))


def deployed(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """expected (name, sha, records) against what a deployment reports (the same columns): name, state (ok, sha_differs, count_differs, missing)."""
    there = seen.select("name", F.col("sha").alias("_sha"), F.col("records").alias("_records"))
    rows = expected.join(there, "name", "left")
    state = F.when(F.col("_sha").isNull(), "missing").when(F.lower("sha") != F.lower("_sha"), "sha_differs").when(~F.col("records").eqNullSafe(F.col("_records")), "count_differs").otherwise("ok")
    return rows.select("name", state.alias("state"))
