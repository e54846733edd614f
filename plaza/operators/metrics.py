"""Counts, coverage, ledgers and catalogue roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions.dates import DAY_MS, freshness_state, millis, moment
from plaza.functions.numbers import percent


def count_values(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Counts by falling number; ties keep first-seen order, given by ``first_seen``."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.col("n").desc(), "first_seen")


def count_by(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def facet_counts(rows: DataFrame, value: str, preferred: list[str]) -> DataFrame:
    """Counts with the rank of the preferred values first, 99 for the others, which sort by name."""
    rank = F.coalesce(*[F.when(F.col(value) == v, F.lit(k)) for k, v in enumerate(preferred)], F.lit(99)) if preferred else F.lit(99)
    return count_by(rows, value).withColumn("rank", rank).orderBy("rank", value)


def coverage(flags: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """Entities and share of them with each flag; ``flags`` may have many rows of an entity (evidence layers)."""
    once = flags.groupBy(id_col).agg(*[F.bool_or(n).alias(n) for n in names])
    wide = once.agg(F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in names])
    long = wide.select("total", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric", "n"))
    return long.select("metric", "n", "total", percent("n", "total").alias("pct"))


def duplicate_count(rows: DataFrame, keys: list) -> DataFrame:
    """One row: how many rows are beyond the first of their key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("duplicates"))


def duplicate_values(rows: DataFrame, value) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).where("n > 1")


def lane_ledger(attempts: DataFrame, as_of, target_hours: int) -> DataFrame:
    """Per lane: attempts, failures, rows without a clock, its oldest source clock, and the freshness that clock has.

    Needs lane, source, failed, reason and observed.
    """
    per_source = attempts.groupBy("lane", "source").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("f"), F.count_if(F.col("observed").isNull()).alias("u"), F.max("observed").alias("seen"), F.collect_set(F.when(F.col("failed"), F.col("reason"))).alias("why")
    )
    lanes = per_source.groupBy("lane").agg(F.sum("n").alias("attempts"), F.sum("f").alias("failures"), F.sum("u").alias("unknown"), F.min("seen").alias("oldest"), F.size(F.array_distinct(F.flatten(F.collect_list("why")))).alias("reasons"))
    return lanes.withColumn("state", freshness_state("oldest", as_of, target_hours))


def run_health(attempted: Column, failed: Column, records: Column, held: Column, fresh: Column) -> Column:
    """One state of a run from its counts."""
    return (
        F.when((attempted == 0) & (held > 0), "no_access")
        .when(attempted == 0, "not_attempted")
        .when((failed > 0) & (failed < attempted), "partial_failure")
        .when(failed >= attempted, "failure")
        .when(records == 0, "success_empty")
        .when(fresh, "success_fresh")
        .otherwise("success_stale")
    )


def catalogue(sources: DataFrame, identity: list[str], flags: list[str], clock: str, provenance: str) -> DataFrame:
    """One row of each source identity: joined flags, newest clock, distinct provenance; ties by nothing but content."""
    key = F.left(F.sha2(F.concat_ws("|", *identity), 256), F.lit(12)).alias("source_key")
    return sources.groupBy(key).agg(*[F.bool_or(f).alias(f) for f in flags], F.max(clock).alias(clock), F.array_sort(F.collect_set(provenance)).alias(provenance), F.count("*").alias("n"))


def state_counts(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count("*").alias("total"))


def url_universe(rows: DataFrame, url: str, kind: str, entity: str, order: str) -> DataFrame:
    """One row of each URL with its kinds and entities in first-seen order."""
    seen = lambda c: rows.groupBy(url, c).agg(F.min(order).alias("o")).groupBy(url).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c]).alias(f"{c}s"))
    return seen(kind).join(seen(entity), url)


def gap_reasons(rows: DataFrame, id_col: str, reasons: list[tuple[str, Column]]) -> DataFrame:
    """A row for each gap that an entity has, in the order given."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons]))
    return rows.select(id_col, F.posexplode(found).alias("rank", "reason"))


def summary_row(parts: list[DataFrame]) -> DataFrame:
    """One-row aggregates side by side."""
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)


def all_shared(rows: DataFrame, id_col: str, shared: str) -> DataFrame:
    """Entities all of whose keys are shared with others."""
    return rows.groupBy(id_col).agg(F.bool_and(shared).alias("x")).where("x").select(id_col)


def problems(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that hold, as an array; an unknown check doesn't hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def assert_no_problems(rows: DataFrame, column: str = "problems") -> None:
    """Raises if a row has a problem; the only action here."""
    bad = rows.where(F.size(column) > 0).limit(1).collect()
    if bad:
        raise ValueError(f"row with problems: {bad[0].asDict()}")


def age_in_days(column, as_of) -> Column:
    return (millis(moment(as_of)) - millis(column)) / DAY_MS
