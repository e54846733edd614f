"""Hourly forecasts out of GeoJSON bodies, admitted whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions.dates import strict_instant
from plaza.operators import metrics as M

#: What a body must hold.
FEATURES, HOURS, MOST_BYTES = 2, 24, 512 * 1024
# Where an hour's measures stand, their units, and their bounds.
MEASURES = {
    "temperature_c": ("$.temperature", "C", -100, 70),
    "probability_percent": ("$.lop", "%", 0, 100),
    "wind_kmh": ("$.wind.speed", "km/h", 0, 500),
    "gust_kmh": ("$.wind.gust", "km/h", 0, 500),
}
_GROUP = "$.properties.hourlyForecastGroup"


def at(value, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def given(value: Column) -> Column:
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))


def measure(hour, path: str, unit: str, least: float, most: float) -> tuple[Column, Column, Column]:
    """A measure's value (null where none is given), whether its unit is another one, and whether it is no number within bounds."""
    node, raw = at(hour, path), at(hour, f"{path}.value.en")
    number = F.when(F.schema_of_variant(raw).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), at(hour, f"{path}.value.en", "double"))
    wrong_unit = given(node) & ~at(hour, f"{path}.units.en", "string").eqNullSafe(F.lit(unit))
    return number, wrong_unit, given(node) & given(raw) & ~F.coalesce(number.between(least, most), F.lit(False))


def _exploded(rows: DataFrame, list_: Column, place: str, value: str) -> DataFrame:
    """A row for each element of a list; one with nulls where there is no list."""
    named = rows.withColumn("_list", list_)
    out = named.lateralJoin(named.sparkSession.tvf.variant_explode_outer(F.col("_list").outer()))
    element = F.when(F.col("key").isNull(), F.col("value"))  # an object's fields have keys
    return out.select(*rows.columns, F.col("pos").alias(place), element.alias(value))


def forecast_hours(bodies: DataFrame, features: int = FEATURES, hours: int = HOURS) -> DataFrame:
    """id, problems, hour, valid_at and the ``MEASURES`` of each hour of each of ``bodies`` (id, body, retrieved_at).

    A body with problems gives a single row without hour. Problems: ``not_json``,
    ``too_large``, ``no_clock`` (retrieved_at is null), ``feature_count``, ``diverged`` (the
    features' hourly products differ), ``hour_count``, ``bad_clock`` (an instant can't
    be read), ``hour_gap``, ``not_after_issue``, ``issued_later`` (than it was
    retrieved), ``units`` and ``out_of_bounds`` (also a number given as text). Measures
    that are missing or null are null. Bodies of one id, or of none, count as one,
    whose features are then too many; rows without id are left out.

    Lists are opened by a lateral table function over VARIANT, and judged by
    aggregates with partial sums: hours follow each other if time less place is constant.
    """
    rows = bodies.where("id is not null").select("id", "body", "retrieved_at", F.try_parse_json("body").alias("raw"))
    told = _exploded(rows, at("raw", "$.features"), "nth", "feature")
    group = at("feature", _GROUP)
    told = told.select("id", "retrieved_at", "nth", "feature", F.col("raw").isNull().alias("not_json"), (F.octet_length("body") > MOST_BYTES).alias("too_large"), F.sha2(F.to_json(group), 256).alias("product"), strict_instant(at("feature", f"{_GROUP}.timestamp.en", "string")).alias("issued"))
    opened = _exploded(told.drop("not_json", "too_large", "product"), at("feature", f"{_GROUP}.hourlyForecasts"), "hour", "value")
    found = {name: measure("value", *of) for name, of in MEASURES.items()}
    valid = strict_instant(at("value", "$.timestamp", "string"))
    opened = opened.select("id", "nth", "hour", "issued", valid.alias("valid_at"), *[v.alias(n) for n, (v, _, _) in found.items()], F.array_contains(F.array(*[u for _, u, _ in found.values()]), True).alias("unit"), F.array_contains(F.array(*[b for _, _, b in found.values()]), True).alias("bound"))
    start = F.unix_timestamp("valid_at") - F.col("hour") * 3600
    each = opened.groupBy("id", "nth").agg(
        F.count("hour").alias("n"), F.count_if(F.col("hour").isNotNull() & F.col("valid_at").isNull()).alias("unread"), (F.min(start) != F.max(start)).alias("gap"),
        F.bool_or(F.col("valid_at") <= F.col("issued")).alias("early"), F.bool_or("unit").alias("unit"), F.bool_or("bound").alias("bound"),
    )
    each = each.groupBy("id").agg(F.bool_or(F.col("n") != hours).alias("hour_count"), (F.sum("unread") > 0).alias("unread"), *[F.bool_or(c).alias(c) for c in ("gap", "early", "unit", "bound")])
    whole = told.groupBy("id").agg(
        F.bool_or("not_json").alias("not_json"), F.bool_or("too_large").alias("too_large"), F.bool_or(F.col("retrieved_at").isNull()).alias("no_clock"),
        (F.count("feature") != features).alias("feature_count"), (F.min("product") != F.max("product")).alias("diverged"),
        F.bool_or(F.col("feature").isNotNull() & F.col("issued").isNull()).alias("unissued"), F.bool_or(F.col("issued") > F.col("retrieved_at").cast("timestamp")).alias("issued_later"),
    )
    c, readable = F.col, ~F.col("not_json")
    problems = M.problems([
        ("not_json", c("not_json")), ("too_large", c("too_large")), ("no_clock", c("no_clock")), ("feature_count", readable & c("feature_count")), ("diverged", c("diverged")),
        ("hour_count", readable & c("hour_count")), ("bad_clock", c("unread") | c("unissued")), ("hour_gap", c("gap")), ("not_after_issue", c("early")),
        ("issued_later", c("issued_later")), ("units", c("unit")), ("out_of_bounds", c("bound")),
    ])
    judged = whole.join(each, "id").select("id", problems.alias("problems"))
    good = opened.where("nth = 0").select("id", "hour", "valid_at", *MEASURES)
    return judged.join(good, (judged.id == good.id) & (F.size("problems") == 0), "left").select(judged.id, "problems", "hour", "valid_at", *MEASURES)
