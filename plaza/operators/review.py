"""Reviewed decisions over rows: overlays, exclusions, queues, and validation of what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions import text as S
from plaza.functions.text import either
from plaza.operators.metrics import problems


def decide_posts(posts: DataFrame, decisions: DataFrame, as_of: Column, keep_days: int = 60, review_days: int = 30) -> DataFrame:
    """Posts (id, url, published) with decision, expires_at, review_due_at, current.

    ``decisions``: id, url, decision, expires_at, review_due_at; one is found by id,
    else by url. An approved post without dates expires ``keep_days`` after it was
    published and is due for review after ``review_days``; posts without a
    decision are undecided and never current.
    """
    names = ("decision", "expires_at", "review_due_at")
    by = lambda key, p: decisions.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, F.struct(F.col("decision").isNotNull(), *names)).alias(f"{p}_{c}") for c in names])
    rows = posts.join(by("id", "_i"), "id", "left").join(by("url", "_u"), "url", "left")
    use = lambda c: F.when(F.col("_i_decision").isNotNull(), F.col(f"_i_{c}")).otherwise(F.col(f"_u_{c}"))
    after = lambda days: F.col("published") + F.make_dt_interval(F.lit(days))
    rows = rows.withColumns({"decision": F.coalesce(use("decision"), F.lit("undecided")), "expires_at": F.coalesce(use("expires_at"), after(keep_days)), "review_due_at": F.coalesce(use("review_due_at"), after(review_days))})
    current = (F.col("decision") == "approved") & (F.col("expires_at") > as_of) & (F.col("review_due_at") > as_of)
    return rows.withColumn("current", F.coalesce(current, F.lit(False))).select(*posts.columns, *names, "current")


def without_reviewed(rows: DataFrame, exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no exclusion equals in every key; a null key is never excluded."""
    return rows.join(exclusions.select(*keys).distinct(), keys, "left_anti")


def correct_occurrences(rows: DataFrame, fixes: DataFrame, keys: list[str], column: str, sources: str = "source") -> DataFrame:
    """``rows`` with ``column`` from the fix of that very occurrence, and ``corrected``.

    A fix holds only for rows whose source is in its ``sources`` (null: all). Of
    several fixes that hold for a row, the largest value stands; rows stay one each.
    """
    own = fixes.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col(column).alias("to"), F.col("sources").alias("sources")))).alias("_fixes"))
    holds = lambda fix: fix["sources"].isNull() | F.coalesce(F.array_contains(fix["sources"], F.col(sources)), F.lit(False))
    joined = rows.join(own, keys, "left").withColumn("_fixes", F.filter("_fixes", holds)).withColumn("corrected", F.coalesce(F.size("_fixes") > 0, F.lit(False)))
    joined = joined.withColumn("_to", F.try_element_at("_fixes", F.lit(-1))["to"])
    return joined.withColumn(column, F.when(F.col("corrected"), F.col("_to")).otherwise(F.col(column))).select(*rows.columns, "corrected")


def field_rejections(rows: DataFrame, reviews: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` whose reviewed fields are null (rejected) or overridden, with ``audit``: ``field:rejected`` or ``field:overridden`` in the order of ``fields``.

    ``reviews``: key, field, verdict (reject or override), value, and at where there
    is such a column. Of several reviews of a field the latest stands (a null at is
    the earliest), then reject over override, then the largest value. Types stay.
    """
    order = F.struct(*([F.col("at")] if "at" in reviews.columns else []), "verdict", "value")
    once = reviews.where("field is not null").groupBy(key, "field").agg(F.max_by(F.struct("verdict", "value"), order).alias("_v"))
    packed = once.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "_v"))).alias("_r"))
    joined = rows.join(packed, key, "left")
    review = lambda f: F.try_element_at("_r", F.lit(f))
    audit = F.array_compact(F.array(*[F.when(review(f)["verdict"] == "reject", F.lit(f"{f}:rejected")).when(review(f)["verdict"] == "override", F.lit(f"{f}:overridden")) for f in fields]))
    kinds = dict(rows.dtypes)
    new = {f: F.when(review(f)["verdict"] == "reject", F.lit(None)).when(review(f)["verdict"] == "override", review(f)["value"].cast(kinds[f])).otherwise(F.col(f)) for f in fields}
    return joined.withColumn("audit", audit).withColumns(new).select(*rows.columns, "audit")


def queue(rows: DataFrame, decisions: DataFrame, key: str, source_kinds: list[str] | None = None, review_states: list[str] | None = None, decision: str = "all") -> DataFrame:
    """Candidates of a review queue by kind of source, review state and decision (all, undecided or a decision's name); of several decisions on a key the last one by name stands."""
    out = rows.join(decisions.groupBy(key).agg(F.max("decision").alias("decision")), key, "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))
    for column, wanted in (("source_kind", source_kinds), ("review_state", review_states)):
        out = out.where(F.col(column).isin(*wanted)) if wanted else out
    return out if decision == "all" else out.where(F.col("decision") == decision)


def pointer_safe(rows: DataFrame, rejected: DataFrame, keys: list[str], branch: Column) -> DataFrame:
    """``rows`` with ``safe``: not among the rejected (entity, kind, url) and not on the page of another branch (``branch``)."""
    out = rows.join(rejected.select(*keys).distinct().withColumn("_no", F.lit(True)), keys, "left")
    return out.withColumn("safe", F.col("_no").isNull() & ~F.coalesce(branch, F.lit(False))).drop("_no")


# What shows that a link is a template, an embed call or a page of no place.
TEMPLATE = r"\{\{|\}\}|\$\{|%7B%7B|<%"
EMBED = r"(?i)/oembed(?:[/?]|$)|[?&]format=(?:json|xml)\b.*\boembed|/wp-json/"
GENERIC_PATHS = ("", "/", "/home", "/index.html", "/login", "/signin", "/search", "/cart", "/privacy", "/terms")


def rejected_link(url) -> Column:
    """template, oembed or generic_path; null for a link that may stay."""
    path = F.lower(F.regexp_replace(S.url_path(url), "/+$", ""))
    bare = path.isin(*[p.rstrip("/") for p in GENERIC_PATHS]) & (S.url_query(url) == "")
    return F.when(either(url).rlike(TEMPLATE), "template").when(either(url).rlike(EMBED), "oembed").when(bare, "generic_path")


def publication_problems(media: DataFrame) -> Column:
    """Why a row of media (url, alt, credit, rights, width, height, reviewed_at, expires_at, as_of) may not be published; none for what may."""
    blank = lambda c: S.truthy(F.col(c)).isNull()
    return problems([
        ("url is not https", ~F.coalesce(F.startswith("url", F.lit("https://")), F.lit(False))), ("no alternative text", blank("alt")), ("no credit", blank("credit")),
        ("rights not approved", ~F.col("rights").eqNullSafe(F.lit("production_approved"))), ("no size", ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))),
        ("not reviewed", F.col("reviewed_at").isNull()), ("reviewed in the future", F.col("reviewed_at") > F.col("as_of")), ("expired", F.col("expires_at") <= F.col("as_of")),
    ])


def fold_decisions(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """key and state of each item after its decisions in order (at, then decision): pending, approved, rejected or withdrawn; only what was approved can be withdrawn."""
    last = decisions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "decision"))).alias("_d"))
    step = lambda acc, d: F.when((d["decision"] == "withdrawn") & (acc != "approved"), acc).otherwise(d["decision"])
    state = F.coalesce(F.aggregate("_d", F.lit("pending"), step), F.lit("pending"))
    return items.select(key).join(last, key, "left").select(key, state.alias("state"))


def index_fits(index: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """key and state of each response to a byte range: fits, missing (no index row), ambiguous (several) or mismatch.

    ``index``: key, offset, length; ``responses``: key, first and last byte asked, and the size of the body.
    """
    rows = index.groupBy(*key).agg(F.count("*").alias("_n"), F.first("offset").alias("_o"), F.first("length").alias("_l"))
    joined = responses.join(rows, key, "left")
    fits = (F.col("_o") == F.col("first")) & (F.col("_l") == F.col("last") - F.col("first") + 1) & (F.col("size") == F.col("_l"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(fits, "fits").otherwise("mismatch")
    return joined.select(*key, state.alias("state"))


# The towns in the order in which an address is searched for them, and the one where nothing tells.
TOWNS, SEARCHED, DEFAULT_TOWN = ("Halifax", "Dartmouth", "Bedford"), ("dartmouth", "bedford", "halifax"), "Halifax"


def municipality(city, address) -> Column:
    """A town that the city field names exactly, else the first that city or address holds, else the city as it is, else the default."""
    named = F.trim(F.coalesce(either(city), F.lit("")))
    text = F.lower(F.concat(named, F.lit(" "), F.coalesce(either(address), F.lit(""))))
    exact = F.coalesce(*[F.when(F.lower(named) == t.lower(), t) for t in TOWNS])
    held = F.coalesce(*[F.when(F.contains(text, F.lit(t)), t.capitalize()) for t in SEARCHED])
    return F.coalesce(exact, held, S.truthy(named), F.lit(DEFAULT_TOWN))
