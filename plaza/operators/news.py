"""Registries of news sources and accepted items, judged row by row with their problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaza.functions import text as S
from plaza.operators import metrics as M

# Kinds of sources, and the longest texts of a source and an item.
KINDS = ("newsroom", "official_public_notice", "library_notice", "local_business_publication")
SOURCE_TEXTS = {"source_id": 80, "name": 150}
ITEM_TEXTS = {"title": 300, "guid": 1000, "region": 80, "region_evidence": 1000, "reviewer": 150, "rights_basis": 1500}
MOST_TOPICS, TOPIC, SUMMARY = 8, 50, 600


def plain(column, most: int) -> Column:
    """A text with something in it, no longer than ``most``, without white space at its ends, angle brackets or control characters; false for null."""
    text = S.either(column)
    return F.coalesce(text.rlike(r"^[^<>\x00-\x1f]+$") & ~text.rlike(r"^\s|\s$") & (F.char_length(text) <= most), F.lit(False))


def instant(text) -> Column:
    """A strict instant with milliseconds and Z; null for anything else, such as an impossible day."""
    value = S.either(text)
    at = F.try_to_timestamp(F.regexp_extract(value, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}\.[0-9]{3})Z$", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return F.when(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == value, at)


def _published(precision: Column, text: Column) -> Column:
    day = F.try_to_timestamp(F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text), F.lit("yyyy-MM-dd"))
    return F.when(precision == "day", day).when(precision == "instant", instant(text))


def registry_problems(sources: DataFrame) -> DataFrame:
    """source_id and problems of each row of ``sources`` (source_id, name, kind, hosts, enabled, status, home_url, feed_url, reviewed_at, evidence: map).

    ``repeated_id``, ``text``, ``kind``, ``hosts``, ``status``, ``url`` (home or feed isn't
    a canonical address of its hosts), ``not_admitted`` (enabled, yet not admitted or
    without a feed), ``evidence`` (admitted without a review's time, or without each
    of access, schema, date and rights). A null flag or status is a problem.
    """
    c = F.col
    shared = sources.where("source_id is not null").groupBy("source_id").agg((F.count("*") > 1).alias("_many"))
    rows = sources.join(shared, "source_id", "left")
    of_host = lambda url: _own(c(url), c("hosts"))
    hosts = (F.size("hosts") > 0) & F.forall("hosts", lambda h: F.coalesce(h.rlike("^[a-z0-9.-]+$"), F.lit(False)))
    shown = [plain(F.try_element_at("evidence", F.lit(k)), 1500) for k in ("access", "schema", "date", "rights")]
    said = M.problems([
        ("repeated_id", c("_many")),
        ("text", ~(plain("source_id", SOURCE_TEXTS["source_id"]) & plain("name", SOURCE_TEXTS["name"]))),
        ("kind", ~F.coalesce(c("kind").isin(*KINDS), F.lit(False))),
        ("hosts", ~F.coalesce(hosts, F.lit(False))),
        ("status", ~F.coalesce(c("status").isin("proposed", "admitted") & c("enabled").isNotNull(), F.lit(False))),
        ("url", ~of_host("home_url") | (c("feed_url").isNotNull() & ~of_host("feed_url"))),
        ("not_admitted", c("enabled") & ~F.coalesce((c("status") == "admitted") & c("feed_url").isNotNull(), F.lit(False))),
        ("evidence", (c("status") == "admitted") & ~(instant("reviewed_at").isNotNull() & F.forall(F.array(*shown), lambda ok: ok))),
    ])
    return rows.select("source_id", said.alias("problems"))


def _own(url: Column, hosts: Column) -> Column:
    """Whether an address is canonical and stands on one of the hosts."""
    host = F.regexp_extract(url, "^https://([^/?#]*)", 1)
    return F.coalesce(S.canonical_url(url).eqNullSafe(url) & F.array_contains(hosts, host), F.lit(False))


def item_problems(items: DataFrame, sources: DataFrame) -> DataFrame:
    """id and problems of each accepted item.

    ``items``: id, url, source_id, source_name, kind, guid, title, region,
    region_evidence, topics, published_at, precision (day or instant), modified_at,
    observed_at, reviewed_at, correction, summary, summary_kind, reviewer, rights_basis
    (texts, as they were landed). ``sources``: as for ``registry_problems``, one row an id.

    ``repeated_id``, ``repeated_url`` (of another item too), ``unknown_source`` (none that is
    admitted), ``source_differs``, ``url``, ``text``, ``topics``, ``dates`` (one can't be
    read), ``clock_order`` (published, observed, reviewed; modified between the first
    two), ``correction``, ``summary`` (none, or a reviewed one). Null ids and urls don't repeat.
    """
    c = F.col
    many = lambda key: items.where(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") > 1).alias(f"_many_{key}")).where(f"_many_{key}")
    known = sources.where("status = 'admitted'").select("source_id", F.col("name").alias("_name"), F.col("kind").alias("_kind"), F.col("hosts").alias("_hosts"))
    rows = items.join(many("id"), "id", "left").join(many("url"), "url", "left").join(known, "source_id", "left")
    published, observed, reviewed, modified = _published(c("precision"), c("published_at")), instant("observed_at"), instant("reviewed_at"), instant("modified_at")
    order = (published <= observed) & (observed <= reviewed) & F.coalesce((published <= modified) & (modified <= observed), F.lit(True))
    topics = (F.size("topics") <= MOST_TOPICS) & F.forall("topics", lambda t: plain(t, TOPIC))
    summary = (c("summary").isNull() & (c("summary_kind") == "none")) | (plain("summary", SUMMARY) & (c("summary_kind") == "reviewed_original"))
    texts = [plain(name, most) for name, most in ITEM_TEXTS.items()]
    never = lambda ok: ~F.coalesce(ok, F.lit(False))
    said = M.problems([
        ("repeated_id", c("_many_id")),
        ("repeated_url", c("_many_url")),
        ("unknown_source", c("_hosts").isNull()),
        ("source_differs", c("_hosts").isNotNull() & ~(c("_name").eqNullSafe(c("source_name")) & c("_kind").eqNullSafe(c("kind")))),
        ("url", c("_hosts").isNotNull() & never(_own(c("url"), c("_hosts")) & (c("id") == F.concat(F.lit("news-"), F.left(F.sha2("url", 256), F.lit(24)))))),
        ("text", never(F.forall(F.array(*texts), lambda ok: ok))),
        ("topics", never(topics)),
        ("dates", published.isNull() | observed.isNull() | reviewed.isNull() | (c("modified_at").isNotNull() & modified.isNull())),
        ("clock_order", ~order),
        ("correction", never(c("correction").isin("none", "corrected"))),
        ("summary", never(summary)),
    ])
    return rows.select("id", said.alias("problems"))
