"""Profiles that pages link: social profiles and link hubs, from anchors and linked data, by a registry of platforms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from plaza.functions import text as S
from plaza.functions.text import either
from plaza.sources.markup import html_links, json_blocks, walk

#: (id, kind, hosts, generic paths): a small registry; callers may pass their own.
PLATFORMS = [
    ("facebook", "social", ("facebook.com", "fb.com"), ("sharer", "share", "plugins", "tr", "events", "groups", "pages")),
    ("instagram", "social", ("instagram.com",), ("p", "reel", "explore", "accounts")),
    ("tiktok", "social", ("tiktok.com",), ()),
    ("x", "social", ("x.com", "twitter.com"), ("intent", "share", "home", "search")),
    ("youtube", "social", ("youtube.com",), ("watch", "embed", "playlist", "results")),
    ("linkedin", "social", ("linkedin.com",), ("sharearticle", "in")),
    ("linktree", "link_hub", ("linktr.ee",), ("login", "register")),
]
# How sure an association is, by where the link stood.
CONFIDENCE = {"linked_from_official_website": "authoritative", "linked_from_official_location_page": "authoritative", "jsonld_sameAs": "authoritative", "linked_from_official_link_hub": "very_high"}
RANK = {"authoritative": 3, "very_high": 2, "high": 1}


def handle(platform: Column, url) -> Column:
    """The name of a profile in its URL, after each platform's own path rules; null where the URL is no profile."""
    parts = F.filter(F.split(F.try_url_decode(S.url_path(url)), "/"), lambda p: p != "")
    at = lambda k: F.get(parts, k)
    first = F.regexp_replace(at(0), "^@", "")
    page_id = F.regexp_extract(S.url_query(url), "(?:^|&)id=([^&]+)", 1)
    low = F.lower(at(0))
    return S.truthy(
        F.when((platform == "facebook") & (low == "profile.php"), S.truthy(page_id)).when((platform == "facebook") & (low == "permalink.php"), F.lit(None))
        .when(platform == "tiktok", F.regexp_replace(F.get(F.filter(parts, lambda p: F.startswith(p, F.lit("@"))), 0), "^@", ""))
        .when((platform == "youtube") & low.isin("channel", "c", "user"), at(1))
        .when(platform == "linkedin", F.when(low.isin("company", "showcase", "school") & at(1).isNotNull(), F.concat_ws("/", at(0), at(1))))
        .when((platform == "bluesky") & (low == "profile"), at(1)).when((platform == "snapchat") & (low == "add"), at(1)).otherwise(first)
    )


def profile(url, registry=PLATFORMS) -> Column:
    """platform, kind and handle of a profile's URL; null for any other."""
    host = S.host_key(url)
    on = lambda hosts: host.isin(*hosts) | F.exists(F.array(*[F.lit("." + h) for h in hosts]), lambda h: F.endswith(host, h))
    found = F.lit(None).cast("struct<id:string,kind:string,generic:array<string>>")
    for name, kind, hosts, generic in reversed(registry):
        found = F.when(on(hosts), F.struct(F.lit(name).alias("id"), F.lit(kind).alias("kind"), F.array(*map(F.lit, generic)).cast("array<string>").alias("generic"))).otherwise(found)
    own = handle(found["id"], url)
    first = F.lower(F.regexp_extract(S.url_path(url), "^/@?([^/]*)", 1))
    ok = found.isNotNull() & own.isNotNull() & ~F.array_contains(found["generic"], first)
    return F.when(ok, F.struct(found["id"].alias("platform"), found["kind"].alias("kind"), own.alias("handle")))


@F.pandas_udf(ArrayType(StringType()))
def same_as(html: pd.Series) -> pd.Series:
    """URLs that a page's linked data names as the same, in order; malformed blocks are skipped."""

    def one(page):
        out = []
        for block in json_blocks(page, "application/ld+json"):
            for node in walk(block):
                value = node.get("sameAs")
                out += [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)]
        return out

    return html.map(one)


def feeds(html) -> Column:
    """Addresses of the feeds that a page's head declares, as they are written."""
    tags = F.regexp_extract_all(either(html), F.lit(r"(?i)<link\b[^>]*>"), 0)
    feed = F.filter(tags, lambda t: t.rlike(r"(?i)\brel=[\"']?alternate") & t.rlike(r"(?i)\btype=[\"']application/(rss|atom)\+xml"))
    return F.filter(F.transform(feed, lambda t: F.regexp_extract(t, r"(?i)\bhref=[\"']([^\"']+)", 1)), lambda h: h != "")


def profiles(pages: DataFrame, key: str, html: str, url: str, basis: str = "linked_from_official_website", registry=PLATFORMS) -> DataFrame:
    """key, platform, kind, handle, url, basis, confidence: one row for each profile of a key, that of the surest link, then the first.

    Links are a page's anchors and what its linked data names as the same.
    """
    anchors = F.transform(html_links(html, url), lambda x: F.struct(x["ordinal"].cast("int").alias("at"), x["url"].alias("url"), F.lit(basis).alias("basis")))
    named = F.transform(same_as(html), lambda u, k: F.struct((k + 1_000_000).cast("int").alias("at"), u.alias("url"), F.lit("jsonld_sameAs").alias("basis")))
    links = pages.select(key, anchors.alias("_a"), named.alias("_n")).select(key, F.inline(F.concat("_a", "_n")))
    sure = F.coalesce(*[F.when(F.col("basis") == b, c) for b, c in CONFIDENCE.items()], F.lit("high"))
    rows = links.withColumns({"_p": profile("url", registry), "confidence": sure}).where("_p is not null").select(key, "_p.*", "url", "basis", "confidence", "at")
    rank = F.coalesce(*[F.when(F.col("confidence") == c, -r) for c, r in RANK.items()])
    best = rows.groupBy(key, "platform", F.lower("handle").alias("_h")).agg(F.min_by(F.struct("kind", "handle", "url", "basis", "confidence"), F.struct(rank.alias("r"), "at")).alias("_b"))
    return best.select(key, "platform", "_b.*")
