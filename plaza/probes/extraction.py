"""Sources and extraction over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from plaza.functions import dates as D
from plaza.functions import numbers as N
from plaza.functions import schedules as H
from plaza.functions import text as S
from plaza.functions.dates import strict_instant
from plaza.operators import facts
from plaza.probes.base import AS_OF, probe
from plaza.sources import crawl, discovery, files, geojson, markup, meta, paged, trees

_LINKS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
_HOST = r"regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www|m)\.', '')"


@probe("src-01", "SELECT r_regionkey, r_name, r_regionkey % 2 = 0 AS read FROM region")
def _(t):
    good = F.to_json(F.struct("r_name"))
    raw = F.when(F.col("r_regionkey") % 2 == 0, good).otherwise("{broken")
    value = F.from_json(raw, "r_name string")["r_name"]
    return t.region.select("r_regionkey", F.coalesce(value, F.col("r_name")).alias("r_name"), value.isNotNull().alias("read"))


@probe("src-02", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def _(t):
    script = F.concat(F.lit("window.DOCS = "), F.to_json(F.struct("doc_id", "text")), F.lit(";\n"))
    read = F.from_json(files.script_payload(script), "doc_id long, text string")
    return t.documents.select(read.alias("r")).select("r.doc_id", F.md5("r.text").alias("text_md5"))


@probe("src-03", """SELECT r_regionkey, r_name || ', "x"' AS r_name FROM region""")
def _(t):
    line = F.concat_ws(",", F.col("r_regionkey").cast("string"), S.escape_csv(F.concat("r_name", F.lit(', "x"'))))
    return t.region.select(F.from_csv(line, "r_regionkey int, r_name string", {"escape": '"'}).alias("r")).select("r.*")


def rss(t):
    """Each page as a feed of one item; every fourth is cut off."""
    clean = S.escape_html(F.regexp_extract("html", "<title>([^<]*)", 1))
    stamp = F.date_format(F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("page_id") % 24).cast("int")), "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    xml = F.concat(F.lit("<rss><channel><item><title>"), clean, F.lit("</title><link>"), S.escape_html("url"), F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item></channel>"))
    return t.pages.withColumn("xml", F.when(F.col("page_id") % 4 == 0, xml).otherwise(F.concat(xml, F.lit("</rss>"))))


@probe("src-04", "SELECT page_id, page_id % 4 <> 0 AS valid, CASE WHEN page_id % 4 <> 0 THEN url END AS link FROM pages")
def _(t):
    rows = rss(t).select("page_id", markup.feed_entries("xml").alias("e"))
    return rows.select("page_id", F.col("e").isNotNull().alias("valid"), F.col("e")[0]["link"].alias("link"))


@probe("src-05", "SELECT min(page_id) AS page_id, news_id, arg_min(day, page_id) AS day FROM (SELECT page_id, left(sha256(split_part(split_part(url, '?', 1), '#', 1)), 16) AS news_id, '2024-01-' || lpad(CAST(16 + (page_id % 24 + 12) // 24 AS VARCHAR), 2, '0') AS day FROM pages WHERE page_id % 4 <> 0 AND url LIKE 'https://%' AND url NOT LIKE '%?page%') GROUP BY news_id")
def _(t):
    items = rss(t).where(~F.contains("url", F.lit("?page"))).select("page_id", F.inline(markup.feed_entries("xml")))
    rows = items.select("page_id", S.canonical_url("link").alias("url"), strict_instant("published").alias("at")).where("url is not null and at is not null")
    w = Window.partitionBy("url").orderBy("page_id")
    rows = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    return rows.select("page_id", S.hash_id(["url"]).alias("news_id"), F.date_format("at", "yyyy-MM-dd").alias("day"))


@probe("src-06", "SELECT page_id, CAST(1 AS BIGINT) AS entries FROM pages WHERE page_id % 4 <> 0")
def _(t):
    return rss(t).select("page_id", markup.owned_feed_entries("xml").alias("e")).where("e is not null").select("page_id", F.size("e").cast("long").alias("entries"))


@probe("src-07", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), ' '), '[.!?]+ '), lambda x: trim(x)), lambda x: length(x) BETWEEN 12 AND 700)) AS sentences FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(sentences("text")).cast("long").alias("sentences"))


_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # what Unicode calls space separators


def sentences(column):
    """Sentences of 12 to 700 characters, without space separators around them."""
    parts = F.split(F.replace(S.either(column), F.lit("\n"), F.lit(" ")), "[.!?]+ ")
    return F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(_SPACES))), lambda x: F.length(x).between(12, 700))


@probe("src-08", "SELECT event_id, CAST(event_id AS VARCHAR) AS uid, event_type || ', free; now' AS summary, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS starts FROM events")
def _(t):
    text = files.ics_event(F.col("event_id").cast("string"), F.col("ts"), F.concat("event_type", F.lit(", free; now")))
    folded = F.concat(F.substr(text, F.lit(1), F.lit(40)), F.lit("\r\n "), F.substr(text, F.lit(41)))
    return t.events.select("event_id", F.inline(markup.ics_events(folded))).select("event_id", "uid", "summary", "starts")


@probe("src-09", f"SELECT page_id, 'MusicEvent' AS type, CAST(page_id AS VARCHAR) AS name, '2024-01-20' AS start FROM pages WHERE page_id % 3 = 0")
def _(t):
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Place"},{"@type":["MusicEvent"],"name":"'), F.col("page_id").cast("string"), F.lit('","startDate":"2024-01-20"}]}</script><script type="application/ld+json">{broken</script>'))
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("html", block)).otherwise(F.col("html")).alias("html"))
    return rows.select("page_id", F.inline(markup.jsonld_events("html"))).select("page_id", "type", "name", "start")


@probe("src-10", "SELECT page_id, 'ours' AS home, '2024-02-0' || (page_id % 9 + 1) AS start FROM pages")
def _(t):
    block = F.concat(F.lit('<script type="application/json">{"a":{"b":[{"start":"2024-02-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('","home":"ours"},{"start":"x","home":"theirs"}]}}</script>'))
    games = t.pages.select("page_id", F.inline(markup.embedded_games(F.concat("html", block))))
    return games.where("home = 'ours'").select("page_id", "home", "start")


@probe("src-11", "SELECT page_id, CAST(row AS INT) AS row, CASE WHEN row < 3 THEN 'n' || page_id || '-' || row END AS name, CASE WHEN row < 3 THEN 'Town' END AS town, CASE WHEN row = 3 THEN 'cells_differ' END AS rejection FROM pages, range(1, 4) r(row)")
def _(t):
    """A table of two good rows and one that lacks a cell, behind each page's own content."""
    n = F.col("page_id").cast("string")
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> <i>"), c, F.lit("</i> </td>")) for c in cells], F.lit("</tr>"))
    named = lambda k: F.concat(F.lit("n"), n, F.lit(f"-{k}"))
    html = F.concat("html", F.lit("<table><tr><th>Name</th><th>Town</th></tr>"), row(named(1), F.lit("Town")), row(named(2), F.lit("Town")), row(named(3)), F.lit("</table>"))
    rows = trees.table_records(trees.page_nodes(t.pages.select("page_id", html.alias("html")), "page_id"), "page_id")
    return rows.select("page_id", "row", F.col("record")["Name"].alias("name"), F.col("record")["Town"].alias("town"), "rejection")


@probe("src-12", """
SELECT page_id, 'Talk ' || page_id AS title, 'https://a.example/e/' || page_id AS url, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS start, CAST(NULL AS VARCHAR) AS rejection, CAST(1 AS BIGINT) AS n FROM pages
UNION ALL SELECT page_id, NULL, NULL, NULL, rejection, n FROM pages, (VALUES ('several_headings', 1), ('no_link', 2), ('no_date', 1)) r(rejection, n)""")
def _(t):
    """Cards behind each page's own content: one event, four that lack something, and one that is cut off; what is rejected is counted."""
    n = F.col("page_id").cast("string")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    whole = F.concat(F.lit("<div class='talk new'><h2> Talk "), n, F.lit("</h2><p>Room 1</p><time datetime='"), day, F.lit("'>soon</time><a href='/e/"), n, F.lit("'>more</a></div>"))
    others = "<div class=talk><h2>a</h2><h2>b</h2></div><div class=talk><h2>a</h2><time>2024-02-02</time></div><div class=talk><h2>a</h2><a href='#x'>x</a></div><div class=talk><h2>a</h2><a href=e>x</a></div><div class=talk><h2>cut"
    nodes = trees.page_nodes(t.pages.select("page_id", F.concat("html", whole, F.lit(others)).alias("html")), "page_id")
    fields = {"heading": F.col("tag") == "h2", "link": F.col("tag") == "a", "date": F.col("tag") == "time"}
    events = trees.card_events(trees.cards(nodes, "page_id", trees.has_class("talk"), fields), "page_id", F.lit("https://a.example/b"))
    return events.groupBy("page_id", "title", "url", "start", "rejection").agg(F.count("*").alias("n"))


@probe("src-13", """
SELECT page_id, x[1] AS name, CASE WHEN starts_with(x[2], '/') THEN 'https://a.example' || x[2] ELSE 'https://a.example/d/' || x[2] END AS url
FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2), regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1))) AS x FROM pages)""")
def _(t):
    members = trees.directory(trees.page_nodes(t.pages, "page_id"), "page_id", F.col("tag") == "li", F.lit("https://a.example/d/"))
    return members.where("rejection is null").select("page_id", "name", "url")


_ELEMENTS = [  # tags, lat, and: name, category, score, address, area
    ({"name": "A  Bar", "amenity": "bar", "website": "https://a.example", "addr:housenumber": "5", "addr:street": "Elm", "addr:city": "Bedford"}, 44.7, "A  Bar", "Bar", 72, "5 Elm, Bedford", "Bedford"),
    ({"name": "B", "amenity": "fast_food", "cuisine": "fish_and_chips;pizza", "contact:phone": "1", "phone": "2", "opening_hours": "24/7", "addr:suburb": "Hill"}, 44.6, "B", "Quick eats", 75, None, "Hill"),
    ({"name": "C", "contact:website": "https://c.example", "cuisine": "thai", "opening_hours": "x", "phone": "1", "addr:street": "Oak"}, 44.65, "C", "Restaurant", 82, "Oak", "Middle"),
    ({"amenity": "cafe"}, 44.6, None, None, None, None, None),
    ({"name": "D", "amenity": "kiosk"}, 0.0, None, None, None, None, None),
    ({"name": "E", "amenity": "kiosk"}, 44.1, "E", "Food and drink", 62, None, None),
]
_element = lambda at, q="'": f"CASE page_id % {len(_ELEMENTS)} " + " ".join(f"WHEN {k} THEN {q}{row[at]}{q}" for k, row in enumerate(_ELEMENTS) if row[at] is not None) + " END"


@probe("src-14", f"SELECT page_id, {_element(2)} AS name, {_element(3)} AS category, {_element(4, '')} AS score, {_element(5)} AS address, {_element(6)} AS area FROM pages")
def _(t):
    tags = F.element_at(F.array(*[F.create_map(*[F.lit(x) for pair in row[0].items() for x in pair]) for row in _ELEMENTS]), (F.col("page_id") % len(_ELEMENTS) + 1).cast("int"))
    lat = F.element_at(F.array(*[F.lit(row[1]) for row in _ELEMENTS]), (F.col("page_id") % len(_ELEMENTS) + 1).cast("int"))
    rows = t.pages.select("page_id", tags.alias("tags"), lat.alias("lat"))
    place = facts.map_place(F.lit("node"), "page_id", "lat", F.lit(-63.6), "tags", [("Middle", F.col("lat") == 44.65)])
    return rows.select("page_id", place.alias("p")).select("page_id", "p.name", "p.category", F.col("p.quality_score").alias("score"), "p.address", F.col("p.neighborhood").alias("area"))


@probe("src-15", """
WITH c AS (SELECT o_orderpriority AS p, count(*) AS before, count(*) FILTER (WHERE o_orderkey % 10 < CASE left(o_orderpriority, 1) WHEN '1' THEN 7 WHEN '2' THEN 8 ELSE 10 END AND left(o_orderpriority, 1) <> '5') AS after FROM orders GROUP BY 1)
SELECT p AS city, before, after, CASE WHEN left(p, 1) = '5' THEN 'retained' WHEN before >= 20 AND after < before * 0.75 THEN 'fell' ELSE 'accepted' END AS state FROM c""")
def _(t):
    first = F.left("o_orderpriority", F.lit(1))
    before = t.orders.select(F.col("o_orderpriority").alias("city"), "o_orderkey", first.alias("f"))
    part = F.when(F.col("f") == "1", 7).when(F.col("f") == "2", 8).otherwise(10)
    after = before.where((F.col("o_orderkey") % 10 < part) & (F.col("f") != "5"))
    return facts.accept_snapshot(after.union(after), before, "city", "o_orderkey")


@probe("src-16", """
WITH o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 + 1 AS page FROM orders),
c AS (SELECT o_custkey, count(*) + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS expected, count(*) AS n, max(page) AS last, CASE WHEN o_custkey % 5 = 0 THEN count(DISTINCT page) > 1 ELSE false END AS gap,
  count(*) FILTER (WHERE o_custkey % 5 <> 0 OR page <> 2) AS links, count(*) FILTER (WHERE (o_custkey % 5 <> 0 OR page <> 2) AND o_orderkey % 31 <> 0) AS details FROM o GROUP BY o_custkey)
SELECT o_custkey, CAST(expected AS INT) AS expected, links, details, array_to_string(list_filter([CASE WHEN last > 5 THEN 'too_many_pages' END, CASE WHEN gap AND last > 2 THEN 'page_missing' END, CASE WHEN o_custkey % 11 = 0 THEN 'page_repeated' END,
  CASE WHEN links <> expected THEN 'count_mismatch' END, CASE WHEN details <> links THEN 'detail_incomplete' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT o_custkey, expected, links, details, gap, CASE WHEN gap AND last = 2 THEN 1 ELSE last END AS last FROM c)""")
def _(t):
    """Each customer's orders as a list in pages of three; some state another total, lack their second page or have the first one twice, and some details are not read."""
    custkey = F.col("o_custkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = t.orders.select("o_custkey", (F.col("o_orderkey") + 1).alias("id"), F.ceil(nth / 3).cast("int").alias("page"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    member = F.struct("id", F.concat(F.lit("https://m.example/members/"), "id").alias("link"), F.col("id").cast("string").alias("name"))
    total = F.first("n") + F.when(custkey % 7 == 0, 1).otherwise(0)
    pages = rows.where("o_custkey % 5 <> 0 or page <> 2").groupBy("o_custkey", "page").agg(total.cast("int").alias("total"), F.to_json(F.collect_list(member)).alias("body"))
    pages = pages.union(pages.where("o_custkey % 11 = 0 and page = 1"))
    details = t.orders.where("o_orderkey % 31 <> 0").select("o_custkey", (F.col("o_orderkey") + 1).alias("id"))
    return paged.completeness(pages, details, "o_custkey").withColumn("problems", F.array_join("problems", ","))


# Signals of a site and the words for each.
SIGNALS = {"menu": ("menu", "der "), "events": ("event", "the "), "patio": ("patio", "le ")}


@probe("src-17", f"SELECT page_id, contains(lower(html), 'menu') OR contains(lower(html), 'der ') AS menu, contains(lower(html), 'event') OR contains(lower(html), 'the ') AS events, least(24, len({_LINKS})) AS links FROM pages")
def _(t):
    hits = S.keyword_hits("html", SIGNALS)
    rows = t.pages.select("page_id", hits.alias("h"), F.slice(markup.html_links("html", "url"), 1, 24).alias("l"))
    return rows.select("page_id", F.map_contains_key("h", "menu").alias("menu"), F.map_contains_key("h", "events").alias("events"), F.size("l").cast("long").alias("links"))


@probe("src-18", "SELECT page_id, CASE WHEN instr(html, '<h1') > 0 THEN substring(html, greatest(1, instr(html, '<h1') - 180), 520 + instr(html, '<h1') - greatest(1, instr(html, '<h1') - 180)) END AS excerpt FROM pages")
def _(t):
    return t.pages.select("page_id", excerpt("html", "<h1").alias("excerpt"))


def excerpt(column, term: str, before: int = 180, after: int = 520):
    """The text around the first mention of a term."""
    text = S.either(column)
    at = F.instr(text, term)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substr(text, start, F.lit(after) + at - start))


@probe("src-19", """
SELECT page_id, platform, handle, basis FROM pages, (VALUES
  (0, 'instagram', 'Corner.Cafe', 'linked_from_official_website'), (0, 'facebook', '77', 'jsonld_sameAs'), (1, 'linktree', 'corner', 'linked_from_official_website'), (1, 'tiktok', 'corner', 'linked_from_official_website'), (2, 'youtube', 'UC1', 'jsonld_sameAs')
) v(rest, platform, handle, basis) WHERE page_id % 4 = rest""")
def _(t):
    bodies = [
        '<a href="https://www.instagram.com/Corner.Cafe/">x</a><a href="https://instagram.com/corner.cafe">y</a><a href="https://instagram.com/p/1">z</a><script type="application/ld+json">{"@graph":[{"sameAs":["https://facebook.com/profile.php?id=77"]}]}</script>',
        '<a href="https://linktr.ee/corner">x</a><a href="https://www.tiktok.com/@corner/video/1">y</a><a href="https://nottiktok.com/@a">z</a>',
        '<script type="application/ld+json">{"sameAs":"https://youtube.com/channel/UC1"}</script><script type="application/ld+json">{bad</script>', "<p>none</p>",
    ]
    rows = t.pages.select("page_id", "url", F.element_at(F.array(*map(F.lit, bodies)), (F.col("page_id") % 4 + 1).cast("int")).alias("html"))
    return discovery.profiles(rows, "page_id", "html", "url").select("page_id", "platform", "handle", "basis")


_FORECASTS = ["not_json", "hour_gap", "units", "feature_count", "out_of_bounds", "diverged"]


_HEADS = [  # what a page states, and the picture and the dates that are read from it
    ('<meta content="a.jpg" property="og:image"><meta property="article:published_time" content="2024-01-05">', "a.jpg", "2024-01-05"),
    ('<img srcset="b.jpg 1x, c.jpg 2x"><time itemprop="datePublished" datetime="2024-01-07T22:00:00-04:00">', "b.jpg", "2024-01-08"),
    ('<img data-src="d.jpg"><script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","datePublished":"2024-01-03"}]}</script><meta name="pubdate" content="2024-01-17">', "d.jpg", "2024-01-03"),
    ('<time datetime="2024-01-02"><script type="application/ld+json">{"@type":"Event","datePublished":"2024-01-03"}</script>', None, ""),
]
_head = lambda at: f"CASE page_id % {len(_HEADS)} " + " ".join(f"WHEN {k} THEN '{row[at]}'" for k, row in enumerate(_HEADS) if row[at] is not None) + " END"


@probe("str-19-stated", f"""SELECT page_id, coalesce({_head(1)}, regexp_extract_all(html, '(?i)<img[^>]* src="([^"]+)"', 1)[1]) AS picture, {_head(2)} AS dates FROM pages""")
def _(t):
    """The first picture of each page, whose head states one in three forms or none, and the days on which it says it was published."""
    head = F.element_at(F.array(*[F.lit(row[0]) for row in _HEADS]), (F.col("page_id") % len(_HEADS) + 1).cast("int"))
    rows = t.pages.select("page_id", F.concat(head, F.coalesce("html", F.lit(""))).alias("html"))
    dates = F.transform(meta.published_dates("html", AS_OF), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return rows.select("page_id", F.try_element_at(meta.stated_images("html"), F.lit(1)).alias("picture"), F.array_join(dates, ",").alias("dates"))


@probe("src-22", f"""
WITH s AS (SELECT s_suppkey AS id, s_suppkey % 9 AS k FROM supplier)
SELECT id, CASE k {" ".join(f"WHEN {k} THEN '{why}'" for k, why in enumerate(_FORECASTS))} ELSE '' END AS problems, CAST(h AS INT) AS hour, TIMESTAMP '{AS_OF}' + to_hours(CAST(h + 1 AS INT)) AS valid_at,
  CASE WHEN (id + h) % 5 <> 0 THEN CAST((id + h) % 40 - 10.5 AS DOUBLE) END AS temperature_c, CAST(CASE WHEN h IS NOT NULL THEN id % 100 END AS DOUBLE) AS probability_percent
FROM s LEFT JOIN (SELECT unnest(range(24)) AS h) ON k >= {len(_FORECASTS)}""")
def _(t):
    """Each supplier's forecast of two features and 24 hours; of nine, six have a fault."""
    key, case = F.col("s_suppkey"), F.col("s_suppkey") % 9
    said = lambda value, unit: F.struct(F.struct(F.lit(unit).alias("en") if isinstance(unit, str) else unit.alias("en")).alias("units"), F.struct(value.alias("en")).alias("value"))
    stamp = lambda hours: F.date_format(F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(hours=hours.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    degrees = lambda i: F.when((case == 4) & (i == 5), 80.5).when((key + i) % 5 != 0, (key + i) % 40 - 10.5)
    hour = lambda i: F.struct(stamp(i + 1 + F.when((case == 1) & (i > 11), 1).otherwise(0)).alias("timestamp"), said(degrees(i), F.when((case == 2) & (i == 3), "F").otherwise("C")).alias("temperature"), said(key % 100, "%").alias("lop"))
    group = lambda back: F.struct(F.struct(stamp(back).alias("en")).alias("timestamp"), F.transform(F.sequence(F.lit(0), F.lit(23)), hour).alias("hourlyForecasts"))
    feature = lambda name, back: F.struct(F.lit(name).alias("id"), F.struct(group(back).alias("hourlyForecastGroup")).alias("properties"))
    two = F.array(feature("a", F.lit(0)), feature("b", F.when(case == 5, -1).otherwise(0)))
    body = F.to_json(F.struct(F.when(case == 3, F.slice(two, 1, 1)).otherwise(two).alias("features")))
    rows = t.supplier.select(key.alias("id"), F.when(case == 0, F.left(body, F.lit(100))).otherwise(body).alias("body"), F.lit(AS_OF).cast("timestamp").alias("retrieved_at"))
    out = geojson.forecast_hours(rows)
    return out.select("id", F.array_join("problems", ",").alias("problems"), "hour", F.col("valid_at").cast("timestamp_ntz").alias("valid_at"), "temperature_c", "probability_percent")


@probe("src-22-gaps", "SELECT user_id, count(*) AS n, bool_and(gap IS NULL OR gap = 1) AS contiguous FROM (SELECT user_id, h - lag(h) OVER (PARTITION BY user_id ORDER BY h) AS gap FROM (SELECT DISTINCT user_id, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS h FROM events)) GROUP BY user_id")
def _(t):
    hours = t.events.select("user_id", (F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp")) / 3600).cast("long").alias("h")).distinct()
    gap = F.col("h") - F.lag("h").over(Window.partitionBy("user_id").orderBy("h"))
    rows = hours.withColumn("ok", F.coalesce(gap == 1, F.lit(True)))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("contiguous"))


@probe("src-24", "SELECT event_id, event_id % 7 <> 0 AND user_id % 7 <= 4 AS same_host FROM events")
def _(t):
    host = lambda k: F.concat(F.lit("https://h"), k, F.lit(".example/x"))
    first, last = host(F.col("user_id").cast("string")), host(F.when(F.col("event_id") % 7 == 0, "other").otherwise(F.col("user_id").cast("string")))
    return t.events.select("event_id", redirect_ok(first, last, F.col("user_id") % 7).alias("same_host"))


def redirect_ok(first, last, hops, most: int = 4):
    """A redirect chain stays on its host and is short."""
    return (S.host_key(first) == S.host_key(last)) & (hops <= most)


@probe("src-25", f"SELECT page_id, CASE WHEN {_HOST} LIKE '%example.net' THEN 'social' WHEN {_HOST} LIKE '%example.org' THEN 'hub' ELSE 'website' END AS kind FROM pages")
def _(t):
    registry = t.spark.createDataFrame([("example.net", "social"), ("example.org", "hub")], "suffix string, kind string")
    rows = t.pages.select("page_id", F.regexp_extract(S.host_key("url"), "[^.]+\\.[^.]+$", 0).alias("suffix"))
    return rows.join(F.broadcast(registry), "suffix", "left").select("page_id", F.coalesce("kind", F.lit("website")).alias("kind"))


@probe("src-26", "SELECT page_id, len(regexp_extract_all(html, '<h[1-3][ >]')) AS blocks FROM pages")
def _(t):
    return t.pages.select("page_id", F.size(markup.heading_blocks("html")).cast("long").alias("blocks"))


@probe("src-27", r"""
WITH p AS (SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS html FROM pages), q AS (SELECT page_id, regexp_replace(html, '(<(script|style)[^>]*>).*?(</(script|style)>)', '\1\3', 'gs') AS html FROM p),
n AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag, html FROM q)
SELECT page_id, tag, count(*) AS n, CASE WHEN tag IN ('a', 'li', 'ul', 'nav', 'h1', 'article', 'title', 'footer', 'script') THEN len(regexp_extract_all(any_value(html), '</' || tag || '>')) END AS closed FROM n GROUP BY page_id, tag""")
def _(t):
    """Elements of each page by tag, and for tags that are not left open how many are closed."""
    sure = F.col("tag").isin("a", "li", "ul", "nav", "h1", "article", "title", "footer", "script")
    nodes = trees.page_nodes(t.pages, "page_id").where("tag <> '#text'")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.when(sure, F.count_if("closed")).alias("closed"))


@probe("src-28", f"""
WITH p AS (SELECT page_id % 10 AS crawl, page_id // 10 + 1 AS page, {_LINKS} AS links FROM pages),
f AS (SELECT crawl, page, count(*) AS new_links FROM (SELECT crawl, link, min(page) AS page FROM (SELECT crawl, page, unnest(links) AS link FROM p) GROUP BY 1, 2) GROUP BY 1, 2),
q AS (SELECT p.*, coalesce(new_links, 0) AS new_links, min(page) OVER (PARTITION BY crawl, links) < page AS same, coalesce(lag(len(links)) OVER (PARTITION BY crawl ORDER BY page), 1) = 0 AS after_empty FROM p LEFT JOIN f USING (crawl, page)),
v AS (SELECT *, CASE WHEN len(links) = 0 AND after_empty THEN 'two_empty' WHEN len(links) = 0 AND page < 25 THEN 'go_on' WHEN len(links) > 0 AND same THEN 'repeated' WHEN len(links) > 0 AND page > 1 AND new_links = 0 THEN 'no_new_links' WHEN page >= 25 THEN 'page_limit' ELSE 'go_on' END AS verdict FROM q)
SELECT crawl, page, CAST(len(links) AS INT) AS n_links, new_links, verdict, coalesce(page <= min(page) FILTER (WHERE verdict <> 'go_on') OVER (PARTITION BY crawl), true) AS read FROM v""")
def _(t):
    """Ten crawls of pages, each of which ends at its first stop."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return crawl.crawl_stops(t.pages.select((F.col("page_id") % 10).alias("crawl"), (F.floor(F.col("page_id") / 10) + 1).alias("page"), links.alias("links")), empty=2)


@probe("src-28-repeats", f"SELECT page_id, CASE WHEN n = 0 THEN 'no_links' WHEN same THEN 'repeated' WHEN rank > 20 THEN 'page_limit' ELSE 'go_on' END AS verdict FROM (SELECT page_id, len({_LINKS}) AS n, {_LINKS} = lag({_LINKS}) OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS same, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS rank FROM pages)")
def _(t):
    w = Window.partitionBy("crawl").orderBy("page_id")
    links = F.transform(markup.html_links("html", F.lit("https://a.example/b/")), lambda x: x["url"])  # one base, so pages with equal links are told
    rows = t.pages.select("page_id", (F.col("page_id") % 10).alias("crawl"), F.size(links).alias("n"), F.sha2(F.array_join(links, " "), 256).alias("print"))
    return rows.select("page_id", F.when(F.col("n") == 0, "no_links").when(F.col("print") == F.lag("print").over(w), "repeated").when(F.row_number().over(w) > 20, "page_limit").otherwise("go_on").alias("verdict"))


_ROBOTS = [
    ("User-agent: *\nDisallow: /es/\nAllow: /es/a # opens nothing", "p NOT LIKE '/es/%'"),
    ("User-agent: plaza\nDisallow: /*.html$\n\nUser-agent: *\nDisallow: /", "t NOT LIKE '%.html'"),
    ("<html>denied</html>", "false"),
    ("", "true"),
    ("User-agent: notplaza\nDisallow: /fr/\nUser-agent: *\nDisallow: /es/", "p NOT LIKE '/es/%' AND p NOT LIKE '/fr/%'"),
    ("User-agent: *\nDisallow: /*?", "t NOT LIKE '%?%'"),
    ("Disallow: /es/", "false"),
    ("User-agent: *\nCrawl-delay: 5\nUser-agent: plaza\nDisallow: /%65s/\nSitemap: https://a.example/s.xml", "p NOT LIKE '/es/%'"),
]


@probe("flt-20", "SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {k} THEN {said}" for k, (_, said) in enumerate(_ROBOTS)) + r" END AS allowed FROM (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1) AS t FROM pages)")
def _(t):
    robots = F.element_at(F.array(*[F.lit(text) for text, _ in _ROBOTS]), (F.col("page_id") % 8 + 1).cast("int"))
    target = F.regexp_extract("url", "^[^:]*://[^/?#]*([^#]*)", 1)
    return t.pages.select("page_id", markup.robots_allowed("plaza")(robots, target).alias("allowed"))


_LIFECYCLE = [  # a page, and the closures and moves that it tells
    ("<p>The shop has closed and is moving to Main Street.</p>", "has closed", "moving to"),
    ("We will be temporarily closed; <b>we  moved</b> the patio.", "temporarily closed", "we moved"),
    ("Our chef worked abroad for ten years before relocating here", "", ""),
    ("I would honestly consider moving to this street. Relocated since May.", "", "relocated"),
    ("We are opening a new location in Toronto soon", "", ""),
    ("See our new location on the pier", "", "new location"),
    ("<script>permanently closed", "", ""),
    ("Open daily, never closed", "", ""),
]


@probe("flt-30", "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{c}'" for k, (_, c, _) in enumerate(_LIFECYCLE)) + " END AS closures, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{m}'" for k, (_, _, m) in enumerate(_LIFECYCLE)) + " END AS moves FROM documents")
def _(t):
    page = F.element_at(F.array(*[F.lit(text) for text, _, _ in _LIFECYCLE]), (F.col("doc_id") % 8 + 1).cast("int"))
    told = t.documents.select("doc_id", markup.lifecycle_language(page).alias("told"))
    return told.select("doc_id", F.array_join("told.closures", ",").alias("closures"), F.array_join("told.moves", ",").alias("moves"))


@probe("str-11", "SELECT page_id, '/a~' || page_id || '%2F%C3%A9' AS path FROM pages")
def _(t):
    return t.pages.select("page_id", markup.normal_octets(F.concat(F.lit("/%61%7e"), F.col("page_id").cast("string"), F.lit("%2fé"))).alias("path"))


@probe("dt-07", """
SELECT event_id, strftime(CASE WHEN event_id % 5 = 4 THEN ts - INTERVAL 1 YEAR ELSE ts END, '%Y-%m-%d') AS first_day,
       strftime(CASE event_id % 5 WHEN 0 THEN ts + INTERVAL 40 DAY WHEN 1 THEN ts + INTERVAL 2 DAY WHEN 2 THEN greatest(ts, make_timestamp(2024, 1, 28, 0, 0, 0)) WHEN 3 THEN ts ELSE ts - INTERVAL 1 YEAR END, '%Y-%m-%d') AS last_day, 
       strftime(ts, '%Y-%m-%d') AS compact, CAST(hour(ts) AS INT) AS hour, CASE WHEN hour(ts) % 12 = 0 THEN '12' ELSE CAST(hour(ts) % 12 AS VARCHAR) END || ':30 ' || CASE WHEN hour(ts) < 12 THEN 'a.m.' ELSE 'p.m.' END AS starts
FROM events""")
def _(t):
    day = lambda c, f="MMM d": F.date_format(c, f)
    ts, whole = F.col("ts"), "MMM d, yyyy"
    until = F.greatest(ts, F.lit("2024-01-28").cast("timestamp_ntz"))
    forms = [
        F.concat(F.lit("On "), day(ts, "MMMM d, yyyy"), F.lit(" - "), day(ts + F.expr("interval 40 days"), whole)), F.concat(day(ts), F.lit(" – "), day(ts + F.expr("interval 2 days")), F.lit(", "), day(ts, "yyyy")),
        F.concat(day(ts), F.lit("—"), day(until, "d, yyyy")), day(ts, "MMMM d, yyyy"), F.concat(F.lit("from "), day(ts)),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    clock = F.concat(day(ts, "h"), F.lit(":30 "), F.when(F.hour("ts") < 12, "a.m.").otherwise("p.m."))
    rows = t.events.select("event_id", H.date_range(text, F.lit(2023)).alias("r"), H.compact_date(F.concat(day(ts, "dd-MMM-yy"))).alias("c"), H.clock(clock).alias("k"), H.time_range(F.concat(F.lit("doors "), clock, F.lit(" to 11 pm"))).alias("x"))
    return rows.select("event_id", F.col("r.first").cast("string").alias("first_day"), F.col("r.last").cast("string").alias("last_day"), F.col("c").cast("string").alias("compact"), "k.hour", F.col("x.start").alias("starts"))


@probe("dt-18", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_such_date' ELSE 'format' END AS verdict FROM documents")
def _(t):
    text = F.element_at(F.array(F.lit("2024-02-29"), F.lit("2023-02-29"), F.lit("Feb 29")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", F.when(~text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "format").when(D.strict_date(text).isNull(), "no_such_date").otherwise("ok").alias("verdict"))


@probe("prj-25", "SELECT page_id, '902-555-' || lpad(CAST(page_id AS VARCHAR), 4, '0') AS phone, 'Mo-Fr 09:00-17:00' AS hours FROM pages")
def _(t):
    n = F.lpad(F.col("page_id").cast("string"), 4, "0")
    block = F.concat(F.lit('<script type="application/ld+json">{"@type":"Restaurant","telephone":"902-555-'), n, F.lit('","openingHours":"Mo-Fr 09:00-17:00"}</script>'))
    facts = F.from_json(F.element_at(F.regexp_extract_all(F.concat("html", block), F.lit('(?s)<script type="application/ld[+]json">(.*?)</script>'), F.lit(1)), -1), "telephone string, openingHours string")
    return t.pages.select("page_id", facts["telephone"].alias("phone"), facts["openingHours"].alias("hours"))


@probe("mth-06", "WITH RECURSIVE l(seed, k, x) AS (SELECT user_id, 0, CAST(user_id AS HUGEINT) FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT seed, k + 1, (x * 1664525 + 1013904223) % 4294967296 FROM l WHERE k < 20) SELECT seed, CAST(k AS BIGINT) AS k, CAST(x AS BIGINT) AS x FROM l WHERE k > 0")
def _(t):
    """Twenty draws for each user, whose id is the seed."""
    seeds = t.events.select(F.col("user_id").alias("seed")).distinct()
    return seeds.select("seed", F.posexplode(N.lcg_draws("seed", 20)).alias("k", "x")).select("seed", (F.col("k") + 1).cast("long").alias("k"), "x")


@probe("mth-08", "SELECT page_id, CAST(page_id + 1 AS INT) AS width, CAST(600 AS INT) AS height FROM pages")
def _(t):
    @F.pandas_udf("struct<width:int,height:int>")
    def size(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([N.image_size(bytes(d)) or (None, None) for d in data], columns=["width", "height"])

    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(F.col("page_id") + 1), 8, "0")), F.unhex(F.lit("00000258")))
    return t.pages.select("page_id", size(png).alias("s")).select("page_id", "s.width", "s.height")
