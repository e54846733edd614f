"""Strings, dates, numbers and arrays over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaza.functions import collections as C
from plaza.functions import dates as D
from plaza.functions import numbers as N
from plaza.functions import text as S
from plaza.operators.resolve import either_contains
from plaza.probes.base import AS_OF, probe

# --- strings -----------------------------------------------------------------


@probe("str-01", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", S.fold_compatible("text").alias("folded"))


@probe("str-02", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '(^|[^a-z0-9])the($|[^a-z0-9])', '\1\2', 'g'), '[^a-z0-9]+', '', 'g') AS k FROM part")
def _(t):
    return t.part.select("p_partkey", S.compact_key("p_name").alias("k"))


@probe("str-03", r"SELECT s_suppkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(s_name || ' Cafe & Bar'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'the', 'restaurant', 'resto', 'cafe', 'bar', 'pub', 'eatery', 'kitchen')), ' ') || ' and' AS k FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", S.spaced_key(F.concat("s_name", F.lit(" Cafe & Bar")), S.PLACE_WORDS).alias("k"))


@probe("str-04", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS civic, 'elm ' || CAST(c_nationkey AS VARCHAR) AS street,
       'B' || (c_custkey % 10) || 'H1A' || (c_nationkey % 10) AS postal, right('90255500' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), 10) AS phone
FROM customer""")
def _(t):
    number = F.col("c_custkey").cast("string")
    address = F.concat(number, F.lit(" Elm Street, B"), F.col("c_custkey") % 10, F.lit("H 1A"), F.col("c_nationkey") % 10)
    return t.customer.select(
        "c_custkey",
        S.civic_number(address).alias("civic"),
        S.address_key(F.concat(F.lit("Elm Street "), "c_nationkey")).alias("street"),
        S.postal_code(address).alias("postal"),
        S.phone_key(F.concat(F.lit("+90 255 500-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))).alias("phone"),
    )


@probe("str-05", r"""
WITH k AS (SELECT page_id, CAST(page_id % 90 + 10 AS VARCHAR) || ' ' || array_to_string(list_slice(string_split(trim(regexp_replace(strip_accents(lower(regexp_extract(html, '<title>([^<]*)', 1))), '[^a-z0-9]+', ' ', 'g')), ' '), 1, 3), ' ') AS fp FROM pages)
SELECT page_id, fp FROM k""")
def _(t):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return t.pages.select("page_id", S.street_fingerprint(F.concat((F.col("page_id") % 90 + 10).cast("string"), F.lit(" "), title)).alias("fp"))


@probe("str-06", "SELECT p_partkey, regexp_replace(left(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 20), '-+$', '') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", S.slug(F.concat_ws(" / ", "p_name", "p_type"), 20).alias("slug"))


@probe("str-07", r"""
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS text_md5
FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(S.html_text("html")).alias("text_md5"))


@probe("str-08", r"""
WITH w AS (SELECT conv_id, turn, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), 'https?://[^ ]+', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), ' '), lambda x: length(x) <= 36), ' ') AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN length(x) > 240 THEN rtrim(left(x, 237)) || '...' ELSE x END AS summary FROM w""")
def _(t):
    return t.conversations.select("conv_id", "turn", S.post_text("text").alias("summary"))


@probe("str-09", r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)(=|$)'))) AS q FROM pages)
SELECT page_id, CASE WHEN host <> '' THEN 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM p""")
def _(t):
    return t.pages.select("page_id", S.canonical_url("url").alias("canonical"))


@probe("str-10", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www|m)\.', '') AS host, regexp_extract(url, '://([^/?#]*)', 1) LIKE '%.example.com' AS below FROM pages")
def _(t):
    host = S.host_key("url")
    return t.pages.select("page_id", host.alias("host"), S.same_site(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit("example.com")).alias("below"))


# The taxonomy's words, and which group leads.
TAXONOMY = {"happy_hour": ("happy hour", "half price"), "specials": ("special", "deal", "offer"), "events": ("event", "ticket", "market", "the "), "live_music": ("band", "concert", "on "), "menu": ("menu", "ed "), "patio": ("patio", "terrace", "er "), "brunch": ("brunch", "ing ")}
PRIORITY = {"happy_hour": 98, "specials": 95, "events": 90, "live_music": 88, "menu": 74, "patio": 70, "brunch": 68}

_HITS = " ".join(f"WHEN {' OR '.join(f'''contains(x, '{w}')''' for w in TAXONOMY[k])} THEN '{k}'" for k in sorted(PRIORITY, key=lambda k: -PRIORITY[k]))
_COUNT = " + ".join(f"CAST({' OR '.join(f'''contains(x, '{w}')''' for w in ws)} AS INT)" for ws in TAXONOMY.values())


@probe("str-12", f"SELECT doc_id, CASE {_HITS} END AS lead, CAST({_COUNT} AS INT) AS n_groups FROM (SELECT doc_id, lower(text) AS x FROM documents)")
def _(t):
    hits = S.keyword_hits("text", TAXONOMY)
    rows = t.documents.select("doc_id", hits.alias("hits"))
    return rows.select("doc_id", S.primary(F.col("hits"), PRIORITY).alias("lead"), F.size(F.map_keys("hits")).alias("n_groups"))


_ONCE = "CASE WHEN len({0}) % 2 = 0 AND {0}[:len({0}) // 2] = {0}[len({0}) // 2 + 1:] THEN array_to_string({0}[:len({0}) // 2], ' ') ELSE array_to_string({0}, ' ') END"


@probe("str-13", rf"""
WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, {_ONCE.format('w')} AS once, {_ONCE.format('w')} AS badged, array_to_string(w, ' ') || ' Featured Event. x' AS other FROM t""")
def _(t):
    once = S.collapse_repeat("text")
    spaced = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return t.documents.select("doc_id", once.alias("once"), S.display_title(F.concat(F.lit("Featured Event. "), once)).alias("badged"), S.display_title(F.concat(spaced, F.lit(" Featured Event. x"))).alias("other"))


@probe("str-14", "SELECT o_orderkey, left(sha256(CASE WHEN trim(o_orderstatus) = '' THEN '' ELSE o_orderstatus || '|' END || o_orderpriority || '|' || CAST(o_custkey AS VARCHAR)), 16) AS id FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.hash_id(["o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")]).alias("id"))


@probe("str-15", r"""
SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_md5,
       md5(replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), ',', '\,'), ';', '\;')) AS ics_md5,
       md5(CASE WHEN contains(text, '"') OR contains(text, ',') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS csv_md5
FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(S.escape_html("text")).alias("html_md5"), F.md5(S.escape_ics("text")).alias("ics_md5"), F.md5(S.escape_csv("text")).alias("csv_md5"))


_INNER = "CASE p_partkey % 3 WHEN 0 THEN substr({0}, 2) WHEN 1 THEN 'the' || {0} || p_size ELSE substr({0}, 2, 7) END"


@probe("str-16", f"""
WITH n AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS name FROM part), o AS (SELECT DISTINCT {_INNER.format("replace(lower(p_name), ' ', '')")} AS called FROM part)
SELECT name, called, round(least(length(name), length(called)) / greatest(length(name), length(called)), 6) AS ratio FROM n, o
WHERE least(length(name), length(called)) >= 5 AND (contains(name, called) OR contains(called, name)) AND 100 * least(length(name), length(called)) >= 65 * greatest(length(name), length(called))""")
def _(t):
    key = "replace(lower(p_name), ' ', '')"
    pairs = either_contains(t.part.selectExpr(f"{key} AS a"), t.part.selectExpr(f"{_INNER.format(key)} AS b"), ratio=0.65)
    shorter, longer = F.least(F.char_length("a"), F.char_length("b")), F.greatest(F.char_length("a"), F.char_length("b"))
    return pairs.select(F.col("a").alias("name"), F.col("b").alias("called"), F.round(shorter / longer, 6).alias("ratio"))


@probe("str-17", "SELECT doc_id, length(text) > 12 AND NOT regexp_matches(left(text, 12), '^ *$') AS completed FROM documents")
def _(t):
    short = F.concat(F.left("text", F.lit(12)), F.lit("..."))
    return t.documents.select("doc_id", (S.completes(short, F.col("text")) & (F.length("text") > 12)).alias("completed"))


@probe("str-18", """SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*? href="([^"]*)"', 1)[1] AS first_link, len(regexp_extract_all(html, '(?i)<a[^>]*? href="([^"]*)"', 1)) AS n_links, len(regexp_extract_all(html, '(?i)<img[^>]*? src="([^"]*)"', 1)) AS n_images FROM pages""")
def _(t):
    links = S.tag_attributes("html", "a", "href")
    return t.pages.select("page_id", F.try_element_at(links, F.lit(1)).alias("first_link"), F.size(links).cast("long").alias("n_links"), F.size(S.tag_attributes("html", "img", "src")).cast("long").alias("n_images"))


@probe("str-19", """SELECT page_id, list_sort(list_distinct(list_filter(regexp_extract_all(html || '<time datetime="2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '">', 'datetime="([0-9]{4}-[0-9]{2}-[0-9]{2})"', 1), lambda d: d <= '2024-01-16')))[-1] AS published FROM pages""")
def _(t):
    html = F.concat("html", F.lit('<time datetime="2024-01-'), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit('">'))
    return t.pages.select("page_id", dates_of(html, "2024-01-16").alias("published"))


def dates_of(html, last: str):
    """The latest date in a page's date tags that isn't after ``last``."""
    found = F.regexp_extract_all(html, F.lit('datetime="([0-9]{4}-[0-9]{2}-[0-9]{2})"'), F.lit(1))
    return F.array_max(F.filter(found, lambda d: D.strict_date(d).isNotNull() & (d <= last)))


@probe("str-20", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '1') AS page, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), 'all') AS ref, '#explore' || CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) NOT IN ('', '1') THEN '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE '' END AS route FROM pages")
def _(t):
    defaults = {"page": "1", "ref": "all"}
    rows = t.pages.select("page_id", S.hash_state(F.concat(F.lit("#x?"), S.url_query("url")), defaults).alias("s"))
    return rows.select("page_id", "s.page", "s.ref", S.state_hash("explore", {"page": F.col("s.page")}, defaults).alias("route"))


# --- dates -------------------------------------------------------------------

_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Halifax')"


@probe("dt-01", f"SELECT event_id, CAST(CASE WHEN event_type = 'view' AND strftime(ts, '%H:%M:%S') = '00:00:00' THEN CAST(ts AS DATE) ELSE CAST({_LOCAL} AS DATE) END AS VARCHAR) AS day FROM events")
def _(t):
    return t.events.select("event_id", D.local_date("ts", F.col("event_type") == "view").cast("string").alias("day"))


@probe("dt-02", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS starts, strftime(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + INTERVAL 32 HOUR ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS ends FROM orders")
def _(t):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.orders.select("o_orderkey", stamp(D.start_instant(F.to_date("o_orderdate"))).alias("starts"), stamp(D.end_instant("o_orderdate", F.col("o_orderstatus") == "O")).alias("ends"))


@probe("dt-03", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mail, CAST(NULL AS VARCHAR) AS wrong FROM events")
def _(t):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    mail = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    day_off = F.date_format(F.col("ts") + F.expr("interval 1 day"), "EEE, ")
    wrong = F.concat(day_off, F.date_format("ts", "d MMM yyyy HH:mm:ss 'GMT'"))
    return t.events.select("event_id", stamp(D.strict_instant(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("iso"), stamp(D.strict_instant(mail)).alias("mail"), stamp(D.strict_instant(wrong)).alias("wrong"))


@probe("dt-04", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS good, CAST(NULL AS VARCHAR) AS bad FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.strict_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string").alias("good"), D.strict_date(F.date_format("o_orderdate", "yyyy-'02-30'")).cast("string").alias("bad"))


@probe("dt-05", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) < DATE '1996-01-16' ELSE o_orderdate < TIMESTAMP '1996-01-16 12:00:00' END AS ended FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.has_ended("o_orderdate", F.col("o_orderstatus") == "F", "1996-01-16 12:00:00").alias("ended"))


@probe("dt-06", "SELECT event_id, strftime((ts AT TIME ZONE 'America/Halifax') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def _(t):
    return t.events.select("event_id", F.date_format(D.utc("ts"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@probe("dt-08", """
WITH e AS (SELECT event_id, CAST(event_id % 7 AS INT) AS a, CAST((event_id // 7) % 7 AS INT) AS n FROM events)
SELECT event_id, array_to_string(list_transform(range(0, n + 1), lambda k: ['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'][(a + k) % 7 + 1]), ',') AS days, '15:00' AS opens, '18:30' AS closes FROM e""")
def _(t):
    names = F.array(*map(F.lit, D.WEEKDAYS))
    a, n = (F.col("event_id") % 7).cast("int"), (F.floor(F.col("event_id") / 7) % 7).cast("int")
    text = F.concat(F.element_at(names, a + 1), F.lit("-"), F.element_at(names, (a + n) % 7 + 1), F.lit(" 3pm-6:30pm"))
    rows = t.events.select("event_id", D.cadence(text).alias("c"))
    return rows.select("event_id", F.array_join("c.days", ",").alias("days"), "c.opens", "c.closes")


@probe("dt-10", """
WITH e AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, (dayofweek(ts) + 6) % 7 AS d FROM events)
SELECT event_id, CASE WHEN d <= 4 AND m >= 540 AND m < 1020 THEN 'open' WHEN d = 5 AND m >= 1080 THEN 'open' WHEN d = 6 AND m < 120 THEN 'open' ELSE 'closed' END AS state FROM e""")
def _(t):
    span = lambda a, b: F.array(F.struct(F.lit(a).alias("open"), F.lit(b).alias("close")))
    none = F.array().cast("array<struct<open:string,close:string>>")
    weekly = F.create_map(*[x for d in D.DAYS for x in (F.lit(d), span("18:00", "02:00") if d == "saturday" else none if d == "sunday" else span("09:00", "17:00"))])
    return t.events.select("event_id", D.hours_state(weekly, F.col("ts")).alias("state"))


@probe("dt-12", "SELECT o_orderkey, CAST(d + (4 - (dayofweek(d) + 6) % 7)::INT AS VARCHAR) AS friday, CAST(d + (6 - (dayofweek(d) + 6) % 7)::INT AS VARCHAR) AS sunday FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(t):
    friday, sunday = D.weekend_of(F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", friday.cast("string").alias("friday"), sunday.cast("string").alias("sunday"))


@probe("dt-13", "SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM (SELECT unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + (o_orderkey % 5)::INT, INTERVAL 1 DAY))::DATE AS day FROM orders) GROUP BY day")
def _(t):
    first = F.to_date("o_orderdate")
    last = F.date_add(first, F.least(F.col("o_orderkey") % 5, F.lit(370)).cast("int"))
    return t.orders.select(F.explode(F.sequence(first, last)).alias("day")).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@probe("dt-14", "SELECT o_orderkey, DATE '1996-01-16' BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + (o_orderkey % 90)::INT AS ongoing, CASE WHEN o_orderkey % 90 = 0 THEN 'one day' ELSE CAST(o_orderkey % 90 + 1 AS VARCHAR) || ' days' END AS run FROM orders")
def _(t):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 90).cast("int"))
    days = D.inclusive_days(start, end)
    return t.orders.select("o_orderkey", F.lit("1996-01-16").cast("date").between(start, end).alias("ongoing"), F.when(days == 1, "one day").otherwise(F.concat(days.cast("string"), F.lit(" days"))).alias("run"))


@probe("dt-15", "SELECT event_id, strftime(ts + to_seconds(event_id % 3600), '%Y-%m-%d %H:%M:%S') AS not_before FROM events")
def _(t):
    return t.events.select("event_id", F.date_format(D.retry_not_before((F.col("event_id") % 3600).cast("string"), "ts"), "yyyy-MM-dd HH:mm:ss").alias("not_before"))


@probe("dt-16", f"SELECT event_id FROM (SELECT event_id, {_LOCAL} AS l FROM events) WHERE (CAST(l AS DATE) = DATE '2024-01-16' AND hour(l) >= 17) OR (CAST(l AS DATE) = DATE '2024-01-17' AND hour(l) < 3)")
def _(t):
    return t.events.where(D.tonight("ts", F.lit("2024-01-16").cast("date"))).select("event_id")


@probe("dt-17", f"SELECT event_id, CASE WHEN ts <= TIMESTAMP '{AS_OF}' THEN CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0) AS BIGINT) END AS days FROM events")
def _(t):
    return t.events.select("event_id", D.age_days("ts", AS_OF).alias("days"))


@probe("dt-19", "SELECT o_orderkey, CAST(make_date(1996 + CASE WHEN o_orderkey % 12 + 1 < month(o_orderdate) THEN 1 ELSE 0 END, (o_orderkey % 12 + 1)::INT, 1) AS VARCHAR) AS ends FROM orders")
def _(t):
    month = (F.col("o_orderkey") % 12 + 1).cast("int")
    return t.orders.select("o_orderkey", range_end(F.lit(1996), F.month("o_orderdate"), month, F.lit(1)).cast("string").alias("ends"))


def range_end(year, start_month, end_month, day):
    """An end whose month lies before the start's is in the next year."""
    return F.make_date(year + F.when(end_month < start_month, 1).otherwise(0), end_month, day)


# --- numbers -----------------------------------------------------------------

_XY = "s_suppkey, 44.0 + (s_suppkey % 100) / 100.0 AS lat, -64.0 + (s_suppkey * 7 % 100) / 100.0 AS lon"


def points(t):
    return t.supplier.select("s_suppkey", "s_name", (F.lit(44.0) + (F.col("s_suppkey") % 100) / 100.0).alias("lat"), (F.lit(-64.0) + (F.col("s_suppkey") * 7 % 100) / 100.0).alias("lon"))


@probe("mth-01", f"SELECT s_suppkey, round(12742000 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(44.65)) / 2), 2) + cos(radians(44.65)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(-63.57)) / 2), 2)))), 3) AS metres FROM (SELECT {_XY} FROM supplier)")
def _(t):
    return points(t).select("s_suppkey", F.round(N.metres(F.lit(44.65), F.lit(-63.57), "lat", "lon"), 3).alias("metres"))


BOXES = (("north", (44.7, -64.0, 45.0, -63.0)), ("south west", (44.0, -64.0, 44.7, -63.5)))


@probe("mth-02", f"SELECT s_suppkey, CASE WHEN lat BETWEEN 44.7 AND 45.0 AND lon BETWEEN -64.0 AND -63.0 THEN 'north' WHEN lat BETWEEN 44.0 AND 44.7 AND lon BETWEEN -64.0 AND -63.5 THEN 'south west' ELSE 'elsewhere' END AS area FROM (SELECT {_XY} FROM supplier)")
def _(t):
    return points(t).select("s_suppkey", N.area_of("lat", "lon", BOXES, "elsewhere").alias("area"))


@probe("mth-03", "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS share, round(l_quantity / 100, 6) AS pct FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(N.probability("l_discount", "fraction"), 6).alias("share"), F.round(N.probability("l_quantity", "percent"), 6).alias("pct"))


@probe("mth-04", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.percentile("l_quantity", 0.1), 6).alias("p10"), F.round(F.percentile("l_quantity", 0.9), 6).alias("p90"))


@probe("mth-05", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 10 - 273.15 BETWEEN -90 AND 60 THEN round(l_quantity * 10 - 273.15, 6) END AS celsius FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(N.bounded(N.celsius(F.col("l_quantity") * 10), "temperature"), 6).alias("celsius"))


@probe("mth-07", r"SELECT o_orderkey, round(try_cast(regexp_extract('from $ ' || CAST(CAST(o_custkey AS BIGINT) AS VARCHAR) || '.50 each', '\$ ?([0-9]+(\.[0-9]{1,2})?)', 1) AS DOUBLE), 2) AS price FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(N.price(F.concat(F.lit("from $ "), F.col("o_custkey").cast("string"), F.lit(".50 each"))), 2).alias("price"))


# --- arrays, maps, JSON --------------------------------------------------------


@probe("arr-01", "SELECT doc_id, len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(C.distinct_truthy(F.split("text", " "))).cast("long").alias("n"))


@probe("arr-02", "WITH l AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(l_suppkey || ':' || n, ',' ORDER BY n, l_suppkey) AS merged FROM l GROUP BY l_orderkey")
def _(t):
    item = F.struct("l_linenumber", F.col("l_suppkey").alias("k"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("all"))
    half = F.greatest(F.lit(1), F.floor(F.size("all") / 2)).cast("int")
    merged = C.keyed_union(F.slice("all", F.lit(1), half), F.slice("all", half + 1, F.size("all")), "k")
    return rows.select("l_orderkey", F.array_join(F.transform(merged, lambda x: F.concat_ws(":", x["k"], x["l_linenumber"])), ",").alias("merged"))


@probe("arr-03", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: length(x) > 12)) > 0 AS some_long, len(list_filter(string_split(text, ' '), lambda x: length(x) > 30)) = 0 AS all_short FROM documents")
def _(t):
    words = F.split("text", " ")
    return t.documents.select("doc_id", F.exists(words, lambda x: F.length(x) > 12).alias("some_long"), F.forall(words, lambda x: F.length(x) <= 30).alias("all_short"))


@probe("arr-04", "SELECT o_orderkey, o_orderpriority, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(t):
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("lines"))
    return t.orders.join(nested, "o_orderkey").select("o_orderkey", "o_orderpriority", F.explode("lines").alias("l_linenumber"))


@probe("arr-05", "SELECT doc_id, list_filter(string_split(text, ' '), lambda x: length(x) > 8)[1] AS word FROM documents")
def _(t):
    return t.documents.select("doc_id", C.first_valid(F.split("text", " "), lambda x: F.length(x) > 8).alias("word"))


@probe("arr-06", """SELECT event_id, k AS key, v AS value FROM (SELECT event_id, unnest(json_keys(props)) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS v FROM events)""")
def _(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@probe("arr-07", """SELECT event_id, '{"a":"' || event_type || '","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS canonical FROM events""")
def _(t):
    raw = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": "'), "event_type", F.lit('"}'))
    return t.events.select("event_id", C.sorted_json(raw).alias("canonical"))


@probe("arr-08", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS evidence FROM events""")
def _(t):
    return t.events.select("event_id", C.meaningful_hash(["user_id", "ts", "event_type"], clocks=["ts"]).alias("evidence"))


@probe("arr-09", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS other FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("absent")).alias("other"))


@probe("arr-10", """SELECT event_id FROM events WHERE regexp_matches(replace(lower(props), ' ', ''), '"k":1')""")
def _(t):
    return t.events.where(F.lower(F.to_json(F.from_json("props", "map<string,int>"))).rlike('"k":1')).select("event_id")


@probe("json-01", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS broken FROM events")
def _(t):
    dirty = F.replace("props", F.lit(":"), F.lit(":\t\n"))
    read = lambda c: F.try_variant_get(F.try_parse_json(C.tolerant_json(c)), "$.k", "bigint")
    return t.events.select("event_id", read(dirty).alias("k"), read(F.concat(F.lit("{"), "props")).alias("broken"))
