"""Filters and projections over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plaza.functions import dates as D
from plaza.functions import numbers as N
from plaza.functions import text as S
from plaza.functions.collections import slots
from plaza.operators import facts, media, news
from plaza.operators import metrics as M
from plaza.operators import predicates as P
from plaza.operators import review as V
from plaza.probes.base import AS_OF, probe
from plaza.sources import crawl

_TS = f"TIMESTAMP '{AS_OF}'"
_HOST = r"regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www|m)\.', '')"
_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Halifax')"
_DAY = "CAST(o_orderdate AS DATE)"

# --- filters -----------------------------------------------------------------


@probe("flt-01", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND lower(p_brand) = 'brand#12' AND p_size <= 25")
def _(t):
    return t.part.where(P.all_of([P.search("p_name", "Ring"), P.facet("p_brand", "BRAND#12"), P.facet_any(F.array("p_type"), "all"), F.col("p_size") <= 25])).select("p_partkey")


@probe("flt-02", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the on') OR contains(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g'), 'eaux')")
def _(t):
    hit = F.contains(F.lower("text"), F.lit("the on")) | F.contains(F.regexp_replace(S.fold("text"), "[^a-z0-9]+", ""), F.lit("eaux"))
    return t.documents.where(hit).select("doc_id")


_SHORT = "user_id % 10 <> 0"


@probe("flt-03", f"SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id % 5 = 2 AND {_SHORT} AND hour({_LOCAL}) >= 17")
def _(t):
    conditions = [P.facet("event_type", "purchase"), P.facet((F.col("user_id") % 5).cast("string"), "2"), F.col("user_id") % 10 != 0, D.time_kind("ts") == "evening", P.facet("props", None)]
    return t.events.where(P.all_of(conditions)).select("event_id")


@probe("flt-04", f"SELECT event_id FROM events WHERE (CASE WHEN event_type = 'view' THEN date_trunc('day', ts) + INTERVAL 32 HOUR ELSE ts END) >= {_TS} - INTERVAL 30 MINUTE")
def _(t):
    return t.events.where(P.still_on(D.end_instant("ts", F.col("event_type") == "view"), AS_OF)).select("event_id")


@probe("flt-05", f"SELECT o_orderkey, w FROM (SELECT o_orderkey, {_DAY} AS a, {_DAY} + (o_orderkey % 9)::INT AS b FROM orders) JOIN (VALUES ('today', DATE '1996-01-16', DATE '1996-01-16'), ('weekend', DATE '1996-01-19', DATE '1996-01-21'), ('30', DATE '1996-01-16', DATE '1996-02-15')) x(w, lo, hi) ON b >= lo AND a <= hi")
def _(t):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 9).cast("int"))
    today = F.lit("1996-01-16").cast("date")
    parts = [t.orders.where(D.overlaps(start, end, *D.window_bounds(w, today))).select("o_orderkey", F.lit(w).alias("w")) for w in ("today", "weekend", "30")]
    return parts[0].union(parts[1]).union(parts[2])


@probe("flt-06", "SELECT doc_id, n_chars > 7 AND doc_id % 3 = 0 AND doc_id % 6 <> 0 AS season FROM documents")
def _(t):
    title = F.concat(F.lit("Home "), F.when(F.col("doc_id") % 3 == 0, F.lit("season")).otherwise("concert"), F.when(F.col("doc_id") % 6 == 0, F.lit(" vs rivals")).otherwise(""))
    return t.documents.select("doc_id", P.sports_season(title, F.col("n_chars")).alias("season"))


@probe("flt-07", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0' AND contains(lower(text), 'the')")
def _(t):
    return t.documents.where(P.all_of([P.facet("lang", "EN"), P.facet("source", "src0"), F.array_contains(F.array("lang"), "en"), F.contains(F.lower("text"), F.lit("the"))])).select("doc_id")


@probe("flt-08", "SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 'verified' ELSE 'lead' END AS kind FROM part WHERE contains(lower(p_name), 'bl')")
def _(t):
    return t.part.where(P.search("p_name", "bl")).select("p_partkey", F.when(F.col("p_retailprice") > 1500, "verified").otherwise("lead").alias("kind"))


@probe("flt-09", "SELECT page_id FROM pages WHERE contains(url, 'example.net') ORDER BY page_id LIMIT 30 OFFSET 30")
def _(t):
    return t.pages.where(P.search("url", "example.net")).orderBy("page_id").offset(30).limit(30).select("page_id")


@probe("flt-10", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'undecided' ELSE 'approved' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.source IN ('src0', 'src1') AND d.lang = 'en' AND coalesce(toxic, 0) = 0")
def _(t):
    rows = t.documents.select("doc_id", F.col("source").alias("source_kind"), F.col("lang").alias("review_state"))
    said = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "rejected").otherwise("approved").alias("decision"))
    parts = [V.queue(rows, said, "doc_id", ["src0", "src1"], ["en"], d).select("doc_id", "decision") for d in ("undecided", "approved")]
    return parts[0].union(parts[1])


@probe("flt-11", f"SELECT page_id FROM pages WHERE {_HOST} NOT IN ('cheap-pills.example.com') AND url NOT LIKE '%/es/%'")
def _(t):
    bad = t.pages.where(F.contains("url", F.lit("/es/"))).select(S.url_path("url").alias("path")).distinct()
    safe = t.pages.where(S.safe_url("url", ("cheap-pills.example.com",)).isNotNull()).withColumn("path", S.url_path("url"))
    return safe.join(bad, "path", "left_anti").select("page_id")


@probe("flt-12", "SELECT page_id, NOT (page_id % 5 = 0 OR url LIKE '%/fr/%') AS safe FROM pages")
def _(t):
    rows = t.pages.select("page_id", F.lit("menu").alias("kind"), "url")
    rejected = rows.where("page_id % 5 = 0").union(rows.where("page_id % 5 = 1").withColumn("kind", F.lit("order")))
    return V.pointer_safe(rows, rejected, ["page_id", "kind", "url"], F.contains("url", F.lit("/fr/"))).select("page_id", "safe")


@probe("flt-13", "SELECT l_orderkey, CASE WHEN arg_min(l_quantity, (l_linenumber, l_partkey)) > 10 THEN arg_min(l_partkey, (l_linenumber, l_partkey)) END AS action FROM lineitem GROUP BY l_orderkey")
def _(t):
    # of equal numbers and parts the line that the table has first
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    lines = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", *place, "l_quantity").alias("link"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("link")).alias("links"))
    lead = P.first_action("links")
    return rows.select("l_orderkey", F.when(lead["l_quantity"] > 10, lead["l_partkey"]).alias("action"))


@probe("flt-14", f"SELECT event_id, CASE WHEN ts > {_TS} THEN 'future' ELSE 'valid' END AS state, ts <= {_TS} AND ts >= {_TS} - INTERVAL 5 DAY AS recent FROM events")
def _(t):
    return t.events.select("event_id", D.publication_state("ts", AS_OF).alias("state"), D.is_recent("ts", AS_OF, 5).alias("recent"))


_POSTS = [  # a title, and the month and day on which its season ends (of 2024)
    ("our spring menu", "06-21"), ("Winter and spring menu", "03-21"), ("Summer garden party", None), ("springboard", None), ("Fall or winter?", "12-21"), ("Spring garden: this autumn", "12-21"), (None, None),
]


@probe("flt-15", "SELECT event_id, strftime(CASE WHEN event_id % 11 <> 0 THEN least(ts + INTERVAL 60 DAY, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 3 DAY END, CASE event_id % 7 " + " ".join(f"WHEN {k} THEN TIMESTAMP '2024-{end} 03:00:00'" for k, (_, end) in enumerate(_POSTS) if end) + " END) END, '%Y-%m-%d %H:%M:%S') AS expiry FROM events")
def _(t):
    title = F.element_at(F.array(*[F.lit(title) for title, _ in _POSTS]), (F.col("event_id") % 7 + 1).cast("int"))
    expires = F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("interval 3 days"))
    return t.events.select("event_id", F.date_format(P.post_expiry(title, F.expr("if(event_id % 11 <> 0, ts, null)"), expires), "yyyy-MM-dd HH:mm:ss").alias("expiry"))


@probe("flt-16", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1996-01-16 12:00:00' AND o_orderdate >= TIMESTAMP '1996-01-16 12:00:00' - INTERVAL 30 DAY AND o_orderkey % 4 <> 0")
def _(t):
    as_of = "1996-01-16 12:00:00"
    status = F.when(F.col("o_orderstatus") == "F", "verified_current").otherwise("stale")
    expires = F.when(F.col("o_orderkey") % 4 == 0, F.lit("1990-01-01").cast("timestamp_ntz"))
    none = F.lit(None).cast("timestamp_ntz")
    return t.orders.where(P.current_offer(status, F.lit("own_page"), "o_orderdate", expires, none, none, none, as_of)).select("o_orderkey")


@probe("flt-17", f"SELECT user_id, strftime(max(ts) FILTER (WHERE event_type <> 'error' AND ts <= {_TS}), '%Y-%m-%d %H:%M:%S') AS stamp FROM events GROUP BY user_id")
def _(t):
    eligible = (F.col("event_type") != "error") & (F.col("ts") <= D.moment(AS_OF))
    return t.events.groupBy("user_id").agg(F.date_format(F.max(F.when(eligible, F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@probe("flt-18", f"SELECT o_orderkey, o_orderstatus <> 'F' AND {_DAY} >= DATE '1995-06-01' AS active FROM orders")
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return t.orders.select("o_orderkey", P.active(status, F.to_date("o_orderdate"), "1995-06-01 12:00:00").alias("active"))


_PLACES = [  # name, brand, website, and the verdict: reason, field, token
    ("Burger Hut Harbour", None, None, "non_local_chain_label", "name", "burger hut"),
    ("The Old Donut Co", None, "https://x.example", "non_local_chain_label", "name", "donut co"),
    ("Corner", "Burger Hut’s", "https://burgerhut.example/", "non_local_chain_label", "brand", "burger hut"),
    ("Corner", None, "https://www.shop.burgerhut.example/a", "non_local_chain_website", "website", "burgerhut.example"),
    ("My Burger Hut Too", None, "https://notburgerhut.example", None, None, None),
    (None, None, None, None, None, None),
]
_said = lambda at: "CASE s_suppkey % 6 " + " ".join(f"WHEN {k} THEN '{row[at]}'" for k, row in enumerate(_PLACES) if row[at]) + " END"


@probe("flt-19", f"SELECT s_suppkey, {_said(3)} AS reason, {_said(4)} AS field, {_said(5)} AS token FROM supplier")
def _(t):
    pick = lambda at: F.element_at(F.array(*[F.lit(row[at]).cast("string") for row in _PLACES]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = t.supplier.select("s_suppkey", pick(0).alias("name"), pick(1).alias("brand"), pick(2).alias("website"))
    judged = P.chain_policy(rows, {"name": "name", "brand": "brand"}, {"website": "website"}, ["burger hut", "donut co"], ["burgerhut.example"])
    return judged.select("s_suppkey", "chain.reason", "chain.field", "chain.token")


_STATES = {301: "http_error", 302: "http_error", 200: "ok", 404: "broken", 500: "transient"}
_status = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN {status}" for k, status in enumerate(_STATES)) + " END"


@probe("flt-21", f"""
WITH r AS (SELECT user_id AS u, event_id, ts, {_status} AS status, lag({_status}) OVER w AS before, lag(ts) OVER w AS before_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT u, count(*) AS n, arg_max(status, event_id) AS last, coalesce(bool_or(before NOT IN (301, 302)), false) AS broken, coalesce(bool_or(ts < before_ts), false) AS disorder FROM r GROUP BY u)
SELECT u AS user_id, CASE WHEN u % 13 = 0 THEN 'not_covered' ELSE array_to_string(list_sort(list_filter([CASE WHEN u % 11 = 0 THEN 'unexpected' END, CASE WHEN broken THEN 'broken_chain' END, CASE WHEN disorder THEN 'out_of_order' END,
  CASE WHEN u % 17 = 0 THEN 'held_requested' END, CASE WHEN u % 17 = 0 THEN 'hold_ignored' END, CASE WHEN n > 4 THEN 'too_many_hops' END, CASE WHEN last IN (301, 302) THEN 'not_last_response' END,
  CASE WHEN u % 7 = 0 AND last <> 200 THEN 'wrong_state' END, CASE WHEN u % 7 <> 0 AND last = 404 THEN 'unconfirmed_broken' END], lambda x: x IS NOT NULL)), ',') END AS problems
FROM g WHERE u % 13 <> 0 OR u % 11 <> 0""")
def _(t):
    """Each user's events as the requests made for one address: some lead on, are out of time, too many or on hold, and some results say what no answer said."""
    u, url = F.col("user_id"), F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example/"))
    status = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    receipts = t.events.select("user_id", url.alias("url"), F.col("event_id").alias("seq"), F.lit(1).alias("attempt"), F.col("event_id").cast("string").alias("request_id"), url.alias("request_url"), status.alias("status"), F.when(status < 400, url).alias("redirect_url"), F.col("ts").alias("attempted_at"), F.col("ts").alias("observed_at"))
    last = F.max_by(F.struct("status", "observed_at"), "seq")
    results = receipts.groupBy("user_id", "url").agg(last.alias("last"), F.min("observed_at").alias("attempted_at"), F.max("observed_at").alias("assessed_at"))
    said = F.when(u % 7 == 0, "ok").otherwise(crawl.answer_state(F.col("last.status")))
    results = results.where(u % 13 != 0).select("url", said.alias("state"), F.lit(True).alias("attempted"), F.lit(1).alias("attempt"), "attempted_at", "assessed_at", "last.observed_at", "last.status", F.col("url").alias("final_url"), F.lit(False).alias("confirmed_broken"))
    hosts = t.events.where(u % 17 == 0).select(F.lit("host").alias("scope"), S.host_key(url).alias("value"))
    judged = crawl.report_problems(results, receipts.drop("user_id"), t.events.where(u % 11 != 0).select(url.alias("url")), hosts)
    return judged.select(F.regexp_extract("url", "h([0-9]+)", 1).cast("long").alias("user_id"), F.array_join("problems", ",").alias("problems"))


@probe("flt-21-repeats", "SELECT user_id, event_id, prior IS NOT NULL AND kind = 'error' AND prior = 'error' AS repeated FROM (SELECT user_id, event_id, event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM events)")
def _(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("user_id", "event_id", M.problems([("repeated", (F.col("event_type") == "error") & (before == "error"))]).alias("problems"))
    return rows.select("user_id", "event_id", (F.size("problems") > 0).alias("repeated"))


@probe("flt-22", f"SELECT page_id, {_HOST} IN (SELECT {_HOST} FROM pages WHERE page_id % 40 = 0) OR page_id % 41 = 0 AS held FROM pages")
def _(t):
    status = F.when(F.col("page_id") % 40 == 0, 429).when(F.col("page_id") % 41 == 0, 403)
    seen = t.pages.withColumn("scope", P.hold_scope(status)).where("scope is not null")
    holds = seen.select("scope", F.when(F.col("scope") == "host", S.host_key("url")).otherwise(F.col("url")).alias("value"))
    return P.held(t.pages.select("page_id", "url"), holds, "url").select("page_id", "held")


@probe("flt-23", "SELECT doc_id, quality = 1 AND toxic = 0 AS permitted FROM labels")
def _(t):
    word = lambda c, yes: F.when(F.col(c) == yes, "granted").otherwise("denied")
    return t.labels.select("doc_id", P.permitted(F.array(word("quality", 1), word("toxic", 0), F.lit(None)), ("granted", "owner")).alias("permitted"))


@probe("flt-24", """SELECT page_id, len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: length(x) <= 80 AND regexp_matches(lower(x), 'the|and'))) AS credible FROM pages""")
def _(t):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.size(F.filter(links, lambda x: (F.length(x) <= 80) & F.lower(x).rlike("the|and"))).cast("long").alias("credible"))


@probe("flt-25", f"SELECT event_id, ts <= {_TS} + INTERVAL 24 HOUR AND ts >= {_TS} - INTERVAL 14 DAY AS fresh FROM events")
def _(t):
    days = M.age_in_days("ts", AS_OF)
    return t.events.select("event_id", days.between(-1, 14).alias("fresh"))


@probe("flt-26", "SELECT c_custkey, c_custkey % 2 = 0 AS phone_ok, c_custkey % 3 <> 0 AS address_ok FROM customer")
def _(t):
    phone = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+1 902-555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))).otherwise("call us")
    address = F.when(F.col("c_custkey") % 3 == 0, "Unit 4").otherwise(F.concat("c_custkey", F.lit(" Elm St")))
    return t.customer.select("c_custkey", P.usable_phone(phone).alias("phone_ok"), P.usable_address(address).alias("address_ok"))


@probe("flt-27", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'changed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 1 THEN 7.5 ELSE c_acctbal END AS c_acctbal, CASE c_custkey % 3 WHEN 0 THEN 'c_name:rejected' WHEN 1 THEN 'c_name:overridden,c_acctbal:overridden' ELSE '' END AS audit FROM customer")
def _(t):
    said = lambda rest, field, verdict, value: t.customer.where(F.col("c_custkey") % 3 == rest).select("c_custkey", F.lit(field).alias("field"), F.lit(verdict).alias("verdict"), F.lit(value).cast("string").alias("value"))
    reviews = said(0, "c_name", "reject", None).union(said(1, "c_name", "override", "changed")).union(said(1, "c_acctbal", "override", "7.5"))
    out = V.field_rejections(t.customer, reviews, "c_custkey", ["c_name", "c_acctbal"])
    return out.select("c_custkey", "c_name", "c_acctbal", F.array_join("audit", ",").alias("audit"))


@probe("flt-28", "SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 'verified' WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN 'needs_review' ELSE 'rejected' END AS disposition FROM pages")
def _(t):
    return t.pages.select("page_id", P.disposition(F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0).alias("disposition"))


@probe("flt-29", "SELECT s_suppkey, s_suppkey % 100 BETWEEN -90 AND 90 AND s_suppkey % 200 BETWEEN -180 AND 180 AS valid FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", N.valid_coordinates(F.col("s_suppkey") % 100, F.col("s_suppkey") % 200).alias("valid"))


_LINKS = [("https://a.example/{{url}}", "template"), ("https://a.example/oembed?x=1", "oembed"), ("https://a.example/", "generic_path"), ("https://a.example/Home/", "generic_path"), ("https://a.example/?p=5", None), ("https://a.example/menu", None)]


@probe("flt-31", "SELECT page_id, CASE page_id % 6 " + " ".join(f"WHEN {k} THEN '{why}'" for k, (_, why) in enumerate(_LINKS) if why) + " END AS why FROM pages")
def _(t):
    url = F.element_at(F.array(*[F.lit(u) for u, _ in _LINKS]), (F.col("page_id") % 6 + 1).cast("int"))
    return t.pages.select("page_id", V.rejected_link(url).alias("why"))


@probe("flt-32", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 0")
def _(t):
    rows = t.documents.select(F.md5("text").alias("k"), F.coalesce("source", F.lit("")).alias("source"), "doc_id").withColumn("k", F.coalesce("k", F.lit("")))
    return V.without_reviewed(rows, rows.where("doc_id % 9 = 0").union(rows.where("doc_id % 9 = 1").withColumn("source", F.lit("other"))), ["k", "source", "doc_id"]).select("doc_id")


@probe("flt-33", """
SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN doc_id % 2 = 0 THEN 'url is not https' END, CASE WHEN doc_id % 3 = 0 THEN 'no alternative text' END, CASE WHEN doc_id % 5 = 0 THEN 'no credit' END, CASE WHEN quality = 0 THEN 'rights not approved' END,
  CASE WHEN doc_id % 7 = 0 THEN 'no size' END, CASE WHEN toxic = 1 THEN 'not reviewed' END, CASE WHEN doc_id % 11 = 0 THEN 'expired' END] IF x IS NOT NULL], ';') AS problems FROM labels""")
def _(t):
    d, at = F.col("doc_id"), F.lit(AS_OF).cast("timestamp")
    rows = t.labels.select(
        "doc_id", F.when(d % 2 == 0, "http://a.example/x").otherwise("https://a.example/x").alias("url"), F.when(d % 3 != 0, "alt").otherwise(" ").alias("alt"), F.when(d % 5 != 0, "me").alias("credit"),
        F.when(F.col("quality") == 1, "production_approved").alias("rights"), F.when(d % 7 != 0, 10).alias("width"), F.lit(10).alias("height"), F.when(F.col("toxic") == 0, at).alias("reviewed_at"), F.when(d % 11 == 0, at).alias("expires_at"), at.alias("as_of"),
    )
    return rows.select("doc_id", F.array_join(V.publication_problems(rows), ";").alias("problems"))


@probe("flt-34", "SELECT s_suppkey, s_suppkey % 10 >= 2 AND s_suppkey % 10 + 1 <= 8 AND s_suppkey % 7 >= 1 AND s_suppkey % 7 + 1 <= 6 AS inside FROM supplier")
def _(t):
    x, y = F.col("s_suppkey") % 10, F.col("s_suppkey") % 7
    return t.supplier.select("s_suppkey", (N.in_box(x, y, (2, 1, 8, 6)) & N.in_box(x + 1, y + 1, (2, 1, 8, 6))).alias("inside"))


@probe("flt-35", "SELECT user_id, event_id, CAST((ts < prior)::INT + (value < 0)::INT AS INT) AS n_problems FROM (SELECT *, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) AS prior FROM events)")
def _(t):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", "event_id", F.size(M.problems([("clock went back", F.col("ts") < before), ("negative", F.col("value") < 0)])).alias("n_problems"))


@probe("flt-36", "SELECT doc_id, quality IN (0, 1) AS valid FROM labels")
def _(t):
    raw = F.to_json(F.struct("doc_id", "quality"))
    read = F.from_json(raw, "doc_id long, quality int", {"mode": "PERMISSIVE"})
    exact = F.array_sort(F.json_object_keys(raw)) == F.array(F.lit("doc_id"), F.lit("quality"))
    return t.labels.select("doc_id", (exact & read["quality"].isin(0, 1)).alias("valid"))


@probe("flt-37", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'withdrawn' WHEN 3 THEN 'pending' ELSE 'rejected' END AS state FROM documents")
def _(t):
    said = lambda rest, at, what: t.documents.where(F.col("doc_id") % 5 == rest).select("doc_id", F.lit(at).alias("at"), F.lit(what).alias("decision"))
    rows = said(1, 1, "approved").union(said(2, 5, "withdrawn")).union(said(2, 1, "approved")).union(said(3, 1, "withdrawn")).union(said(4, 2, "rejected")).union(said(4, 1, "approved"))
    return V.fold_decisions(t.documents, rows, "doc_id")


_at = "2024-01-20T00:00:00.000Z"
_SOURCE = "source_id string, name string, kind string, hosts array<string>, status string"


@probe("flt-36-sources", """
SELECT 'src-' || k AS source_id, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'kind' END, CASE WHEN k % 5 = 0 THEN 'url' END, CASE WHEN s_acctbal > 0 AND (k % 3 = 0 OR k % 7 = 0) THEN 'not_admitted' END,
  CASE WHEN k % 3 <> 0 AND k % 13 = 0 THEN 'evidence' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT s_suppkey AS k, s_acctbal FROM supplier)""")
def _(t):
    """Suppliers as sources of news: some of an unknown kind, with a home elsewhere, enabled before they are admitted, or admitted without rights."""
    k = F.col("s_suppkey")
    host = lambda n: F.concat(F.lit("h"), n.cast("string"), F.lit(".example"))
    home = lambda n: F.concat(F.lit("https://"), host(n), F.lit("/"))
    shown = F.map_filter(F.create_map(*[F.lit(x) for name in ("access", "schema", "date", "rights") for x in (name, "seen")]), lambda name, _: (name != "rights") | (k % 13 != 0))
    rows = t.supplier.select(
        F.concat(F.lit("src-"), k.cast("string")).alias("source_id"), F.col("s_name").alias("name"), F.when(k % 11 == 0, "blog").otherwise("newsroom").alias("kind"), F.array(host(F.col("s_nationkey"))).alias("hosts"), (F.col("s_acctbal") > 0).alias("enabled"),
        F.when(k % 3 == 0, "proposed").otherwise("admitted").alias("status"), home(F.col("s_nationkey") + (k % 5 == 0).cast("int")).alias("home_url"), F.when(k % 7 != 0, home(F.col("s_nationkey"))).alias("feed_url"), F.lit(_at).alias("reviewed_at"), shown.alias("evidence"),
    )
    return news.registry_problems(rows).withColumn("problems", F.array_join("problems", ","))


@probe("flt-37-items", """
WITH d AS (SELECT doc_id, lang, left(text, CAST(280 + doc_id % 40 AS INT)) AS t, 'https://a.example/' || CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE doc_id END AS url FROM documents), e AS (SELECT *, count(*) OVER (PARTITION BY url) > 1 AS many FROM d)
SELECT 'news-' || left(sha256(url), 24) AS id, array_to_string(list_filter([CASE WHEN many THEN 'repeated_id' END, CASE WHEN many THEN 'repeated_url' END, CASE WHEN doc_id % 7 = 0 THEN 'unknown_source' END,
  CASE WHEN NOT coalesce(length(t) BETWEEN 1 AND 300 AND NOT regexp_matches(t, '[<>\\x00-\\x1f]') AND left(t, 1) <> ' ' AND right(t, 1) <> ' ' AND length(lang) > 0, false) THEN 'text' END,
  CASE WHEN doc_id % 31 > 15 THEN 'clock_order' END], lambda x: x IS NOT NULL), ',') AS problems FROM e""")
def _(t):
    """Documents as accepted items: two of ten share an address, titles are what the texts begin with, and some were published after they were seen."""
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    sources = t.spark.createDataFrame([("s", "City", "newsroom", ["a.example"], "admitted"), ("t", "Town", "newsroom", ["a.example"], "proposed")], _SOURCE)
    url = F.concat(F.lit("https://a.example/"), (k - (k % 10 == 3).cast("int")).cast("string"))
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 31 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))
    fixed = {"source_name": "City", "kind": "newsroom", "guid": "g", "region_evidence": "named", "precision": "instant", "observed_at": "2024-01-16T00:00:00.000Z", "reviewed_at": _at, "correction": "none", "summary_kind": "none", "reviewer": "r", "rights_basis": "stated"}
    items = t.documents.select(
        F.concat(F.lit("news-"), F.left(F.sha2(url, 256), F.lit(24))).alias("id"), url.alias("url"), F.when(k % 7 == 0, "t").otherwise("s").alias("source_id"), F.left("text", (k % 40 + 280).cast("int")).alias("title"), F.col("lang").alias("region"), F.array(F.lit("roads")).alias("topics"),
        day.alias("published_at"), none.alias("modified_at"), none.alias("summary"), *[F.lit(v).alias(n) for n, v in fixed.items()],
    )
    return news.item_problems(items, sources).withColumn("problems", F.array_join("problems", ","))


@probe("flt-38", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'mismatch' ELSE 'fits' END AS state FROM orders")
def _(t):
    k = F.col("o_orderkey")
    index = t.orders.where(k % 5 != 0).select("o_orderkey", (k * 100).alias("offset"), F.lit(100).cast("long").alias("length"))
    index = index.union(index.where(k % 5 == 1))
    responses = t.orders.select("o_orderkey", (k * 100).alias("first"), (k * 100 + 99).alias("last"), F.when(k % 5 == 2, 99).otherwise(100).cast("long").alias("size"))
    return V.index_fits(index, responses, ["o_orderkey"])


@probe("flt-39", f"SELECT o_orderkey FROM orders WHERE o_orderkey % 12 + 1 > 7 AND {_DAY} <= DATE '1996-02-15' AND {_DAY} + (o_orderkey % 12)::INT >= DATE '1996-01-16'")
def _(t):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 12).cast("int"))
    lo, hi = D.window_bounds("30", F.lit("1996-01-16").cast("date"))
    return t.orders.where(D.overlaps(start, end, lo, hi) & (D.duration_kind(start, end) == "long")).select("o_orderkey")


@probe("flt-40", "SELECT DISTINCT lang AS region FROM documents WHERE n_chars > 0")
def _(t):
    return t.documents.where("n_chars > 0").select(F.col("lang").alias("region")).distinct().orderBy("region")


@probe("flt-41", "SELECT source, count(*) AS n, count(*) < 45 AS failed FROM documents GROUP BY source")
def _(t):
    floors = t.documents.select("source").distinct().withColumn("floor", F.lit(45))
    return M.count_by(t.documents, "source").join(F.broadcast(floors), "source").select("source", "n", (F.col("n") < F.col("floor")).alias("failed"))


# --- projections -------------------------------------------------------------


@probe("prj-01", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 'menu,order' ELSE '' END AS actions, s_suppkey % 4 <> 0 AND s_acctbal > 0 AS can_order FROM supplier")
def _(t):
    active = F.col("s_suppkey") % 4 != 0
    actions = F.when(active, F.array(F.lit("menu"), F.lit("order"))).otherwise(F.array().cast("array<string>"))
    return t.supplier.select("s_suppkey", F.array_join(actions, ",").alias("actions"), (active & (F.col("s_acctbal") > 0)).alias("can_order"))


@probe("prj-02", "SELECT s_suppkey, CAST(least(95, 45 + CASE WHEN s_acctbal > 0 THEN 12 ELSE 0 END + 8 + CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN s_nationkey < 20 THEN 10 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 15 ELSE 0 END) AS INT) AS score FROM supplier")
def _(t):
    k = F.col("s_suppkey")
    score = coverage_score(F.col("s_acctbal") > 0, F.lit(True), k % 2 == 0, k % 3 == 0, k % 3 == 0, F.col("s_nationkey") < 20, k % 3 == 0)
    return t.supplier.select("s_suppkey", score.alias("score"))


def coverage_score(website, address, phone, cuisines, hours, signal, inspected):
    """Fixed points for each kind of evidence on a base of 45, at most 95."""
    total = F.lit(45)
    for has, points in ((website, 12), (address, 8), (phone, 5), (cuisines, 5), (hours, 5), (signal, 10), (inspected, 5)):
        total = total + F.when(has, points).otherwise(0)
    return F.least(F.lit(95), total)


@probe("prj-03", "SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS search FROM part")
def _(t):
    fields = F.filter(F.array("p_name", F.lit(None), F.lit(""), "p_brand", "p_type"), lambda x: x != "")
    return t.part.select("p_partkey", F.lower(F.array_join(fields, " ")).alias("search"))


_KINDS = (("cafe|coffee|bakery|copper", "cafe"), ("bar|pub|brew|brass", "bar"), ("fast|quick|food court|ice cream|dessert|steel", "quick"))


@probe("prj-04", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'cafe|coffee|bakery|copper') THEN 'cafe' WHEN regexp_matches(lower(p_type), 'bar|pub|brew|brass') THEN 'bar' WHEN regexp_matches(lower(p_type), 'fast|quick|food court|ice cream|dessert|steel') THEN 'quick' ELSE 'restaurant' END AS kind FROM part")
def _(t):
    return t.part.select("p_partkey", S.ladder("p_type", _KINDS, "restaurant").alias("kind"))


_TOWNS = [("DARTMOUTH", None, "Dartmouth"), (" halifax ", "Bedford Row, Dartmouth", "Halifax"), ("", "5 Bedford Hwy", "Bedford"), ("Hammonds Plains", "Halifax County", "Halifax"), ("Truro", "1 Main", "Truro"), (None, None, "Halifax")]


@probe("prj-05", "SELECT c_custkey, CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN '{town}'" for k, (_, _, town) in enumerate(_TOWNS)) + " END AS town FROM customer")
def _(t):
    pick = lambda at: F.element_at(F.array(*[F.lit(row[at]).cast("string") for row in _TOWNS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t.customer.select("c_custkey", V.municipality(pick(0), pick(1)).alias("town"))


_PRICES = [  # what an event says of its price, and what that comes to
    ("Free", "free"), ("$15 general admission", "paid"), ("Admission $0", "free"), ("no $5 entry", "unknown"), ("Adults $12; free entry", "paid"), ("20 dollars", "paid"), ("see site", "unknown"), ("$0", "free"),
    ("Free admission, tickets $10", "unknown"), ("Adults – $12", "paid"), ("Public — 20 dollars", "paid"), ("Free for children; adults $20", "paid"), ("Tickets cost: $7.50", "paid"), ("$9 for the public", "paid"), ("not for adults $9", "paid"), ("without admission fee of $4", "unknown"), ("General admission fee is $0!", "unknown"), ("donation of $5", "unknown"), (None, "unknown"),
]


@probe("prj-06", f"SELECT doc_id, CASE doc_id % {len(_PRICES)} " + " ".join(f"WHEN {k} THEN '{said}'" for k, (_, said) in enumerate(_PRICES)) + " END AS cost FROM documents")
def _(t):
    price = F.element_at(F.array(*[F.lit(price) for price, _ in _PRICES]), (F.col("doc_id") % len(_PRICES) + 1).cast("int"))
    return t.documents.select("doc_id", P.cost_kind(price).alias("cost"))


@probe("prj-07", f"SELECT event_id, CASE WHEN event_type = 'view' THEN 'all_day' WHEN hour({_LOCAL}) < 12 THEN 'morning' WHEN hour({_LOCAL}) < 17 THEN 'afternoon' ELSE 'evening' END AS kind FROM events")
def _(t):
    return t.events.select("event_id", D.time_kind("ts", F.col("event_type") == "view").alias("kind"))


@probe("prj-08", "SELECT o_orderkey, CAST(o_orderkey % 12 + 1 AS INT) AS days, CASE WHEN o_orderkey % 12 + 1 > 7 THEN 'long' ELSE 'short' END AS kind FROM orders")
def _(t):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 12).cast("int"))
    return t.orders.select("o_orderkey", D.inclusive_days(start, end).alias("days"), D.duration_kind(start, end).alias("kind"))


@probe("prj-09", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://tickets.example/' || page_id ELSE url END AS link FROM pages")
def _(t):
    ticket = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://tickets.example/"), "page_id"))
    return t.pages.select("page_id", F.coalesce(S.safe_url(F.lit("javascript:x")), S.safe_url(ticket), S.safe_url("url")).alias("link"))


@probe("prj-10", "SELECT doc_id, CASE WHEN length(text) > 100 THEN rtrim(left(text, 99)) || '…' ELSE text END AS title FROM documents")
def _(t):
    return t.documents.select("doc_id", S.ellipsis("text").alias("title"))


@probe("prj-11", "SELECT conv_id, turn, left(sha256(role || '|' || conv_id || '|' || turn), 12) AS post_id, CAST(CASE WHEN role = 'user' THEN 0.9 WHEN turn < 3 THEN 0.84 ELSE 0.7 END AS DOUBLE) AS confidence, length(text) > 200 AS long FROM conversations")
def _(t):
    confidence = F.when(F.col("role") == "user", 0.9).when(F.col("turn") < 3, 0.84).otherwise(0.7)
    return t.conversations.select("conv_id", "turn", S.hash_id(["role", F.col("conv_id").cast("string"), F.col("turn").cast("string")], 12).alias("post_id"), confidence.alias("confidence"), (F.length("text") > 200).alias("long"))


# What a title says, and the kind of offer that makes it; the first that fits counts.
SPECIALS = (("happy hour", "happy_hour"), ("wing", "wing_night"), ("taco", "taco_night"), ("oyster", "oyster_special"), ("wine", "wine_special"), ("brunch", "brunch"), ("prix|fixed|fixe", "prix_fixe"), ("tasting", "tasting_menu"), ("lunch", "lunch_special"))


@probe("prj-12", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'wing_night' WHEN 1 THEN 'prix_fixe' ELSE 'daily_or_promotional_special' END AS kind FROM documents")
def _(t):
    title = F.element_at(F.array(F.lit("Wing & Wine"), F.lit("Lunch prix fixe"), F.lit("Soup")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", S.ladder(title, SPECIALS, "daily_or_promotional_special").alias("kind"))


@probe("prj-13", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'source_lead' WHEN o_orderkey % 4 = 0 AND o_orderdate < TIMESTAMP '1996-01-16 12:00:00' THEN 'expired'
  WHEN o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1995-12-17 12:00:00' AND TIMESTAMP '1996-01-16 12:00:00' THEN 'verified_current' WHEN o_orderstatus = 'F' THEN 'stale' WHEN o_orderkey % 3 = 0 THEN 'likely_recurring_verify' ELSE 'source_lead' END AS status FROM orders""")
def _(t):
    k, none = F.col("o_orderkey"), F.lit(None).cast("timestamp_ntz")
    status = P.special_status("1996-01-16 12:00:00", F.col("o_orderstatus") == "F", "o_orderdate", none, F.when(k % 4 == 0, F.col("o_orderdate")), F.when(k % 3 == 0, "weekly"), k % 10 != 0, F.lit(True))
    return t.orders.select("o_orderkey", status.alias("status"))


_first = lambda name, rules: "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{words}') THEN '{label}' END" for label, words in rules) + "] IF x IS NOT NULL]"


@probe("prj-14", f"SELECT doc_id, CASE WHEN len(a) = 0 THEN 'Other' ELSE array_to_string(a, ',') END AS imported, array_to_string(b, ',') AS cleaned FROM (SELECT doc_id, {_first('a', facts.IMPORT_CATEGORIES)} AS a, {_first('b', facts.CLEAN_CATEGORIES)} AS b FROM documents)")
def _(t):
    both = [F.array_join(facts.categories("text", rules, other), ",").alias(name) for name, rules, other in (("imported", facts.IMPORT_CATEGORIES, "Other"), ("cleaned", facts.CLEAN_CATEGORIES, None))]
    return t.documents.select("doc_id", *both)


@probe("prj-15", "SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'menu' WHEN contains(url, '/fr/') THEN 'reservation' ELSE 'related' END AS kind FROM pages")
def _(t):
    return t.pages.select("page_id", S.ladder("url", (("/de/|menu", "menu"), ("/fr/|reserv", "reservation")), "related").alias("kind"))


@probe("prj-16", r"SELECT page_id, CASE WHEN host LIKE '%.example.com' THEN 'com' WHEN host LIKE '%.example.net' THEN 'net' END AS platform, regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) AS handle FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)")
def _(t):
    host = S.host_key("url")
    platform = F.coalesce(*[F.when((host == h) | F.endswith(host, F.lit("." + h)), n) for h, n in (("example.com", "com"), ("example.net", "net"))])
    return t.pages.select("page_id", platform.alias("platform"), F.split(S.url_path("url"), "/")[1].alias("handle"))


@probe("prj-17", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 2 ELSE 1 END AS rank FROM labels")
def _(t):
    basis = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "authoritative").when(F.col("quality") == 1, "very_high").otherwise("high")
    return t.labels.select("doc_id", F.when(basis == "authoritative", 3).when(basis == "very_high", 2).otherwise(1).alias("rank"))


_IMAGES = [  # url, source url, host state, probe ok, width, height, content type, bytes, source kind, confidence, review state, rights, and: flags, priority, state
    ("https://a.example/plate.jpg", "https://a.example/", None, True, 800, 600, "image/jpeg", 90_000, "official_feed_media", None, None, None, "", 58, "needs_visual_review"),
    ("http://a.example/logo.png", None, None, None, None, None, None, None, None, None, None, None, "insecure_thumbnail_url,logo_candidate", 11, "low_quality_metadata"),
    ("https://a.example/favicon-32x32.ico", None, None, False, 32, 32, "text/html", 900, None, None, None, None, "icon_or_favicon,logo_candidate,image_probe_failed,non_image_response,tiny_decoded_image,very_small_image_payload", 0, "low_quality_metadata"),
    ("https://a.example/og-image.jpg", "https://www.facebook.com/a", "remote_image_host_needs_source_check", True, 1200, 400, "image/png", 50_000, "official_page_thumbnail_candidate", "same_host_official_page_image", None, None, "generic_social_card,social_profile_image,remote_image_host_needs_source_check,awkward_thumbnail_aspect", 0, "source_check"),
    ("https://a.example/menu", "https://a.example/menu", "blocked_source_host", None, None, None, None, None, None, None, "approved", "production_approved", "thumbnail_is_page_url,blocked_source_host", 100, "approved"),
    ("https://a.example/i?w=120&x=placeholder", None, None, True, None, 9, "", 0, None, None, "approved", None, "placeholder_image,logo_candidate", 0, "low_quality_metadata"),
    ("https://a.example/social.jpg", None, None, None, None, None, None, None, None, None, None, None, "generic_social_card", 42, "low_quality_metadata"),
    (None, None, None, None, None, None, None, None, None, None, None, None, "", 46, "needs_visual_review"),
]
_image = lambda at, quote="'": f"CASE page_id % {len(_IMAGES)} " + " ".join(f"WHEN {k} THEN {quote}{row[at]}{quote}" for k, row in enumerate(_IMAGES)) + " END"


@probe("prj-18", f"SELECT page_id, {_image(12)} AS flags, {_image(13, '')} AS priority, {_image(14)} AS state FROM pages")
def _(t):
    kinds = ["string"] * 3 + ["boolean", "int", "int", "string", "bigint"] + ["string"] * 4
    pick = [F.element_at(F.array(*[F.lit(row[at]).cast(kind) for row in _IMAGES]), (F.col("page_id") % len(_IMAGES) + 1).cast("int")).alias(f"c{at}") for at, kind in enumerate(kinds)]
    none = F.lit(None).cast("string")
    rows = t.pages.select("page_id", *pick)
    rows = rows.withColumn("flags", media.thumbnail_flags(*[f"c{k}" for k in range(8)], none, none))
    rows = rows.withColumn("priority", media.thumbnail_priority("flags", "c0", "c8", "c9", "c10", "c11"))
    return rows.select("page_id", F.array_join("flags", ",").alias("flags"), "priority", media.thumbnail_state("flags", "priority", "c10", "c11").alias("state"))


@probe("prj-19", f"SELECT page_id, CASE WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'first_party' WHEN h LIKE '%.example.net' THEN 'cdn' ELSE 'source_host_not_first_party' END AS state FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def _(t):
    host = S.host_key("url")
    return t.pages.select("page_id", F.when(S.same_site(host, F.lit("example.com")), "first_party").when(F.endswith(host, F.lit(".example.net")), "cdn").otherwise("source_host_not_first_party").alias("state"))


@probe("prj-20", "SELECT p_partkey, CAST(p_size + CASE WHEN p_brand = 'Brand#12' THEN 20 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 10 ELSE 0 END AS INT) AS score FROM part")
def _(t):
    return t.part.select("p_partkey", (F.col("p_size") + F.when(F.col("p_brand") == "Brand#12", 20).otherwise(0) + F.when(F.contains(F.lower("p_type"), F.lit("steel")), 10).otherwise(0)).alias("score"))


@probe("prj-21", "SELECT event_id, ['ok', 'broken', 'restricted', 'transient', 'http_error'][event_id % 5 + 1] AS state FROM events")
def _(t):
    code = F.element_at(F.array(*map(F.lit, (204, 410, 429, 503, 418))), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", P.link_state(code).alias("state"))


@probe("prj-22", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS value FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.coalesce(S.truthy(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ")), F.col("c_mktsegment")).alias("value"))


@probe("prj-23", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'coming_soon' ELSE 'unknown' END AS status, 'Blue Door' AS name, CASE WHEN doc_id % 3 < 2 THEN 'Quinpool Road' ELSE '' END AS place FROM documents")
def _(t):
    text = F.element_at(F.array(F.lit("Blue Door is now open on Quinpool Road."), F.lit("Blue Door opening soon on Quinpool Road."), F.lit("Blue Door has news.")), (F.col("doc_id") % 3 + 1).cast("int"))
    status = S.ladder(text, (("now open|has opened", "open"), ("opening soon|coming soon", "coming_soon")), "unknown")
    return t.documents.select("doc_id", status.alias("status"), F.regexp_extract(text, "^((?:[A-Z][a-z]+ ?)+?) (?:is|has|opening)", 1).alias("name"), F.regexp_extract(text, " on ((?:[A-Z][a-z]+ ?)+)[.]", 1).alias("place"))


_MENTIONS = [  # a post, its kinds, and: dates, times, prices, relative dates, conditions, status
    ("Oysters $2.50 on June 3rd, 5pm - 7 p.m. Dine-in only, plus tax", ["specials"], "June 3rd", "5pm,7 p.m", "$2.50", "", "dine_in_only,tax_extra", "unverified"),
    ("Tonight and every Friday: CAD $1,200 prize, 19+. Sold out!", ["events", "news"], "", "", "CAD $1,200", "Tonight,every Friday", "age_restriction_19_plus", "possible_sold_out"),
    ("2024-02-01 show cancelled, 2024-02-01 moved to Mar. 4, 2024", ["events"], "2024-02-01,Mar. 4, 2024", "", "", "", "", "possible_cancellation"),
    ("Wings $9 today", ["news"], None, None, None, None, None, None),
    ("", ["specials", "events"], "", "", "", "", "", "unverified"),
]
_mention = lambda at: f"CASE doc_id % {len(_MENTIONS)} " + " ".join(f"WHEN {k} THEN '{row[at]}'" for k, row in enumerate(_MENTIONS) if row[at] is not None) + " END"


@probe("prj-24", f"SELECT doc_id, {_mention(2)} AS dates, {_mention(3)} AS times, {_mention(4)} AS prices, {_mention(5)} AS relative_dates, {_mention(6)} AS conditions, {_mention(7)} AS status FROM documents")
def _(t):
    at = (F.col("doc_id") % len(_MENTIONS) + 1).cast("int")
    text = F.element_at(F.array(*[F.lit(row[0]) for row in _MENTIONS]), at)
    kinds = F.element_at(F.array(*[F.array(*map(F.lit, row[1])) for row in _MENTIONS]), at)
    rows = t.documents.select("doc_id", facts.fact_candidate(text, kinds).alias("x"))
    return rows.select("doc_id", *[F.array_join(f"x.{c}", ",").alias(c) for c in ("dates", "times", "prices", "relative_dates", "conditions")], "x.status")


@probe("prj-26", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.when(F.date_format("o_orderdate", "HH:mm") == "00:00", F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format(D.local("o_orderdate"), "yyyy-MM")).alias("month"))


@probe("prj-27", "SELECT p_partkey, array_to_string(list_slice(list_filter([CASE WHEN p_size > 25 THEN 'large' END, p_brand, CASE WHEN p_retailprice > 1500 THEN 'dear' END], lambda x: x IS NOT NULL), 1, 2), ',') AS tags FROM part")
def _(t):
    tags = F.array_compact(F.array(F.when(F.col("p_size") > 25, "large"), F.col("p_brand"), F.when(F.col("p_retailprice") > 1500, "dear")))
    return t.part.select("p_partkey", F.array_join(F.slice(tags, 1, 2), ",").alias("tags"))


@probe("prj-28", f"SELECT user_id, count(*) FILTER (WHERE ts >= {_TS}) AS hours_left, CASE WHEN count(*) FILTER (WHERE ts >= {_TS}) = 0 THEN 'historical' WHEN max(ts) FILTER (WHERE ts <= {_TS}) >= {_TS} - INTERVAL 2 HOUR THEN 'fresh' ELSE 'stale' END AS state FROM events GROUP BY user_id")
def _(t):
    now = D.moment(AS_OF)
    ahead = F.count_if(F.col("ts") >= now)
    last = F.max(F.when(F.col("ts") <= now, F.col("ts")))
    return t.events.groupBy("user_id").agg(ahead.alias("hours_left"), F.when(ahead == 0, "historical").when(last >= now - F.expr("interval 2 hours"), "fresh").otherwise("stale").alias("state"))


@probe("prj-29", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Music' WHEN 1 THEN 'Family,Community' ELSE 'Other' END AS labels FROM documents")
def _(t):
    title = F.element_at(F.array(F.lit("Concert in the park"), F.lit("Kids day"), F.lit("Open house")), (F.col("doc_id") % 3 + 1).cast("int"))
    first = F.when(F.lower(title).rlike("concert|music"), F.array(F.lit("Music"))).when(F.lower(title).rlike("kids|family"), F.array(F.lit("Family"), F.lit("Community"))).otherwise(F.array(F.lit("Other")))
    return t.documents.select("doc_id", F.array_join(first, ",").alias("labels"))


@probe("prj-30", "SELECT l_orderkey, count(*) FILTER (WHERE n <= 3 AND l_quantity > 20) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem) GROUP BY l_orderkey")
def _(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("all"))
    return rows.select("l_orderkey", F.size(slots("all", 3, lambda x: x["l_quantity"] > 20)).cast("long").alias("shown"))


@probe("prj-31", r"SELECT doc_id, '902-555-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS phone, CAST(doc_id + 1 AS VARCHAR) || ' Elm St' AS address FROM documents")
def _(t):
    n = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("About us\nCall 902-555-"), n, F.lit("\n"), (F.col("doc_id") + 1).cast("string"), F.lit(" Elm St\n99 Oak Ave"))
    line = F.try_element_at(F.filter(F.split(text, "\n"), P.usable_address), F.lit(1))
    return t.documents.select("doc_id", F.regexp_extract(text, "([0-9]{3}-[0-9]{3}-[0-9]{4})", 1).alias("phone"), line.alias("address"))


@probe("prj-32", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'warm' WHEN contains(lower(p_type), 'steel') THEN 'cool' ELSE 'plain' END AS tone FROM part")
def _(t):
    return t.part.select("p_partkey", S.ladder("p_type", (("brass", "warm"), ("steel", "cool")), "plain").alias("tone"))
