"""Snapshot reconciliation, sorting, sinks and release checks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaza.functions import dates as D
from plaza.functions import schedules as H
from plaza.functions import text as S
from plaza.functions.collections import meaningful_hash
from plaza.operators import evaluation
from plaza.operators import reconcile as R
from plaza.operators import sets as U
from plaza.probes.base import AS_OF, probe
from plaza.sources import files, release, sinks

_TS = f"TIMESTAMP '{AS_OF}'"
_OLD, _NEW = "event_id % 3 <> 0", "event_id % 4 <> 0"


def snapshots(t):
    """Previous and current snapshot of the events, overlapping by id; the event type is the source."""
    rows = t.events.select("event_id", "ts", "user_id", F.col("event_type").alias("source"), "value")
    return rows.where(_OLD), rows.where(_NEW)


@probe("cdc-01", f"""
SELECT event_id, CASE WHEN value > 250 THEN 'cancelled' WHEN ts < {_TS} - INTERVAL 6 HOUR THEN 'expired' WHEN event_type = 'click' THEN 'retained' ELSE 'held' END AS verdict FROM events WHERE {_OLD} AND NOT ({_NEW})""")
def _(t):
    old, new = snapshots(t)
    old = old.withColumn("status", F.when(F.col("value") > 250, "cancelled"))
    failed = t.spark.range(1).select(F.lit("click").alias("source"))
    return R.future_losses(new, old, "event_id", "source", "ts", "status", AS_OF, failed).select("event_id", "verdict")


@probe("cdc-02", f"WITH o AS (SELECT user_id % 50 AS source, count(*) AS n FROM events WHERE {_OLD} GROUP BY 1), c AS (SELECT user_id % 50 AS source, count(*) AS n FROM events WHERE {_NEW} AND user_id % 50 >= 10 GROUP BY 1) SELECT coalesce(o.source, c.source) AS source, coalesce(o.n, 0) AS before, coalesce(c.n, 0) AS now, CASE WHEN o.n >= 20 AND c.n IS NULL THEN 'carried' ELSE 'normal' END AS state FROM o FULL JOIN c ON c.source = o.source")
def _(t):
    old, new = (s.withColumn("source", F.col("user_id") % 50) for s in snapshots(t))
    return R.source_drift(new.where("source >= 10"), old, "source", 2.0)


@probe("cdc-03", f"SELECT event_id, NOT ({_NEW}) AS retained FROM events WHERE {_NEW} OR ({_OLD} AND event_type IN ('click', 'error'))")
def _(t):
    old, new = snapshots(t)
    failures = t.events.where("event_type in ('click', 'error')").select(F.col("event_type").alias("source")).distinct()
    return R.retain_failed(new, old, failures, "event_id", "source").select("event_id", "retained")


@probe("cdc-04", f"SELECT event_id FROM events WHERE {_NEW} OR ({_OLD} AND ts >= {_TS})")
def _(t):
    old, new = snapshots(t)
    return R.retain_recent(new, old, "event_id", "ts", AS_OF).select("event_id")


@probe("cdc-05", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'not_attempted' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM orders")
def _(t):
    old = t.orders.where("o_orderkey % 7 <> 0 or o_orderkey % 5 = 0").select("o_orderkey", F.col("o_orderpriority").alias("evidence"))
    fresh = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise(F.col("o_orderpriority")).alias("evidence"))
    tried = t.orders.where("o_orderkey % 5 = 0 and o_orderkey % 2 = 0").select("o_orderkey", F.lit("failed").alias("state"))
    return R.fact_changes(old, fresh, tried, "o_orderkey", "evidence").select("o_orderkey", "outcome")


@probe("cdc-06", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS content FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", meaningful_hash(["o_orderpriority", "o_custkey", "o_orderdate"], clocks=["o_orderdate"]).alias("content"))


@probe("cdc-07", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 'kept' WHEN event_id % 20 = 0 THEN 'quarantined' ELSE 'mismatch' END AS verdict FROM events")
def _(t):
    archive = t.events.where("event_id % 10 = 0").select("event_id", "user_id", F.when(F.col("event_id") % 20 == 0, F.col("event_type")).otherwise("other").alias("event_type"))
    return R.quarantine(t.events.select("event_id", "user_id", "event_type"), archive, "event_id", ["user_id", "event_type"]).select("event_id", "verdict")


@probe("cdc-08", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderstatus = 'F' THEN 'retained' WHEN o_orderkey % 3 = 1 THEN 'pending' ELSE 'disqualified' END AS state FROM orders")
def _(t):
    ok = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 2, False)
    before = F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("new")
    return t.orders.select("o_orderkey", R.qualification(before, ok).alias("state"))


@probe("cdc-09", f"SELECT event_id, CASE WHEN {_NEW} THEN 'current' ELSE 'carried' END AS refresh_state FROM events WHERE {_NEW} OR ({_OLD} AND ts >= {_TS} - INTERVAL 7 DAY)")
def _(t):
    old, new = snapshots(t)
    return R.carry_forward(new, old, ["event_id"], "ts", AS_OF, 7).select("event_id", "refresh_state")


@probe("cdc-11", f"""
WITH l AS (SELECT user_id AS lane, max(ts) AS due, user_id % 9 = 0 AS reserved, count(*) FILTER (WHERE event_type = 'error') % 5 AS attempts, min(ts) AS last_attempt FROM events GROUP BY user_id),
s AS (SELECT *, CASE WHEN reserved THEN 'reserved' WHEN attempts >= 3 THEN 'exhausted' WHEN due > {_TS} + INTERVAL 13 DAY THEN 'not_due' WHEN attempts > 0 AND last_attempt + CASE WHEN attempts <= 1 THEN INTERVAL 5 MINUTE ELSE INTERVAL 30 MINUTE END > {_TS} + INTERVAL 13 DAY THEN 'backoff' ELSE 'run' END AS state FROM l)
SELECT lane, CASE WHEN state = 'run' AND row_number() OVER (PARTITION BY state ORDER BY due, lane) > 3 THEN 'later' ELSE state END AS state FROM s""")
def _(t):
    lanes = t.events.groupBy(F.col("user_id").alias("lane")).agg(F.max("ts").alias("due"), (F.count_if(F.col("event_type") == "error") % 5).alias("attempts"), F.min("ts").alias("last_attempt"))
    return R.plan_lanes(lanes.withColumn("reserved", F.col("lane") % 9 == 0), "2024-01-29 12:00:00").select("lane", "state")


@probe("cdc-12", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate <= TIMESTAMP '1995-01-01 00:00:00'")
def _(t):
    lanes = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("due"))
    return R.overdue(lanes, "1995-01-01 00:00:00").select("o_orderkey")


@probe("cdc-13", "SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS known FROM events")
def _(t):
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("good"))
    return R.last_known_good(rows, "user_id", "event_id", "good").select("user_id", "event_id", "known")


@probe("cdc-14", """
WITH e AS (SELECT m AS model, day FROM range(0, 5) x(m), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts < '2024-01-20')), a AS (SELECT user_id % 6 AS model, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT coalesce(e.model, a.model) AS model, CAST(coalesce(e.day, a.day) AS VARCHAR) AS day, CASE WHEN n IS NULL THEN 'missing' WHEN e.model IS NULL THEN 'orphan' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM e FULL JOIN a ON a.model = e.model AND a.day = e.day""")
def _(t):
    days = t.events.where("ts < '2024-01-20'").select(F.to_date("ts").alias("day")).distinct()
    expected = days.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("model"), "day")
    actual = t.events.where("event_type = 'signup'").select((F.col("user_id") % 6).alias("model"), F.to_date("ts").alias("day"))
    return R.archive_audit(expected, actual, ["model", "day"]).withColumn("day", F.col("day").cast("string"))


@probe("cdc-15", """
WITH e AS (SELECT *, date_trunc('hour', ts) AS vs, CASE WHEN event_id % 3 = 0 THEN 12 ELSE 6 END AS lead FROM events),
s AS (SELECT *, vs + INTERVAL 1 HOUR AS ve, vs + INTERVAL 1 HOUR * (1 + event_id % 5) AS av, vs + INTERVAL 1 HOUR * (2 + event_id % 5) AS sc, count(*) OVER (PARTITION BY user_id, event_type, vs, lead) AS n FROM e)
SELECT i.event_id AS issue, count(*) AS n, min(s.event_id) AS first, max(s.event_id) AS last FROM e i JOIN s ON s.user_id = i.user_id AND s.event_type = i.event_type AND s.event_id % 2 = i.event_id % 2 AND s.lead = i.lead
WHERE s.n = 1 AND s.event_id % 11 <> 0 AND s.sc < i.ts AND s.ve < i.ts AND s.vs <> i.vs AND s.ve <> i.vs + INTERVAL 1 HOUR AND i.event_id % 4 = 0 GROUP BY i.event_id""")
def _(t):
    """Each fourth event as an issue that learns from all events as scores."""
    hours = lambda n: F.make_dt_interval(F.lit(0), n)
    lead, number = F.when(F.col("event_id") % 3 == 0, 12).otherwise(6), F.col("event_id")
    rows = t.events.withColumn("vs", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    shared = [F.col("user_id").alias("location"), F.col("event_type").alias("variable"), F.lit("1").alias("unit"), F.lit(None).cast("string").alias("event"), F.col("vs").alias("valid_start"), (F.col("vs") + hours(F.lit(1))).alias("valid_end")]
    scope = [F.lit("a").alias("algorithm"), F.lit("r").alias("registry"), F.lit("l").alias("locations"), (number % 2).alias("versions")]
    seen = F.col("vs") + hours((1 + number % 5).cast("int"))
    scores = rows.select(number.alias("score"), *shared, *scope, (F.col("vs") - hours(lead)).alias("issued_at"), (number % 11 != 0).alias("versions_known"), seen.alias("available_at"), seen.alias("retrieved_at"), (seen + hours(F.lit(1))).alias("scored_at"))
    issues = rows.where("event_id % 4 = 0").select(number.alias("issue"), *shared, *scope, F.col("ts").cast("timestamp_ntz").alias("issued_at"), lead.alias("lead_hours"))
    return evaluation.eligible(scores, issues, "issue").groupBy("issue").agg(F.count("*").alias("n"), F.min("score").alias("first"), F.max("score").alias("last"))


@probe("cdc-16", f"WITH f AS (SELECT event_type, count(*) AS n FROM events WHERE {_NEW} GROUP BY 1) SELECT event_id FROM events JOIN f USING (event_type) WHERE CASE WHEN n >= 1500 THEN {_NEW} ELSE {_OLD} END")
def _(t):
    old, new = snapshots(t)
    floors = t.events.select(F.col("event_type").alias("source")).distinct().withColumn("floor", F.lit(1500))
    return R.replace_source(old, new, "source", floors)[0].select("event_id")


@probe("cdc-17", "SELECT o_orderkey, 'row' AS reason FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'element' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_quantity > 45")
def _(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    rows = t.orders.select("o_orderkey", "o_orderstatus").join(items, "o_orderkey", "left")
    return R.sweep(rows, "o_orderkey", "lines", F.col("o_orderstatus") == "P", lambda x: x["l_quantity"] > 45)[1]


@probe("cdc-18", "SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w = o_orderkey - 1 AND lag(o_orderstatus) OVER w = 'F' AND lag(o_orderkey % 4) OVER w <> 3, false) AS resolved FROM orders WINDOW w AS (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey)")
def _(t):
    k = F.col("o_orderkey")
    runs = t.orders.select("o_orderkey", F.floor(k / 100).alias("lane"), (F.col("o_orderstatus") == "F").alias("ok"), k.cast("string").alias("digest"), F.when((k - 1) % 4 == 3, "other").otherwise((k - 1).cast("string")).alias("needs"))
    return R.lineage(runs, "o_orderkey", "ok", "digest", "needs").select("o_orderkey", "resolved")


@probe("cdc-19", """
WITH q AS (SELECT event_id, user_id % 10 AS host, ts AS started, CASE WHEN event_id % 37 <> 0 THEN ts + INTERVAL 1 MINUTE * (30 * (event_id % 60) + 1) END AS ended, CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 97 = 0 AND user_id % 10 < 8 THEN 429 ELSE 200 END AS code FROM events),
s AS (SELECT *, min(ended) FILTER (WHERE code = 429) OVER (PARTITION BY host) AS stop FROM q),
g AS (SELECT *, CASE WHEN stop IS NULL THEN CASE WHEN ended IS NULL THEN 'unsettled' ELSE 'settled' END WHEN started >= stop THEN 'refused' WHEN ended IS NULL THEN 'unsettled' WHEN ended < stop THEN 'settled' WHEN ended = stop AND code = 429 THEN 'denied' ELSE 'late' END AS state FROM s)
SELECT event_id, row_number() OVER (PARTITION BY host ORDER BY started, ended NULLS LAST, code) AS number, state,
  CASE WHEN stop IS NOT NULL THEN count(*) FILTER (WHERE started < stop AND (ended IS NULL OR ended >= stop)) OVER (PARTITION BY host) END AS in_flight,
  strftime(CASE WHEN stop IS NOT NULL AND count(*) FILTER (WHERE state = 'unsettled') OVER (PARTITION BY host) = 0 THEN max(ended) FILTER (WHERE state IN ('late', 'denied')) OVER (PARTITION BY host) END, '%Y-%m-%d %H:%M:%S') AS drained_at FROM g""")
def _(t):
    """Events as requests to ten hosts, two of which never deny; some are never answered."""
    number, host = F.col("event_id"), F.col("user_id") % 10
    ended = F.when(number % 37 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (30 * (number % 60) + 1).cast("int")))
    code = F.when(number % 37 == 0, None).when((number % 97 == 0) & (host < 8), 429).otherwise(200)
    rows = t.events.select("event_id", host.alias("host"), F.col("ts").alias("started"), ended.alias("ended"), code.alias("code"))
    out = R.access_sweep(rows, "host", "started", "ended", "code")
    return out.select("event_id", F.col("number").cast("long").alias("number"), "state", "in_flight", F.date_format("drained_at", "yyyy-MM-dd HH:mm:ss").alias("drained_at"))


# --- sorting and paging --------------------------------------------------------


@probe("srt-01", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 50")
def _(t):
    return t.part.orderBy(F.col("p_retailprice").desc(), "p_name", "p_partkey").limit(50).select("p_partkey")


@probe("srt-02", f"SELECT event_id FROM events ORDER BY greatest(ts, CASE WHEN ts + INTERVAL 5 DAY >= {_TS} THEN {_TS} ELSE ts END), event_id LIMIT 40")
def _(t):
    return t.events.orderBy(effective_start("ts", F.col("ts") + F.expr("interval 5 days"), AS_OF).asc_nulls_last(), "event_id").limit(40).select("event_id")


def effective_start(start, end, as_of):
    """An event that is on counts as starting now."""
    now = D.moment(as_of)
    return F.when(end >= now, F.greatest(F.col(start), now)).otherwise(F.col(start))


#: Rows on a page of each list.
PAGE = {"places": 12, "events": 24, "news": 12, "menus": 18, "catalogue": 30}


@probe("srt-03", "SELECT p_partkey FROM part WHERE p_size < 10 ORDER BY p_name, p_partkey LIMIT 12 OFFSET 24")
def _(t):
    return page(t.part.where("p_size < 10"), ["p_name", "p_partkey"], 3, PAGE["places"]).select("p_partkey")


def page(rows, order, number: int, size: int):
    """One page; a number below one means the first."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


@probe("srt-04", "SELECT 'featured' AS section, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL SELECT 'special', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 4)")
def _(t):
    featured = t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select(F.lit("featured").alias("section"), "o_orderkey")
    special = t.orders.where("o_orderstatus = 'P'").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(4).select(F.lit("special").alias("section"), "o_orderkey")
    return featured.union(special)


@probe("srt-05", "SELECT DISTINCT p_name FROM part")
def _(t):
    return t.part.select("p_name").distinct().orderBy(F.collate("p_name", "UNICODE")).select(F.col("p_name").cast("string").alias("p_name"))


@probe("srt-06", "SELECT user_id, arg_min(event_id, (CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id)) AS event_id FROM events GROUP BY user_id")
def _(t):
    rows = t.events.withColumn("official", F.col("event_type") == "purchase")
    return U.first_wins(rows, ["user_id"], [F.col("official").desc(), "event_id"]).select("user_id", "event_id")


@probe("srt-07", "SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("head"))


# --- sinks and release ----------------------------------------------------------


@probe("snk-01", "SELECT n_nationkey, n_name || ' \"x\";' AS n_name, n_regionkey, true AS equal FROM nation")
def _(t):
    rows = t.nation.select("n_nationkey", F.concat("n_name", F.lit(' "x";')).alias("n_name"), "n_regionkey")
    folder = files.shared_folder(t.spark)
    sinks.write_twins(rows, folder, "NATIONS")
    equal = sinks.twins_agree(t.spark, folder, rows.schema).select("equal")
    return sinks.read_script(t.spark, f"{folder}/script", rows.schema).crossJoin(F.broadcast(equal))  # one row beside each


@probe("snk-02", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_partkey END AS l_partkey, p.n AS n_lines
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS nth FROM lineitem) JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) p ON k = l_orderkey""")
def _(t):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    nested = t.lineitem.groupBy("l_orderkey").agg(lines.alias("lines"), F.count("*").alias("n_lines"))
    folder = files.shared_folder(t.spark)
    sinks.write_tables(nested, folder, "l_orderkey", ["lines"])
    child = release.table(t.spark, folder, "lines")
    sinks.upsert(t.spark, folder, "lines", child.where("l_orderkey % 3 = 0").withColumn("l_partkey", F.lit(-1).cast("long")), ["l_orderkey", "ordinal"])
    rows = release.table(t.spark, folder, "lines").join(release.table(t.spark, folder, "parent"), "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "n_lines")


@probe("snk-03", '''SELECT r_regionkey, CAST(r_regionkey AS VARCHAR) || ',"' || r_name || ', ""x"""' AS line FROM region''')
def _(t):
    return t.region.select("r_regionkey", F.concat_ws(",", F.col("r_regionkey").cast("string"), S.escape_csv(F.concat("r_name", F.lit(', "x"')))).alias("line"))


@probe("snk-04", """
WITH c AS (SELECT coalesce(lang, 'unknown | lang') AS lang, count(*) AS n FROM documents GROUP BY 1)
SELECT 0 AS part, '# Documents' AS line UNION ALL SELECT 1, '| Language | Documents |' UNION ALL SELECT 2, '| --- | --- |'
UNION ALL SELECT 3, '| ' || replace(lang, '|', chr(92) || '|') || ' | ' || n || ' |' FROM c""")
def _(t):
    from plaza.operators.metrics import count_by

    rows = count_by(t.documents.select(F.coalesce("lang", F.lit("unknown | lang")).alias("lang")), "lang")
    return sinks.report(rows.select("lang", "n"), "Documents", ["Language", "Documents"])


@probe("snk-05", r"SELECT event_id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || event_id || chr(13) || chr(10) || 'DTSTART:' || strftime(ts, '%Y%m%dT%H%M%SZ') || chr(13) || chr(10) || 'SUMMARY:' || event_type || '\, free' || chr(13) || chr(10) || 'END:VEVENT' AS ics FROM events")
def _(t):
    from plaza.sources.files import ics_event

    return t.events.select("event_id", ics_event(F.col("event_id").cast("string"), F.col("ts"), F.concat("event_type", F.lit(", free"))).alias("ics"))


@probe("snk-06", f"""
WITH e AS (SELECT event_id, event_type FROM events WHERE ts >= {_TS} AND ts <= {_TS} + INTERVAL 90 DAY AND event_type <> 'error' ORDER BY ts, event_id LIMIT 20)
SELECT event_id, '<!doctype html><html><head><title>' || event_type || ' &amp; more</title><link rel="canonical" href="https://a.example/e/' || event_id || '"></head><body><h1>' || event_type || ' &amp; more</h1><p>&lt;b&gt;</p></body></html>' AS html,
       (SELECT sum(length('<url><loc>https://a.example/e/' || event_id || '</loc></url>')) + length('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"></urlset>') FROM e) AS map_chars FROM e""")
def _(t):
    now = D.moment(AS_OF)
    eligible = t.events.where(F.col("ts").between(now, now + F.expr("interval 90 days")) & (F.col("event_type") != "error"))
    top = eligible.orderBy("ts", "event_id").limit(20).select("event_id", F.concat("event_type", F.lit(" & more")).alias("title"), F.concat(F.lit("https://a.example/e/"), "event_id").alias("url"))
    folder = files.shared_folder(t.spark)
    top.select("event_id", "url", sinks.page("title", F.lit("<b>"), "url").alias("html")).write.parquet(f"{folder}/pages")
    pages = t.spark.read.parquet(f"{folder}/pages")
    return pages.select("event_id", "html").crossJoin(F.broadcast(sinks.sitemap(pages).agg(F.sum(F.length("text")).alias("map_chars"))))  # one row beside each


_FILES = [("data/a.json", "a", "b", "promoted"), ("data/a.json", "a", "a", "unchanged"), ("data/sub/a.json", "a", "b", "refused"), ("data/../a.json", "a", "b", "refused"), ("/data/a.json", "a", "b", "refused"), ("data/new.js", None, "b", "promoted"), ("dataXa.json", "a", "b", "refused"), ("data/old.json", "a", None, "promoted")]


@probe("snk-07", "SELECT o_orderkey, CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{row[3]}'" for k, row in enumerate(_FILES)) + " END AS state FROM orders")
def _(t):
    pick = lambda at: F.element_at(F.array(*[F.lit(row[at]).cast("string") for row in _FILES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = t.orders.select("o_orderkey", pick(0).alias("path"), pick(1).alias("old_sha256"), pick(2).alias("new_sha256"))
    return sinks.promotable(rows, ["data/*.json", "data/*.js"]).select("o_orderkey", "state")


@probe("snk-08", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def _(t):
    rows = t.labels.select("doc_id", "quality", F.lit(0).alias("rank"))
    fresh = t.labels.where("doc_id % 4 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(1).alias("rank"))
    return U.last_wins(rows.union(fresh), ["doc_id"], ["rank"]).select("doc_id", "quality")


@probe("snk-09", "SELECT o_orderstatus || '-' || o_orderpriority AS name, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN left(o_orderpriority, 1) = '1' THEN 'sha_differs' WHEN left(o_orderpriority, 1) = '2' THEN 'count_differs' ELSE 'ok' END AS state FROM orders GROUP BY o_orderstatus, o_orderpriority")
def _(t):
    first = F.left("o_orderpriority", F.lit(1))
    name = F.concat_ws("-", "o_orderstatus", "o_orderpriority")
    own = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    expected = own.select(name.alias("name"), F.sha2(name, 256).alias("sha"), F.col("n").alias("records"))
    seen = own.where("o_orderstatus <> 'P'").select(name.alias("name"), F.when(first == "1", "0").otherwise(F.upper(F.sha2(name, 256))).alias("sha"), (F.col("n") + F.when(first == "2", 1).otherwise(0)).alias("records"))
    return sinks.deployed(expected, seen)


@probe("snk-10", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'unlisted' WHEN o_orderkey % 10 = 2 THEN 'changed' ELSE 'same' END AS state FROM orders")
def _(t):
    k = F.col("o_orderkey")
    listed = t.orders.where(k % 10 != 1).select("o_orderkey", F.sha2(k.cast("string"), 256).alias("a"))
    there = t.orders.where(k % 10 != 0).select("o_orderkey", F.sha2(F.when(k % 10 == 2, "x").otherwise(k.cast("string")), 256).alias("b"))
    rows = listed.join(there, "o_orderkey", "full")
    return rows.select("o_orderkey", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("state"))


@probe("snk-11", "SELECT doc_id, CASE WHEN quality = 0 THEN 'gap' ELSE 'candidate' END AS tbl, CASE WHEN quality = 0 AND toxic = 1 THEN 'quality,toxic' WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE '' END AS reasons FROM labels")
def _(t):
    from plaza.operators.metrics import problems

    reasons = problems([("quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)])
    return t.labels.select("doc_id", F.when(F.col("quality") == 0, "gap").otherwise("candidate").alias("tbl"), F.array_join(reasons, ",").alias("reasons"))


@probe("dt-11", """
SELECT o_custkey, coalesce(min(o_orderpriority) FILTER (WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) = DATE '1996-01-16'),
       arg_max(o_orderpriority, (CAST(o_orderdate AS DATE), o_orderpriority)) FILTER (WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) <= DATE '1996-01-16'), 'original') AS hours
FROM orders GROUP BY o_custkey""")
def _(t):
    day = F.to_date("o_orderdate").cast("string")
    some = lambda condition, name: F.array_sort(F.collect_list(F.when(condition, F.struct(day.alias(name), F.col("o_orderpriority").alias("hours")))))
    rows = t.orders.groupBy("o_custkey").agg(some(F.col("o_orderstatus") == "P", "date").alias("overrides"), some(F.col("o_orderstatus") != "P", "from").alias("revisions"))
    return rows.select("o_custkey", H.hours_on(F.lit("original"), "overrides", "revisions", F.lit("1996-01-16")).alias("hours"))


@probe("dt-09", """
WITH h AS (SELECT DISTINCT user_id, hour(ts) AS a FROM events), l AS (SELECT user_id, a - lag(a) OVER (PARTITION BY user_id ORDER BY a) AS gap FROM h)
SELECT user_id, coalesce(bool_or(gap < 2), false) AS ambiguous FROM l GROUP BY user_id""")
def _(t):
    two = lambda h: F.lpad(h.cast("string"), 2, "0")
    line = F.concat(F.lit("Mo-We "), two(F.hour("ts")), F.lit(":00-"), two((F.hour("ts") + 2) % 24), F.lit(":00"))
    rows = t.events.groupBy("user_id").agg(F.collect_set(line).alias("lines"))
    return rows.select("user_id", H.weekly_from_strings("lines").isNull().alias("ambiguous"))
