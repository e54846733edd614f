"""Aggregations and forecast maths over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaza.functions import dates as D
from plaza.functions import text as S
from plaza.operators import forecast as W
from plaza.operators import metrics as M
from plaza.probes.base import AS_OF, probe

_HOST = r"regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www|m)\.', '')"
_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0"


@probe("agg-01", "SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1")
def _(t):
    return M.count_values(t.orders, "o_orderpriority", "o_orderkey")


@probe("agg-02", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(t):
    return M.count_by(t.documents, "source").orderBy(F.col("n").desc(), "source")


@probe("agg-03", "SELECT event_type, count(*) AS n, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 99 END AS rank FROM events GROUP BY event_type")
def _(t):
    return M.facet_counts(t.events, "event_type", ["purchase", "signup"])


_LABELS = (("the ", "english"), ("der ", "german"), ("le ", "french"), ("de ", "spanish"))


@probe("agg-04", " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM documents WHERE contains(lower(text), '{w}')" for w, n in _LABELS))
def _(t):
    return M.count_by(t.documents.select(F.explode(S.labels("text", _LABELS)).alias("label")), "label")


@probe("agg-05", """
WITH f AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS urgent, o_orderstatus = 'F' AS done, false AS bulk FROM orders UNION ALL SELECT o_custkey, false, false, l_quantity > 45 FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey, bool_or(urgent) AS urgent, bool_or(done) AS done, bool_or(bulk) AS bulk FROM f GROUP BY 1), w AS (SELECT count(*) AS total, count(*) FILTER (WHERE urgent) AS urgent, count(*) FILTER (WHERE done) AS done, count(*) FILTER (WHERE bulk) AS bulk FROM g)
SELECT metric, n, total, round(100.0 * n / total, 1) AS pct FROM (SELECT 'urgent' AS metric, urgent AS n, total FROM w UNION ALL SELECT 'done', done, total FROM w UNION ALL SELECT 'bulk', bulk, total FROM w)""")
def _(t):
    no = F.lit(False)
    orders = t.orders.select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.col("o_orderstatus") == "F").alias("done"), no.alias("bulk"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", no.alias("urgent"), no.alias("done"), (F.col("l_quantity") > 45).alias("bulk"))
    return M.coverage(orders.unionByName(lines), "o_custkey", ["urgent", "done", "bulk"])


@probe("agg-06", "SELECT l_returnflag, round(100.0 * count(*) FILTER (WHERE l_discount > 0.05) / count(*), 1) AS pct FROM lineitem GROUP BY 1")
def _(t):
    from plaza.functions.numbers import percent

    rows = t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n"), F.count("*").alias("total"))
    return rows.select("l_returnflag", percent("n", "total").alias("pct"))


@probe("agg-07", f"SELECT variant, bucket, count(*) AS n FROM (SELECT v AS variant, CASE WHEN age < -v / 24 THEN 'unknown' WHEN age < 7 THEN 'under_7' WHEN age <= 30 THEN '7_30' WHEN age <= 90 THEN '30_90' ELSE 'over_90' END AS bucket FROM (SELECT {_AGE} AS age FROM events) CROSS JOIN (VALUES (0), (24)) x(v)) GROUP BY ALL")
def _(t):
    both = [t.events.select(F.lit(skew).alias("variant"), D.freshness_bucket("ts", AS_OF, skew).alias("bucket")) for skew in (0, 24)]
    return M.count_by(both[0].union(both[1]), "variant", "bucket")


@probe("agg-08", "SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents")
def _(t):
    return M.duplicate_count(t.documents, [F.md5("text")])


@probe("agg-09", "SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    return M.duplicate_values(t.documents, F.md5("text").alias("k"))


@probe("agg-10", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def _(t):
    status = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.max(F.struct("o_totalprice", "o_orderkey")).alias("top"))
    rows = status.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("by"), F.max("top")["o_orderkey"].alias("best"))
    return rows.select("o_custkey", "n", *[F.coalesce(F.col("by")[s], F.lit(0)).alias(s.lower()) for s in ("F", "O")], "best")


@probe("agg-11", "SELECT user_id, CAST(max(ts) AS VARCHAR)[1:19] AS newest, CAST(min(ts) AS VARCHAR)[1:19] AS oldest FROM events GROUP BY user_id")
def _(t):
    clock = F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.events.groupBy("user_id").agg(stamp(F.max(clock)).alias("newest"), stamp(F.min(clock)).alias("oldest"))


@probe("agg-12", f"""
WITH s AS (SELECT event_type AS lane, user_id % 7 AS source, count(*) AS n, count(*) FILTER (WHERE value > 150) AS f, max(ts) FILTER (WHERE ts <= TIMESTAMP '{AS_OF}') AS seen, count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}') AS u FROM events GROUP BY ALL),
r AS (SELECT event_type AS lane, count(DISTINCT user_id % 3) AS reasons FROM events WHERE value > 150 GROUP BY 1),
l AS (SELECT lane, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(f) AS BIGINT) AS failures, CAST(sum(u) AS BIGINT) AS unknown, min(seen) AS oldest FROM s GROUP BY lane)
SELECT l.lane, attempts, failures, unknown, CAST(coalesce(reasons, 0) AS INT) AS reasons, CASE WHEN date_diff('microsecond', oldest, TIMESTAMP '{AS_OF}') / 3600000000.0 <= 1 THEN 'fresh' WHEN date_diff('microsecond', oldest, TIMESTAMP '{AS_OF}') / 3600000000.0 <= 2 THEN 'warn' ELSE 'stale' END AS state FROM l LEFT JOIN r ON r.lane = l.lane""")
def _(t):
    rows = t.events.select(F.col("event_type").alias("lane"), (F.col("user_id") % 7).alias("source"), (F.col("value") > 150).alias("failed"), (F.col("user_id") % 3).cast("string").alias("reason"), F.when(F.col("ts") <= D.moment(AS_OF), F.col("ts")).alias("observed"))
    return M.lane_ledger(rows, AS_OF, 1).select("lane", "attempts", "failures", "unknown", "reasons", "state")


@probe("agg-13", f"SELECT event_id, CASE WHEN h < -1 THEN 'unknown' WHEN h <= 24 THEN 'fresh' WHEN h <= 48 THEN 'warn' ELSE 'stale' END AS state FROM (SELECT event_id, {_AGE} * 24 AS h FROM events)")
def _(t):
    return t.events.select("event_id", D.freshness_state("ts", AS_OF, 24).alias("state"))


@probe("agg-14", """
SELECT user_id, CASE WHEN a = 0 AND h > 0 THEN 'no_access' WHEN a = 0 THEN 'not_attempted' WHEN f > 0 AND f < a THEN 'partial_failure' WHEN f >= a THEN 'failure' WHEN r = 0 THEN 'success_empty' WHEN fresh THEN 'success_fresh' ELSE 'success_stale' END AS health
FROM (SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS a, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'view') AS r, count(*) FILTER (WHERE event_type = 'signup') AS h, max(ts) >= '2024-01-28' AS fresh FROM events GROUP BY user_id)""")
def _(t):
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    return t.events.groupBy("user_id").agg(M.run_health(n("click", "error"), n("error"), n("view"), n("signup"), F.max("ts") >= F.lit("2024-01-28").cast("timestamp_ntz")).alias("health"))


@probe("agg-15", f"SELECT left(sha256(host), 12) AS source_key, bool_or(page_id % 2 = 0) AS enabled, max(page_id) AS clock, array_to_string(list_sort(list(DISTINCT CAST(page_id % 3 AS VARCHAR))), ',') AS provenance, count(*) AS n FROM (SELECT page_id, {_HOST} AS host FROM pages) GROUP BY host")
def _(t):
    rows = t.pages.select(S.host_key("url").alias("host"), (F.col("page_id") % 2 == 0).alias("enabled"), F.col("page_id").alias("clock"), (F.col("page_id") % 3).cast("string").alias("provenance"))
    return M.catalogue(rows, ["host"], ["enabled"], "clock", "provenance").withColumn("provenance", F.array_join("provenance", ","))


@probe("agg-16", "SELECT count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) AS total FROM events")
def _(t):
    return M.state_counts(t.events, "event_type", ["view", "error"])


@probe("agg-17", f"WITH k AS (SELECT host, kind, min(page_id) AS o FROM (SELECT page_id, {_HOST} AS host, 'k' || (page_id % 3) AS kind FROM pages) GROUP BY ALL) SELECT host, string_agg(kind, ',' ORDER BY o) AS kinds, count(*) AS n_kinds FROM k GROUP BY host")
def _(t):
    rows = t.pages.select("page_id", S.host_key("url").alias("host"), F.concat(F.lit("k"), F.col("page_id") % 3).alias("kind"), F.col("page_id").alias("entity"))
    out = M.url_universe(rows, "host", "kind", "entity", "page_id")
    return out.select("host", F.array_join("kinds", ",").alias("kinds"), F.size("kinds").cast("long").alias("n_kinds"))


def forecasts(t):
    """Events as forecast rows: user to model and family, date to target."""
    return t.events.select((F.col("user_id") % 4).alias("model"), (F.col("user_id") % 2).alias("family"), F.to_date("ts").cast("string").alias("target"), "value", "event_id")


_CUBE = "SELECT user_id % 4 AS model, user_id % 2 AS family, CAST(CAST(ts AS DATE) AS VARCHAR) AS target, value, event_id FROM events"


@probe("agg-18", f"WITH m AS (SELECT target, family, model, avg(value) AS v FROM ({_CUBE}) GROUP BY ALL), f AS (SELECT target, family, avg(v) AS v, count(*) AS models FROM m GROUP BY ALL) SELECT target, round(avg(v), 6) AS mean, count(*) AS families, CAST(sum(models) AS BIGINT) AS models FROM f GROUP BY target HAVING count(*) >= 2")
def _(t):
    return W.family_mean(forecasts(t), ["target"]).select("target", F.round("mean", 6).alias("mean"), "families", "models")


@probe("agg-19", """
WITH s AS (SELECT l_returnflag, l_quantity, sum(l_tax + 1) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(w) OVER (PARTITION BY l_returnflag) AS cum FROM s)
SELECT l_returnflag, min(l_quantity) FILTER (WHERE cum >= 0.1 - 1e-12) AS p10, min(l_quantity) FILTER (WHERE cum >= 0.9 - 1e-12) AS p90 FROM c GROUP BY 1""")
def _(t):
    return W.weighted_quantiles(t.lineitem.withColumn("w", F.col("l_tax") + 1), ["l_returnflag"], "l_quantity", "w", {"p10": 0.1, "p90": 0.9})


@probe("agg-20", f"WITH p AS (SELECT target, model, avg(value) AS v, CASE WHEN target < '2024-01-20' THEN 0 ELSE model END AS sig FROM ({_CUBE}) WHERE model < 3 GROUP BY ALL) SELECT target, round(avg(v), 6) AS headline FROM p GROUP BY target HAVING count(*) = 3 AND count(DISTINCT sig) = 1")
def _(t):
    points = forecasts(t).where("model < 3").groupBy("target", "model").agg(F.avg("value").alias("value"))
    points = points.withColumn("sig", F.when(F.col("target") < "2024-01-20", F.lit(0)).otherwise(F.col("model")))
    return W.headline(points, ["target"], "sig").withColumn("headline", F.round("headline", 6))


@probe("agg-21", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(avg(b), 6) AS brier
FROM (SELECT l_returnflag, l_linestatus, l_quantity - 25 AS e, power(l_discount - CAST(l_quantity > 25 AS INT), 2) AS b FROM lineitem) GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", (F.col("l_quantity") - 25).alias("error"), F.pow(F.col("l_discount") - (F.col("l_quantity") > 25).cast("int"), 2).alias("brier"))
    out = W.scores(rows, [[], ["l_returnflag"], ["l_linestatus"]])
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "brier")])


@probe("agg-22", "WITH d AS (SELECT user_id % 4 AS model, CAST(ts AS DATE) AS day, avg((value - 100) / 50) AS e FROM events GROUP BY ALL), m AS (SELECT model, avg(e) AS mean, count(*) AS days FROM d GROUP BY 1 HAVING count(*) >= 20) SELECT model, days, round(greatest(-2.0, least(2.0, -mean * days / (days + 20))), 6) AS correction FROM m")
def _(t):
    rows = t.events.select((F.col("user_id") % 4).alias("model"), F.to_date("ts").alias("day"), ((F.col("value") - 100) / 50).alias("error"))
    return W.shrinkage(rows, ["model"], "day").select("model", "days", F.round("correction", 6).alias("correction"))


@probe("agg-23", """
WITH RECURSIVE d AS (SELECT user_id % 4 AS model, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, avg(value) - 100 AS x FROM events GROUP BY ALL),
b AS (SELECT model, day, [x, lead(x, 1) OVER w, lead(x, 2) OVER w] AS v, lead(day, 2) OVER w AS last FROM d WINDOW w AS (PARTITION BY model ORDER BY day)),
f AS (SELECT model, v, row_number() OVER (PARTITION BY model ORDER BY day) - 1 AS k FROM b WHERE last = day + 2),
n AS (SELECT model, count(*) AS days, CAST(ceil(count(*) / 3) AS INT) AS need FROM d GROUP BY model),
m AS (SELECT n.model, days, need, coalesce(any_value(c.blocks), 0) AS blocks FROM n LEFT JOIN (SELECT model, count(*) AS blocks FROM f GROUP BY model) c ON c.model = n.model GROUP BY ALL),
g(i, s) AS (SELECT 0, CAST(1729 AS HUGEINT) UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < 1000 * (SELECT max(need) FROM n)),
p AS (SELECT model, days, (i - 1) // need AS draw, (i - 1) % need AS nth, s * blocks // 4294967296 AS k FROM m JOIN g ON i BETWEEN 1 AND 1000 * need WHERE days >= 30 AND blocks >= 10),
y AS (SELECT p.model, draw, avg(v[j]) AS mean FROM p JOIN f ON f.model = p.model AND f.k = p.k CROSS JOIN (VALUES (1), (2), (3)) t(j) WHERE nth * 3 + j <= days GROUP BY ALL)
SELECT m.model, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, CAST(any_value(blocks) AS INT) AS blocks FROM m LEFT JOIN y ON y.model = m.model GROUP BY m.model""")
def _(t):
    days = t.events.groupBy((F.col("user_id") % 4).alias("model"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg((F.avg("value") - 100).alias("difference"))
    return W.bootstrap(days, "model").select("model", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "blocks")


@probe("agg-24", f"WITH m AS (SELECT target, family, model, avg(value) AS v FROM ({_CUBE}) GROUP BY ALL), f AS (SELECT target, family, avg(v) AS v FROM m GROUP BY ALL) SELECT target, round(min(v), 6) AS low, round(max(v), 6) AS high FROM f GROUP BY target HAVING count(*) >= 2")
def _(t):
    return W.family_mean(forecasts(t), ["target"]).select("target", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@probe("agg-25", "SELECT count(*) FILTER (WHERE quality = 1) AS approved, count(*) FILTER (WHERE toxic = 1) AS flagged, count(*) + 0 AS queue FROM labels")
def _(t):
    row = t.labels.agg(F.count_if(F.col("quality") == 1).alias("approved"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.count("*").alias("queue"))
    return row.select("approved", "flagged", F.coalesce("queue", F.lit(0)).alias("queue"))


@probe("agg-26", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures, (SELECT count(DISTINCT lang) FROM documents) AS regions")
def _(t):
    return M.summary_row([t.orders.agg(F.count("*").alias("orders")), t.events.where("event_type = 'error'").agg(F.count("*").alias("failures")), t.documents.agg(F.count_distinct("lang").alias("regions"))])


@probe("agg-27", "SELECT c_custkey, r - 1 AS rank, reason FROM (SELECT c_custkey, unnest(x) AS reason, unnest(range(1, len(x) + 1)) AS r FROM (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'no balance' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'no menu' END, CASE WHEN c_nationkey < 3 THEN 'no site' END], lambda v: v IS NOT NULL) AS x FROM customer))")
def _(t):
    return M.gap_reasons(t.customer, "c_custkey", [("no balance", F.col("c_acctbal") < 0), ("no menu", F.col("c_mktsegment") == "MACHINERY"), ("no site", F.col("c_nationkey") < 3)]).withColumn("rank", F.col("rank").cast("long"))


@probe("agg-28", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 100")
def _(t):
    rows = t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return rows.orderBy("c_custkey").limit(100)


@probe("agg-29", f"WITH h AS (SELECT page_id % 50 AS entity, {_HOST} AS host FROM pages), n AS (SELECT host, count(DISTINCT entity) > 1 AS shared FROM h GROUP BY host) SELECT entity FROM h JOIN n ON n.host = h.host GROUP BY entity HAVING bool_and(shared)")
def _(t):
    from plaza.operators.joins import shared_keys

    rows = t.pages.select((F.col("page_id") % 50).alias("entity"), S.host_key("url").alias("host"))
    return M.all_shared(shared_keys(rows, "host", "entity"), "entity", "shared")


@probe("agg-30", "WITH u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT count(*) AS n, (SELECT count(*) FROM customer) AS total, round(100.0 * count(*) / (SELECT count(*) FROM customer), 1) AS pct FROM u")
def _(t):
    from plaza.functions.numbers import percent

    base, facts = (t.orders.where(c).select("o_custkey") for c in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'"))
    row = M.summary_row([base.union(facts).distinct().agg(F.count("*").alias("n")), t.customer.agg(F.count("*").alias("total"))])
    return row.withColumn("pct", percent("n", "total"))


@probe("agg-31", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' END], lambda v: v IS NOT NULL)) AS reason FROM labels) GROUP BY reason")
def _(t):
    q, x = F.col("quality"), F.col("toxic")
    return M.count_by(t.labels.select(F.explode(M.problems([("low quality", q == 0), ("toxic", x == 1), ("approved", (q == 1) & (x == 0))])).alias("reason")), "reason")


@probe("agg-32", "SELECT count(*) FILTER (WHERE n > 0) AS with_lines, count(*) FILTER (WHERE c_name <> '') AS with_name FROM (SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def _(t):
    from plaza.operators.joins import nested

    rows = nested(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", ["o_orderkey"], "orders")
    return rows.agg(F.count_if(F.size("orders") > 0).alias("with_lines"), F.count_if(F.col("c_name") != "").alias("with_name"))
