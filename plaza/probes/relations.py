"""Joins, sets, windows and sorts over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plaza.functions import numbers as N
from plaza.functions import text as S
from plaza.operators import evaluation as E
from plaza.operators import facts
from plaza.operators import joins as J
from plaza.operators import resolve as R
from plaza.operators import review as V
from plaza.operators import sets as U
from plaza.operators import windows as W
from plaza.probes.base import probe

# --- joins -------------------------------------------------------------------


@probe("joi-01", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(t):
    return J.one(t.orders.select("o_orderkey", "o_custkey"), t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", ["c_name"])


@probe("joi-02", "SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = J.nested(t.orders.select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], "x")
    return rows.select("o_orderkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"])), ",").alias("lines"))


@probe("joi-03", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NULL THEN 'unknown order' END AS reason FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return J.with_reason(lines, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "unknown order")


@probe("joi-04", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def _(t):
    ids = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(ids, "l_partkey", "left_semi")


@probe("joi-05", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_nationkey * 1000 NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    variants = [key("c_custkey"), F.concat(F.lit("k"), (F.col("c_nationkey") * 1000).cast("string"))]
    return J.unknown(t.customer.select("c_custkey", "c_nationkey"), t.supplier, variants, [key("s_suppkey")], "c_custkey").select("c_custkey")


@probe("joi-06", "SELECT n_nationkey, CAST(n_nationkey % 5 AS VARCHAR) AS canonical_id FROM nation")
def _(t):
    places = t.region.select(F.col("r_regionkey").cast("string").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("r_regionkey") + k * 5).cast("string")).alias("aliases"))
    rows = J.by_alias(t.nation.select("n_nationkey", F.col("n_nationkey").cast("string").alias("ref")), places, "ref", "id", "aliases")
    return rows.select("n_nationkey", "canonical_id")


@probe("joi-07", "WITH o AS (SELECT user_id, min(event_id) AS id, count(DISTINCT event_id) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT DISTINCT e.user_id, CASE WHEN n = 1 THEN id ELSE e.user_id END AS resolved FROM events e LEFT JOIN o ON o.user_id = e.user_id")
def _(t):
    saved = t.events.select("user_id").distinct()
    return J.migrate(saved, t.events.where("event_type = 'signup'").select("user_id", "event_id"), "user_id", "event_id").select("user_id", "resolved")


def places(rows, key, nation):
    """Places with a name, phone, website, an address (civic number and street) and coordinates; a few rows share each."""
    k, n = F.col(key), F.col(nation)
    part = lambda m: F.floor(k / m).cast("string")
    return rows.select(
        k.alias("id"), n.alias("nation"), F.concat(F.lit("place "), part(4), F.when(k % 3 == 0, " cafe").otherwise("")).alias("name"), (k % 9).alias("civic"), F.concat(F.lit("street "), part(20)).alias("street"),
        F.when(k % 2 == 0, F.concat(F.lit("902"), part(3))).alias("phone"), F.when(k % 5 < 3, F.concat(F.lit("d"), part(6), F.lit(".example"))).alias("domain"), F.when(k % 11 == 0, F.floor(k / 2)).alias("ref"),
        (F.lit(44.0) + (k % 13) / 10000.0).alias("lat"), (F.lit(-63.0) + (k % 11) / 10000.0).alias("lon"),
    )


def _places_sql(table, key, nation):
    return f"""SELECT {key} AS id, {nation} AS nation, 'place ' || ({key} // 4) || CASE WHEN {key} % 3 = 0 THEN ' cafe' ELSE '' END AS name, {key} % 9 AS civic, 'street ' || ({key} // 20) AS street,
  CASE WHEN {key} % 2 = 0 THEN '902' || ({key} // 3) END AS phone, CASE WHEN {key} % 5 < 3 THEN 'd' || ({key} // 6) || '.example' END AS domain, CASE WHEN {key} % 11 = 0 THEN {key} // 2 END AS ref,
  44.0 + ({key} % 13) / 10000.0 AS lat, -63.0 + ({key} % 11) / 10000.0 AS lon FROM {table}"""


_METRES = "12742000 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"
_PAIRS = f"""a AS ({_places_sql('customer', 'c_custkey', 'c_nationkey')}), b AS ({_places_sql('supplier', 's_suppkey', 's_nationkey')}),
q AS (SELECT a.id, b.id AS r_id, a.name = b.name AS named, a.name <> b.name AND (contains(a.name, b.name) OR contains(b.name, a.name)) AS within, coalesce(a.phone = b.phone, false) AS phone, coalesce(a.domain = b.domain, false) AS domain, coalesce(a.ref = b.id, false) AS explicit,
  a.civic = b.civic AS civic, a.street = b.street AS street, a.nation = b.nation AS postal, {_METRES} AS m
  FROM a JOIN b ON a.name = b.name OR a.phone = b.phone OR a.domain = b.domain OR (a.civic = b.civic AND a.street = b.street) OR a.ref = b.id)"""


def candidate_pairs(t):
    """Pairs of customers and suppliers that share any evidence, with what they share."""
    a = places(t.customer, "c_custkey", "c_nationkey")
    b = places(t.supplier, "s_suppkey", "s_nationkey")
    blocks = [(F.col(c), F.col(f"r_{c}")) for c in ("name", "phone", "domain")] + [(F.struct("civic", "street"), F.struct(F.col("r_civic").alias("civic"), F.col("r_street").alias("street"))), (F.col("ref"), F.col("r_id"))]
    same = lambda c, d=None: F.coalesce(F.col(c) == F.col(d or f"r_{c}"), F.lit(False))
    rows = J.blocked_pairs(a, b, blocks)
    return rows.select(
        "id", "r_id", same("name").alias("named"), ((F.col("name") != F.col("r_name")) & (F.contains("name", "r_name") | F.contains("r_name", "name"))).alias("within"), same("phone").alias("phone"), same("domain").alias("domain"),
        same("ref", "r_id").alias("explicit"), same("civic").alias("civic"), same("street").alias("street"), same("nation").alias("postal"), N.metres("lat", "lon", "r_lat", "r_lon").alias("m"),
    )


@probe("joi-08", f"""
WITH {_PAIRS}, p AS (SELECT *, civic AND street AS same FROM q),
s AS (SELECT id, r_id, CASE WHEN NOT explicit AND NOT named THEN 'distinct' WHEN NOT same THEN CASE WHEN explicit THEN 'review' ELSE 'distinct' END WHEN m > 250 THEN 'review' WHEN explicit OR m <= 75 THEN 'match' ELSE 'review' END AS state FROM p),
g AS (SELECT id, count(*) FILTER (WHERE state = 'match') AS m, count(*) FILTER (WHERE state = 'review') AS r, min(r_id) FILTER (WHERE state = 'match') AS hit FROM s GROUP BY id)
SELECT id, CASE WHEN m = 1 THEN 'match' WHEN m > 1 OR r > 0 THEN 'review' ELSE 'distinct' END AS decision, CASE WHEN m = 1 THEN hit END AS matched_id FROM g""")
def _(t):
    pairs = candidate_pairs(t).withColumn("state", J.decide(F.col("explicit"), F.col("named"), J.place_of(F.col("civic") & F.col("street"), F.col("m"))))
    return J.resolve_identity(pairs, "id", "r_id", "state")


@probe("joi-09", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, count(*) AS layers FROM orders GROUP BY o_custkey")
def _(t):
    rows = J.merge_provenance(t.orders, "o_custkey", "o_orderkey", ["o_orderpriority"], ["o_orderstatus"])
    return rows.select("o_custkey", "o_orderpriority", F.array_join("o_orderstatus", ",").alias("statuses"), "layers")


@probe("joi-10", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'reviewed' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer")
def _(t):
    reviewed = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("reviewed").alias("c_mktsegment"), F.lit("ignored").alias("c_name"))
    return J.overlay(t.customer.select("c_custkey", "c_mktsegment", "c_name"), reviewed, "c_custkey", ["c_mktsegment"], ["c_name"])


@probe("joi-11", f"WITH {_PAIRS} SELECT id, r_id FROM (SELECT id, r_id, row_number() OVER (PARTITION BY id ORDER BY r_id) AS n FROM q WHERE civic AND street AND (named OR within)) WHERE n <= 3")
def _(t):
    near = candidate_pairs(t).where("civic and street and (named or within)")
    return J.top_per(near, ["id"], ["r_id"], 3).select("id", "r_id")


_SCORED = """v AS (SELECT id, r_id, named, within, CAST(CASE WHEN named THEN 35 WHEN within THEN 15 ELSE 0 END + CASE WHEN phone THEN 45 ELSE 0 END + CASE WHEN domain THEN 50 ELSE 0 END + CASE WHEN postal THEN 30 ELSE 0 END + CASE WHEN civic AND street THEN 35 ELSE 0 END
    + CASE WHEN m <= 60 THEN 40 WHEN m <= 200 THEN 25 WHEN m <= 500 THEN 10 ELSE 0 END - CASE WHEN NOT civic AND NOT street THEN 20 ELSE 0 END AS INT) AS score,
  CAST(phone AS INT) + CAST(domain AS INT) + CAST(postal AS INT) + CAST(civic AND street AS INT) + CAST(m <= 500 AS INT) AS strong, CAST(NOT civic AND NOT street AS INT) AS conflicts FROM q)"""


def scored_pairs(t):
    rows = candidate_pairs(t)
    similarity = F.when(F.col("street"), 0.6).otherwise(0.3)
    address, conflicts = F.col("civic") & F.col("street"), (~F.col("civic") & ~F.col("street")).cast("int")
    strong = sum((c.cast("int") for c in (F.col("phone"), F.col("domain"), F.col("postal"), address, F.col("m") <= 500)), F.lit(0))
    score = J.pair_score(F.col("named"), F.col("within"), F.col("phone"), F.col("domain"), F.col("postal"), address, similarity, F.col("m"), conflicts)
    return rows.select("id", "r_id", score.alias("score"), F.col("named").alias("exact_name"), F.col("within").alias("near_name"), strong.alias("strong"), conflicts.alias("conflicts"), (strong + (F.col("named") | F.col("within")).cast("int")).alias("evidence"))


@probe("joi-12", f"WITH {_PAIRS}, {_SCORED} SELECT id, r_id, score, strong, conflicts FROM v")
def _(t):
    return scored_pairs(t).select("id", "r_id", "score", "strong", "conflicts")


@probe("joi-13", f"""
WITH {_PAIRS}, {_SCORED}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, r_id) AS n, lead(score) OVER (PARTITION BY id ORDER BY score DESC, r_id) AS second FROM v),
best AS (SELECT *, score - coalesce(second, 0) AS margin, strong + CAST(named OR within AS INT) AS evidence FROM w WHERE n = 1)
SELECT id, r_id, score, margin, CASE WHEN conflicts > 0 THEN CASE WHEN score >= 80 AND margin >= 20 THEN 'review_conflict' ELSE 'unresolved_conflict' END
  WHEN NOT named AND NOT within AND strong > 0 THEN 'non_name_evidence_review' WHEN score >= 75 AND strong >= 1 AND margin >= 20 THEN 'resolved_high' WHEN score >= 60 AND evidence >= 2 AND margin >= 15 THEN 'resolved_probable' WHEN score >= 35 AND named THEN 'name_only_review' ELSE 'unresolved' END AS state FROM best""")
def _(t):
    return J.classify_best(scored_pairs(t), "id", "r_id")


_NAME = "replace(lower(p_name), ' ', '') || p_size"
_NEAR = "least(length(l.name), length({0}.name)) >= 5 AND (contains(l.name, {0}.name) OR contains({0}.name, l.name))"


@probe("joi-14", f"""
WITH p AS (SELECT p_partkey AS place, {_NAME} AS name, p_size || ' ' || p_type AS street, ['h' || p_partkey % 90, lower(p_brand)] AS hosts FROM part),
l AS (SELECT p_partkey AS lead, CASE p_partkey % 5 WHEN 0 THEN {_NAME} WHEN 1 THEN substr({_NAME}, 3) WHEN 2 THEN {_NAME} || 'x' WHEN 3 THEN 'zz' || p_partkey ELSE substr({_NAME}, 2, 6) END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN p_size || ' ' || p_type ELSE 'none' END AS street, CASE WHEN p_partkey % 2 = 0 THEN 'h' || p_partkey % 130 ELSE lower(p_brand) END AS host FROM part),
r AS (SELECT place, name, unnest(hosts) AS host FROM p),
e AS (SELECT lead, list_sort(list(DISTINCT place)) AS ids FROM l JOIN p ON p.name = l.name GROUP BY lead),
s AS (SELECT lead, list_sort(list(DISTINCT place)) AS ids FROM l JOIN p ON p.street = l.street GROUP BY lead),
h AS (SELECT lead, count(*) AS n, min(place) AS id FROM l JOIN r ON r.host = l.host GROUP BY lead),
t AS (SELECT lead, list(DISTINCT place) AS ids FROM l JOIN r ON r.host = l.host WHERE {_NEAR.format("r")} GROUP BY lead),
f AS (SELECT lead, list_sort(list(DISTINCT place)) AS ids FROM l JOIN p ON {_NEAR.format("p")} AND 100 * least(length(l.name), length(p.name)) >= 65 * greatest(length(l.name), length(p.name)) GROUP BY lead),
m AS (SELECT l.lead, CASE WHEN len(e.ids) = 1 THEN 'exact_name' WHEN len(s.ids) = 1 THEN 'street_address' WHEN h.n = 1 THEN 'unique_website_host' WHEN len(t.ids) = 1 THEN 'website_host_name' WHEN len(f.ids) = 1 THEN 'fuzzy_name'
    WHEN len(f.ids) > 1 OR len(e.ids) > 1 OR len(s.ids) > 1 THEN 'conflict' ELSE 'unresolved' END AS method, e.ids AS e, s.ids AS s, h.id AS h, t.ids AS t, f.ids AS f
  FROM l LEFT JOIN e ON e.lead = l.lead LEFT JOIN s ON s.lead = l.lead LEFT JOIN h ON h.lead = l.lead LEFT JOIN t ON t.lead = l.lead LEFT JOIN f ON f.lead = l.lead)
SELECT lead, method, CASE method WHEN 'exact_name' THEN e[1] WHEN 'street_address' THEN s[1] WHEN 'unique_website_host' THEN h WHEN 'website_host_name' THEN t[1] WHEN 'fuzzy_name' THEN f[1] END AS place,
  CASE WHEN method IN ('exact_name', 'street_address', 'unique_website_host') THEN 'high' WHEN method IN ('website_host_name', 'fuzzy_name') THEN 'probable' ELSE 'needs_review' END AS confidence,
  CASE WHEN method IN ('conflict', 'unresolved') THEN least(12, len(list_distinct(coalesce(e[:12], []) || coalesce(s[:12], []) || coalesce(f[:12], [])))) END AS near_places FROM m""")
def _(t):
    name = F.expr(_NAME)
    street = F.concat("p_size", F.lit(" "), "p_type")
    places = t.part.select(F.col("p_partkey").alias("place"), name.alias("name"), street.alias("street"), F.array(F.concat(F.lit("h"), F.col("p_partkey") % 90), F.lower("p_brand")).alias("hosts"))
    turn = F.col("p_partkey") % 5
    changed = F.when(turn == 0, name).when(turn == 1, F.substr(name, F.lit(3))).when(turn == 2, F.concat(name, F.lit("x"))).when(turn == 3, F.concat(F.lit("zz"), "p_partkey")).otherwise(F.substr(name, F.lit(2), F.lit(6)))
    host = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("h"), F.col("p_partkey") % 130)).otherwise(F.lower("p_brand"))
    leads = t.part.select(F.col("p_partkey").alias("lead"), changed.alias("name"), F.when(F.col("p_partkey") % 3 == 0, street).otherwise("none").alias("street"), host.alias("host"))
    found = R.resolve_leads(leads, places)
    # the lists of places are compared by their size
    return found.select("lead", "method", "place", "confidence", F.when(F.col("place").isNull(), F.size("candidates").cast("long")).alias("near_places"))


_TOKENS = [["click", "err"], ["view", "err"], ["purch", '"k": 2'], ['"k": 3'], ["signup", '"k": 2', '"k": 31']]


@probe("joi-15", f"""
WITH e AS (SELECT event_id AS event, 's' || (user_id % 60) AS source, 'hall' || (event_id % 70) AS venue_name, lower(event_type || ' ' || props) AS title FROM events),
vs AS (SELECT 's' || n_nationkey AS source, max(n_nationkey) AS v FROM nation GROUP BY 1), vn AS (SELECT name, max(v) AS v FROM (SELECT n_nationkey AS v, unnest(['hall' || n_nationkey, 'hall' || (n_nationkey % 20 + 30)]) AS name FROM nation) GROUP BY name),
os AS (SELECT 's' || (r_regionkey + 20) AS source, r_regionkey AS o FROM region), tok AS (SELECT r_regionkey AS o, unnest({_TOKENS}[r_regionkey + 1]) AS token FROM region),
one AS (SELECT title, min(o) AS o FROM (SELECT DISTINCT title FROM e) JOIN tok ON contains(title, token) GROUP BY title HAVING count(DISTINCT o) = 1)
SELECT event, coalesce(vs.v, vn.v) AS venue, CASE WHEN vs.v IS NOT NULL THEN 'source_id' WHEN vn.v IS NOT NULL THEN 'exact_normalized_venue_name' END AS venue_basis,
  coalesce(os.o, one.o) AS organizer, CASE WHEN os.o IS NOT NULL THEN 'source_id' WHEN one.o IS NOT NULL THEN 'source_name_token' END AS organizer_basis
FROM e LEFT JOIN vs ON vs.source = e.source LEFT JOIN vn ON vn.name = e.venue_name LEFT JOIN os ON os.source = e.source LEFT JOIN one ON one.title = e.title""")
def _(t):
    prefixed = lambda word, value: F.concat(F.lit(word), value)
    events = t.events.select(F.col("event_id").alias("event"), prefixed("s", F.col("user_id") % 60).alias("source"), prefixed("hall", F.col("event_id") % 70).alias("venue_name"), F.concat_ws(" ", "event_type", "props").alias("title"))
    key = F.col("n_nationkey")
    venues = t.nation.select(key.alias("venue"), F.array(prefixed("s", key)).alias("sources"), F.array(prefixed("hall", key), prefixed("hall", key % 20 + 30)).alias("names"))
    said = F.array(*[F.array(*map(F.lit, some)) for some in _TOKENS])
    organizers = t.region.select(F.col("r_regionkey").alias("organizer"), F.array(prefixed("s", F.col("r_regionkey") + 20)).alias("sources"), F.get(said, F.col("r_regionkey").cast("int")).alias("tokens"))
    return R.resolve_events(events, venues, organizers)


@probe("joi-16", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND (o_orderkey % 20 = 0 OR o_orderstatus = 'F') THEN NULL ELSE o_orderpriority END AS place, o_orderkey % 10 = 0 AND (o_orderkey % 20 = 0 OR o_orderstatus = 'F') AS corrected FROM orders")
def _(t):
    keys = ["o_orderkey", "o_orderdate", "o_custkey"]
    sources = F.when(F.col("o_orderkey") % 20 != 0, F.array(F.lit("F")))
    fixes = t.orders.where("o_orderkey % 10 = 0").select(*keys, F.lit(None).cast("string").alias("place"), sources.alias("sources"))
    rows = t.orders.withColumnsRenamed({"o_orderpriority": "place", "o_orderstatus": "source"})
    return V.correct_occurrences(rows, fixes, keys, "place").select("o_orderkey", "place", "corrected")


@probe("joi-17", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'undecided' END AS decision,
       event_id % 4 < 2 AND CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 5 DAY ELSE ts + INTERVAL 60 DAY END > TIMESTAMP '2024-01-16 12:00:00' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-16 12:00:00' AS current FROM events""")
def _(t):
    posts = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "event_id").alias("url"), F.col("ts").alias("published"))
    none = F.lit(None).cast("timestamp_ntz")
    by_id = posts.where("id % 4 = 0").select("id", F.lit(None).cast("string").alias("url"), F.lit("approved").alias("decision"), (F.col("published") + F.expr("interval 5 days")).alias("expires_at"), none.alias("review_due_at"))
    by_url = posts.where("id % 4 in (0, 1, 2)").select(F.lit(None).cast("long").alias("id"), "url", F.when(F.col("id") % 4 == 1, "approved").otherwise("rejected").alias("decision"), none.alias("expires_at"), none.alias("review_due_at"))
    out = V.decide_posts(posts, by_id.union(by_url), F.lit("2024-01-16 12:00:00").cast("timestamp_ntz"), review_days=10)
    return out.select(F.col("id").alias("event_id"), "decision", "current")


@probe("joi-18", f"WITH a AS ({_places_sql('supplier', 's_suppkey', 's_nationkey')}), b AS (SELECT * FROM a) SELECT a.id AS first_id, b.id AS second_id FROM a JOIN b ON a.name = b.name AND a.id < b.id WHERE {_METRES} <= 350")
def _(t):
    rows = places(t.supplier, "s_suppkey", "s_nationkey")
    apart = lambda a, b: N.metres(f"{a}lat", f"{a}lon", f"{b}lat", f"{b}lon")
    return J.near_pairs(rows, "id", "name", apart, 350).select(F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"))


_BUCKET = "CAST(ts AS DATE) + INTERVAL 1 HOUR * (hour(ts) // 4 * 4)"


@probe("joi-19", f"""
WITH e AS (SELECT *, {_BUCKET} AS vs FROM events),
t AS (SELECT user_id, vs, count(*) AS n, any_value(CASE WHEN event_id % 10 <> 0 THEN value END) AS v, any_value(event_id) AS id FROM e WHERE event_type = 'click' GROUP BY 1, 2),
s AS (SELECT event_type AS side, e.user_id, e.vs, e.vs - INTERVAL 2 HOUR AS issued, value - v AS error FROM e JOIN t ON t.user_id = e.user_id AND t.vs = e.vs WHERE event_type IN ('view', 'purchase') AND e.event_id % 13 <> 0 AND n = 1 AND v IS NOT NULL AND id % 7 <> 0),
k AS (SELECT side, user_id, vs, issued, count(*) AS n, any_value(error) AS error FROM s GROUP BY ALL),
p AS (SELECT coalesce(a.user_id, b.user_id) AS location, a.error AS x, b.error AS y, CASE WHEN greatest(coalesce(a.n, 0), coalesce(b.n, 0)) > 1 THEN 'duplicate' WHEN b.n IS NULL THEN 'unpaired_challenger' WHEN a.n IS NULL THEN 'unpaired_baseline' ELSE 'paired' END AS state
  FROM (SELECT * FROM k WHERE side = 'view') a FULL JOIN (SELECT * FROM k WHERE side = 'purchase') b ON a.user_id = b.user_id AND a.vs = b.vs AND a.issued = b.issued)
SELECT location, state, count(*) AS n, round(sum(CASE WHEN state = 'paired' THEN abs(x) - abs(y) END), 6) AS delta FROM p GROUP BY location, state""")
def _(t):
    """Views and purchases as two forecasts of the clicks in four hours of a user; some are issued late, some truths are missing, revised or retrieved too late."""
    start = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.floor(F.hour("ts") / 4).cast("int") * 4)
    hours = lambda n: F.make_dt_interval(F.lit(0), n)
    none = lambda name: F.lit(None).cast("string").alias(name)
    target = [F.col("user_id").alias("location"), F.lit("clicks").alias("variable"), F.lit("1").alias("unit"), none("event"), F.col("vs").alias("valid_start"), (F.col("vs") + hours(F.lit(4))).alias("valid_end")]
    rows = t.events.withColumn("vs", start)
    late = F.when(F.col("event_id") % 13 == 0, 7).otherwise(0)
    made = rows.select(*target, (F.col("vs") - hours(F.lit(2)) + hours(late)).alias("issued_at"), F.col("value").alias("prediction"), F.col("event_type").alias("side"))
    seen = F.col("vs") + hours(F.lit(5))
    clicks = rows.where("event_type = 'click'").select(*target, F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"), seen.alias("available_at"), (seen + hours(F.when(F.col("event_id") % 7 == 0, 24 * 4000).otherwise(1))).alias("retrieved_at"), F.col("event_id").alias("receipt"))
    scored = E.score(made, clicks, F.lit("2030-01-01").cast("timestamp_ntz")).where("state = 'scored'")
    pairs = E.pair(scored.where("side = 'view'"), scored.where("side = 'purchase'"))
    gain = F.abs("challenger_error") - F.abs("baseline_error")
    return pairs.groupBy("location", "state").agg(F.count("*").alias("n"), F.round(F.sum(gain), 6).alias("delta"))


@probe("joi-20", """
WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 1)) AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) ELSE 0 END, 6) AS similarity FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def _(t):
    words = lambda name: F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 1)).alias(name)
    a, b = t.documents.select("doc_id", words("a")), t.documents.select((F.col("doc_id") - 1).alias("doc_id"), words("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(J.token_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www|m)\.', '')"


@probe("joi-21", f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), n AS (SELECT host, count(DISTINCT page_id) AS n FROM h GROUP BY host) SELECT page_id, h.host, n AS n_entities, n > 1 AS shared FROM h JOIN n ON n.host = h.host")
def _(t):
    return J.shared_keys(t.pages.select("page_id", S.host_key("url").alias("host")), "host", "page_id")


@probe("joi-22", "SELECT c_custkey, min(o_orderkey) AS first_lead, coalesce(arg_min(o_orderpriority, o_orderkey), 'none') AS priority FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    leads = J.top_per(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority"), ["c_custkey"], ["o_orderkey"], 1)
    return t.customer.select("c_custkey").join(leads, "c_custkey", "left").select("c_custkey", F.col("o_orderkey").alias("first_lead"), F.coalesce("o_orderpriority", F.lit("none")).alias("priority"))


@probe("joi-23", "SELECT CAST(day AS VARCHAR) AS day FROM (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id % 2) AS n FROM events WHERE event_type = 'view' GROUP BY 1) WHERE n = 2 AND day >= DATE '2024-01-16' ORDER BY day LIMIT 5")
def _(t):
    days = t.events.where("event_type = 'view'").select(F.to_date("ts").alias("day"), (F.col("user_id") % 2).alias("p"))
    side = lambda p: days.where(F.col("p") == p).select("day").distinct()
    return side(0).join(side(1), "day").where("day >= date'2024-01-16'").orderBy("day").limit(5).select(F.col("day").cast("string").alias("day"))


@probe("joi-24", """
WITH m AS (SELECT unnest(range(0, 4)) AS model), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id % 4 AS model, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT m.model, CAST(d.day AS VARCHAR) AS day, CASE WHEN n IS NULL THEN 'missing' ELSE 'captured' END AS outcome, coalesce(n, 0) AS n_rows FROM m CROSS JOIN d LEFT JOIN r ON r.model = m.model AND r.day = d.day""")
def _(t):
    models = t.spark.range(4).withColumnRenamed("id", "model")
    days = t.events.select(F.to_date("ts").alias("day")).distinct()
    # every model for every target: the models are a registry of fixed size
    matrix = days.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(F.broadcast(models), "model", "left_semi")
    got = t.events.where("event_type = 'error'").groupBy((F.col("user_id") % 4).alias("model"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    rows = matrix.join(got, ["model", "day"], "left")
    return rows.select(F.col("model").cast("long").alias("model"), F.col("day").cast("string").alias("day"), F.when(F.col("n").isNull(), "missing").otherwise("captured").alias("outcome"), F.coalesce("n", F.lit(0)).alias("n_rows"))


@probe("joi-25", "SELECT n_nationkey, n_name, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def _(t):
    active = t.region.where("r_name <> 'ASIA'").select(F.col("r_regionkey").cast("string").alias("id"), F.array(F.concat(F.lit("alias-"), "r_regionkey")).alias("aliases"), "r_name")
    ref = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).otherwise(F.concat(F.lit("alias-"), "n_regionkey"))
    rows = J.by_alias(t.nation.select("n_nationkey", "n_name", ref.alias("ref")), active, "ref", "id", "aliases")
    return rows.join(active.select(F.col("id").alias("canonical_id"), "r_name"), "canonical_id", "left").select("n_nationkey", "n_name", F.col("r_name").alias("region"))


# --- sets --------------------------------------------------------------------


@probe("set-01", "SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS BIGINT) AS part FROM orders UNION ALL SELECT 'line', l_orderkey, l_extendedprice, l_partkey FROM lineitem")
def _(t):
    orders = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    lines = t.lineitem.select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_partkey").alias("part"))
    return U.union_all(orders, lines)


@probe("set-02", "SELECT min(doc_id) AS doc_id, md5(text) AS k FROM documents GROUP BY text")
def _(t):
    return U.first_wins(t.documents.select("doc_id", F.md5("text").alias("k")), ["k"], ["doc_id"])


@probe("set-03", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(t):
    return U.last_wins(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@probe("set-04", "SELECT md5(text) AS k, arg_max(lang, (n_chars, -doc_id)) AS lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY text")
def _(t):
    rows = t.documents.select(F.md5("text").alias("k"), "lang", F.array("source").alias("sources"), "n_chars", "doc_id")
    return U.priority_merge(rows, "k", "n_chars", "doc_id", ["lang"], ["sources"]).withColumn("sources", F.array_join("sources", ","))


_OCCURRENCES = [  # source kind, url, title, venue id, venue name, and the key without its instant
    ("public_library_calendar", "https://lib.example/v2/events/0af9?x=1", "Story time", None, "Main", "library|lib.example/events/0af9"),
    ("official_library_location_calendar", "https://LIB.example/events/0af9/", "Other title", None, None, "library|lib.example/events/0af9"),
    ("other", "https://lib.example/events/0af9", "Story time", None, "Main", None),
    ("other", None, "The Foxes vs. Grey Owls", None, "Big Arena", "foxes|owls|arena-1"),
    ("other", None, "FOXES v Owls", "arena-1", None, "foxes|owls|arena-1"),
    ("other", None, "Foxes vs Unknown", "arena-1", None, None),
    ("other", None, "Foxes vs Owls", None, "Café Zoë", "foxes|owls|cafe zoe"),
    ("other", None, "Foxes vs Owls", None, " ", None),
]


@probe("set-05", "SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{row[5]}|' || epoch_us(ts) // 1000" for k, row in enumerate(_OCCURRENCES) if row[5]) + " END AS k FROM events")
def _(t):
    pick = lambda at: F.element_at(F.array(*[F.lit(row[at]).cast("string") for row in _OCCURRENCES]), (F.col("event_id") % 8 + 1).cast("int"))
    rows = t.events.select("event_id", "ts", *[pick(at).alias(f"c{at}") for at in range(5)])
    teams, venues = {"the foxes": "foxes", "foxes": "foxes", "owls": "owls", "grey owls": "owls"}, {"big arena": "arena-1"}
    return rows.select("event_id", facts.event_key("c0", "c1", F.col("ts"), "c2", "c3", "c4", teams, venues, ["lib.example"]).alias("k"))


@probe("set-06", "WITH p AS (SELECT user_id, min(event_id) AS old, count(DISTINCT event_id) AS n FROM events WHERE event_type = 'purchase' AND ts < '2024-01-16' GROUP BY user_id) SELECT e.user_id, CASE WHEN n = 1 THEN old ELSE event_id END AS event_id, coalesce(n > 1, false) AS ambiguous FROM events e LEFT JOIN p ON p.user_id = e.user_id WHERE event_type = 'signup' AND ts >= '2024-01-16'")
def _(t):
    current = t.events.where("event_type = 'signup' and ts >= '2024-01-16'").select("user_id", "event_id")
    return U.keep_published_ids(current, t.events.where("event_type = 'purchase' and ts < '2024-01-16'").select("user_id", "event_id"), "user_id", "event_id")


@probe("set-07", f"SELECT host, arg_min(page_id, (-(page_id % 3), page_id)) AS page_id FROM (SELECT page_id, {_HOST} AS host FROM pages) GROUP BY host")
def _(t):
    rows = t.pages.select("page_id", S.host_key("url").alias("host"), (F.col("page_id") % 3).alias("confidence"))
    return U.first_wins(rows, ["host"], [F.col("confidence").desc(), "page_id"]).select("host", "page_id")


@probe("set-08", "SELECT user_id, CASE WHEN n IS NOT NULL THEN n ELSE o END AS event_id FROM (SELECT user_id, min(event_id) FILTER (WHERE ts >= '2024-01-16') AS n, min(event_id) FILTER (WHERE ts < '2024-01-16') AS o FROM events GROUP BY user_id)")
def _(t):
    rows = t.events.select("user_id", "event_id", "ts")
    return U.reconcile(rows.where("ts >= '2024-01-16'"), rows.where("ts < '2024-01-16'"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@probe("set-09", "SELECT event_id, user_id FROM events WHERE ts >= '2024-01-16' OR user_id NOT IN (SELECT user_id FROM events WHERE ts >= '2024-01-16')")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return U.merge_unique(rows.where("ts >= '2024-01-16'"), rows.where("ts < '2024-01-16'"), ["user_id"]).select("event_id", "user_id")


@probe("set-10", """
WITH o AS (SELECT o_orderkey AS k, o_custkey || o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || o_orderstatus AS place FROM orders),
r AS (SELECT 'r' || k AS id, title, place FROM o WHERE k % 2 = 0), a AS (SELECT CASE WHEN k % 5 = 0 THEN 'r' || (k - 1) ELSE 'a' || k END AS id, title, place FROM o WHERE k % 2 = 1 AND k % 3 = 0),
m1 AS (SELECT a.id AS addition, r.id AS "row" FROM a JOIN r ON r.id = a.id),
r2 AS (SELECT * FROM r WHERE id NOT IN (SELECT "row" FROM m1)), a2 AS (SELECT * FROM a WHERE id NOT IN (SELECT addition FROM m1)),
m2 AS (SELECT x.id AS addition, y.id AS "row" FROM (SELECT title, min(id) AS id FROM a2 GROUP BY title HAVING count(*) = 1) x JOIN (SELECT title, min(id) AS id FROM r2 GROUP BY title HAVING count(*) = 1) y ON x.title = y.title),
r3 AS (SELECT * FROM r2 WHERE id NOT IN (SELECT "row" FROM m2)), a3 AS (SELECT * FROM a2 WHERE id NOT IN (SELECT addition FROM m2)),
m3 AS (SELECT x.id AS addition, y.id AS "row" FROM (SELECT place, min(id) AS id FROM a3 GROUP BY place HAVING count(*) = 1) x JOIN (SELECT place, min(id) AS id FROM r3 GROUP BY place HAVING count(*) = 1) y ON x.place = y.place),
m AS (SELECT *, 'id' AS step FROM m1 UNION ALL SELECT *, 'title' FROM m2 UNION ALL SELECT *, 'place' FROM m3)
SELECT a.id AS addition, m."row" AS matched, m.step FROM a LEFT JOIN m ON m.addition = a.id""")
def _(t):
    key = F.col("o_orderkey")
    rows = t.orders.select(key, F.concat("o_custkey", "o_orderpriority").alias("title"), F.concat(F.to_date("o_orderdate").cast("string"), "o_orderstatus").alias("place"))
    named = lambda df, name: df.select(name.alias("id"), "title", "place")
    known = named(rows.where("o_orderkey % 2 = 0"), F.concat(F.lit("r"), key))
    added = named(rows.where("o_orderkey % 2 = 1 and o_orderkey % 3 = 0"), F.when(key % 5 == 0, F.concat(F.lit("r"), key - 1)).otherwise(F.concat(F.lit("a"), key)))
    return U.assign(known, added, "id", ["id", "title", "place"]).withColumnRenamed("row", "matched")


@probe("set-11", "SELECT user_id FROM events WHERE event_type = 'view' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click'")
def _(t):
    side = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id")
    return U.difference(side("view"), side("click"))


@probe("set-12", "SELECT count(*) FILTER (WHERE NOT r) AS only_left, CAST(0 AS BIGINT) AS only_right, count(*) FILTER (WHERE NOT r) = 0 AS equal FROM (SELECT o_orderstatus = 'F' AS r FROM orders)")
def _(t):
    ids = t.orders.select("o_orderkey")
    return U.same_rows(ids, t.orders.where("o_orderstatus = 'F'").select("o_orderkey"))


@probe("set-13", f"SELECT host, kind, max(page_id) AS page_id FROM (SELECT page_id, {_HOST} AS host, CASE WHEN page_id % 2 = 0 THEN 'menu' ELSE 'order' END AS kind FROM pages) GROUP BY ALL")
def _(t):
    rows = t.pages.select("page_id", S.host_key("url").alias("host"), F.when(F.col("page_id") % 2 == 0, "menu").otherwise("order").alias("kind"))
    return U.last_wins(rows, ["host", "kind"], ["page_id"])


@probe("set-14", "SELECT split_part(split_part(url, '#', 1), '?', 1) AS link, min(page_id) AS page_id FROM pages GROUP BY 1")
def _(t):
    rows = t.pages.select(F.regexp_extract("url", "^[^?#]*", 0).alias("link"), "page_id")
    return U.first_wins(rows, ["link"], ["page_id"])


@probe("set-15", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier) AS known FROM customer GROUP BY c_nationkey, c_mktsegment")
def _(t):
    rows = U.first_wins(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], ["c_custkey"])
    known = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("known")).distinct()
    return rows.join(known, "c_nationkey", "left").withColumn("known", F.coalesce("known", F.lit(False)))


# --- windows -----------------------------------------------------------------


@probe("win-01", "SELECT user_id, event_id AS best, value - coalesce(second, 0) AS margin FROM (SELECT *, row_number() OVER w AS n, lead(value) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE n = 1")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    rows = t.events.withColumns({"n": F.row_number().over(w), "second": F.lead("value").over(w)}).where("n = 1")
    return rows.select("user_id", F.col("event_id").alias("best"), (F.col("value") - F.coalesce("second", F.lit(0.0))).alias("margin"))


@probe("win-02", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n <= 3")
def _(t):
    return J.top_per(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 3).select("l_orderkey", "l_linenumber", "l_partkey")


@probe("win-03", "SELECT model, day, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id % 4 AS model, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value, event_type, rank() OVER (PARTITION BY user_id % 4, CAST(ts AS DATE) ORDER BY hour(ts) DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error' GROUP BY ALL")
def _(t):
    rows = t.events.select((F.col("user_id") % 4).alias("model"), F.to_date("ts").cast("string").alias("day"), "value", "event_type", F.hour("ts").alias("cycle"))
    newest = newest_cycle(rows, ["model", "day"], "cycle")
    return newest.where("event_type <> 'error'").groupBy("model", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def newest_cycle(rows, target, cycle):
    """Rows of each target's newest cycle. Ranked before any check of completeness, so an older cycle never stands in."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*target).orderBy(F.col(cycle).desc()))).where("_r = 1").drop("_r")


@probe("win-04", "SELECT user_id, event_id, hours = 1 AS follows FROM (SELECT user_id, event_id, date_diff('hour', date_trunc('hour', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), date_trunc('hour', ts)) AS hours FROM events)")
def _(t):
    rows = t.events.withColumn("hour", F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp")) / 3600)
    return W.follows(rows, ["user_id"], ["ts", "event_id"], "hour").select("user_id", "event_id", "follows")


@probe("win-05", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS run FROM d), i AS (SELECT user_id, run, count(*) AS days, min(day) AS first FROM r GROUP BY ALL)
SELECT r.user_id, CAST(day AS VARCHAR) AS day, days FROM r JOIN i ON i.user_id = r.user_id AND i.run = r.run WHERE day <= first + CAST(days AS INT) - 3""")
def _(t):
    rows = t.events.select("user_id", F.to_date("ts").alias("day"))
    runs = W.islands(rows, ["user_id"], "day").withColumnRenamed("user_id", "u")
    blocks = W.full_blocks(rows, ["user_id"], "day", 3)
    met = blocks.join(runs, (F.col("user_id") == F.col("u")) & F.col("day").between(F.col("first"), F.col("last")))
    return met.select("user_id", F.col("day").cast("string").alias("day"), "days")


@probe("win-06", "WITH h AS (SELECT user_id, event_id, sha256(user_id || '|' || event_id) AS own FROM events) SELECT user_id, event_id, lag(own) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL OR event_id % 5 <> 0 AS chained FROM h")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.withColumn("own", F.sha2(F.concat_ws("|", "user_id", "event_id"), 256))
    said = rows.withColumn("said", F.when(F.col("event_id") % 5 == 0, F.lit("broken")).otherwise(F.lag("own").over(w)))
    return said.select("user_id", "event_id", chained(F.col("said"), F.lag("own").over(w)).alias("chained"))


def chained(said, before):
    """Whether a row names its predecessor's hash; the first has none to name."""
    return before.isNull() | said.eqNullSafe(before)


@probe("win-07", "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 4) AS running FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sum("l_quantity").over(w), 4).alias("running"))


@probe("win-08", "SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents WHERE text IS NOT NULL")
def _(t):
    return W.key_counts(t.documents.where("text is not null").select("doc_id", F.md5("text").alias("k")), "k").select("doc_id", "n")
