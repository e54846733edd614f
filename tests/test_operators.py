import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plaza import probes
from plaza.functions import text as T
from plaza.operators import forecast as W
from plaza.operators import joins as J
from plaza.operators import metrics as M
from plaza.operators import predicates as P
from plaza.operators import reconcile as R
from plaza.operators import sets as U
from plaza.plans.facets import EventQuery, PlaceQuery
from plaza.sources import markup


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_first_wins_whatever_the_order(spark):
    data = [("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, "w"), ("b", 5, "v")]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(data)
        got = rows(U.first_wins(spark.createDataFrame(data, "k string, o int, v string"), ["k"], ["o"]), "o", "v")
        want = want or got
        assert got == want == [(1, "x"), (3, "z"), (4, "w"), (5, "v")]


def test_reconcile_and_merge_unique(spark):
    new = spark.createDataFrame([(1, "n")], "k int, v string")
    old = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    assert rows(U.reconcile(new, old, ["k"], ["v"])) == rows(U.merge_unique(new, old, ["k"])) == [(1, "n"), (2, "o")]
    empty = new.limit(0)
    assert rows(U.merge_unique(empty, old, ["k"])) == [(1, "o"), (2, "o")]
    assert U.same_rows(new, new).first().equal and not U.same_rows(new, old).first().equal


@pytest.mark.parametrize(
    ("explicit", "named", "same", "metres", "state"),
    [(False, False, True, 1.0, "distinct"), (False, True, True, 75.0, "match"), (False, True, True, 76.0, "review"), (False, True, True, 251.0, "review"), (False, True, False, 1.0, "distinct"), (True, True, False, 1.0, "review"), (True, False, None, None, "match"), (False, True, None, 251.0, "distinct"), (False, True, None, 10.0, "review")],
)
def test_identity(spark, explicit, named, same, metres, state):
    place = J.place_of(F.lit(same).cast("boolean"), F.lit(metres).cast("double"))
    assert spark.range(1).select(J.decide(F.lit(explicit), F.lit(named), place)).first()[0] == state


def test_cascade_needs_one_owner(spark):
    places = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, "b", "u")], "id int, name string, street string")
    asks = spark.createDataFrame([("a", "t"), ("b", "x"), ("a", "x")], "n string, s string")
    got = J.cascade(asks, places, [("name", F.col("n"), F.col("name")), ("street", F.col("s"), F.col("street"))], "id")
    assert sorted(map(str, rows(got, "n", "s", "place_id", "how"))) == sorted(map(str, [("a", "t", 2, "street"), ("b", "x", 3, "name"), ("a", "x", None, None)]))


@pytest.mark.parametrize(
    ("price", "kind"),
    [(None, "unknown"), ("Free!", "free"), ("free admission", "free"), ("$0", "free"), ("$12.50", "paid"), ("20 dollars", "paid"), ("general admission $15", "paid"), ("no $5 entry", "unknown"), ("Adults $12; free entry", "paid"), ("free admission, tickets $10", "unknown"), ("admission $0", "free"), ("by donation", "unknown"), ("Adults – $12", "paid"), ("Public — 20 dollars", "paid"), ("adults-$5", "paid"), ("$5 for non-members", "paid"), ("tickets are $0, adults $3", "paid"), ("without tickets at $5", "unknown"), ("$5 members", "unknown"), ("5", "paid"), ("0 cad", "free")],
)
def test_cost_kind(spark, price, kind):
    assert spark.range(1).select(P.cost_kind(F.lit(price).cast("string"))).first()[0] == kind


def test_family_balance(spark):
    data = [("t", "f1", "m1", 0.0), ("t", "f1", "m2", 0.0), ("t", "f1", "m3", 0.0), ("t", "f2", "m4", 10.0), ("u", "f1", "m1", 1.0)]
    df = spark.createDataFrame(data, "target string, family string, model string, value double")
    assert rows(W.family_mean(df, ["target"]), "target", "mean", "families") == [("t", 5.0, 2)]
    weights = rows(W.member_weights(df, ["target"]).where("target = 't'"), "model", "weight")
    assert [w for _, w in weights] == pytest.approx([1 / 6, 1 / 6, 1 / 6, 1 / 2])


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    days = spark.createDataFrame([("k", d, float(d % 4)) for d in range(30)], "key string, day int, difference double")
    a, b = (W.bootstrap(days, "key").first() for _ in range(2))
    assert a == b and a.low <= 1.5 <= a.high and a.blocks == 28
    for few, blocks in (("day < 2", 0), ("day < 29", 27), ("day % 4 < 3", 7)):
        short = W.bootstrap(days.where(few), "key").first()
        assert short.blocks == blocks and short.low is None


def test_losses(spark):
    old = spark.createDataFrame([(1, "s", "2024-01-20", None), (2, "s", "2024-01-20", "cancelled"), (3, "s", "2023-01-01", None), (4, "down", "2024-01-20", None), (5, "s", None, None), (6, "s", "2024-01-20", None)], "id int, source string, at string, status string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    new = old.where("id = 1")
    failed = spark.createDataFrame([("down",)], "source string")
    got = R.future_losses(new, old, "id", "source", "at", "status", "2024-01-16 12:00:00", failed)
    assert rows(got, "id", "verdict") == [(2, "cancelled"), (3, "expired"), (4, "retained"), (5, "invalid"), (6, "held")]


def test_quarantine_mismatch_stays(spark):
    data = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    archive = spark.createDataFrame([(1, "a"), (2, "other")], "id int, v string")
    assert rows(R.quarantine(data, archive, "id", ["v"]), "id", "verdict") == [(1, "quarantined"), (2, "mismatch"), (3, "kept")]


def test_drift(spark):
    old = spark.createDataFrame([("big",)] * 25 + [("small",)] * 5, "source string")
    new = spark.createDataFrame([], "source string")
    assert rows(R.source_drift(new, old, "source", 2.0), "source", "state") == [("big", "carried"), ("small", "normal")]
    assert rows(R.source_drift(new, old, "source", 8.0).where("source = 'big'"), "state") == [("dropped",)]


def test_problems(spark):
    df = spark.range(2).withColumn("problems", M.problems([("one", F.col("id") == 1), ("null", F.lit(None).cast("boolean"))]))
    with pytest.raises(ValueError, match="one"):
        M.assert_no_problems(df)
    M.assert_no_problems(df.where("id = 0"))


def test_routes():
    q = PlaceQuery.from_hash("#explore?q=a%20b&page=x&zzz=1&sort=name")
    assert (q.q, q.page, q.sort) == ("a b", 1, "name") and PlaceQuery.from_hash(q.to_hash("explore")) == q
    assert PlaceQuery().to_hash("explore") == "#explore" and EventQuery().duration == "short"


@pytest.mark.parametrize(
    "xml",
    ["", "<rss><channel><item>", "<!DOCTYPE x><rss><item/></rss>", "<html><item/></html>", "<rss><item><item/></item></rss>", "<rss>" + "<item/>" * 101 + "</rss>", "<rss><item>&nope;</item></rss>", None],
)
def test_bad_feeds_fail_closed(xml):
    assert markup.entries_of(xml) is None


def test_feeds():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://a.example/1"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'
    assert markup.entries_of(atom) == [{"title": "T", "link": "https://a.example/1", "guid": None, "published": "2024-01-01T00:00:00Z", "summary": None}]


def test_owned_feeds():
    item = lambda title, link: f"<item><title>{title}</title><link>{link}</link></item>"
    feed = lambda *items: f"<rss><channel>{''.join(items)}</channel></rss>"
    assert markup.owned_entries(feed()) == [] and markup.owned_entries(None) is None and markup.owned_entries("<rss>") is None
    assert len(markup.owned_entries(feed(*[item("t", "u")] * 200))) == 80
    assert markup.owned_entries(feed(item("t", "u"), item("", "u"))) is None and markup.owned_entries(feed(item("t", ""))) is None


@pytest.mark.parametrize(
    ("text", "path", "allowed"),
    [
        ("", "/x", True), (None, "/x", True), ("# nothing", "/x", True), ("User-agent: *\nDisallow: /", "/x", False), ("User-agent: *\nDisallow:", "/x", True),
        ("User-agent: *\nDisallow: /\nUser-agent: plaza\nDisallow: /a", "/x", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", False), ("User-agent: *\nDisallow: /\nAllow: /x", "/x/a", False),
        ("User-agent: *\nDisallow: /*.php$", "/x.php?y", True), ("User-agent: *\nDisallow: /*.php$", "/x.php", False), ("User-agent: *\nDisallow: /a*b*c", "/a1b2c3", False), ("User-agent: *\nDisallow: /a*b*c", "/acb", True), ("User-agent: *\nDisallow: /a*a$", "/a", True),
        ("User-agent: *\nDisallow: /%7ea", "/~a", False), ("User-agent: *\nDisallow: /a%2fb", "/a/b", True), ("User-agent: *\nDisallow: /?q=", "/?q=1", False), ("User-agent: *\nDisallow: /" + "*a" * 40 + "$", "/" + "a" * 4000 + "b", True),
        ("<html></html>", "/x", False), ("Disallow: /a", "/x", False), ("User-agent: a b\nDisallow:", "/x", False), ("error: no", "/x", False), ("User-agent: *\nDisallow: a", "/x", False), ("Host: x", "/x", False), ("Sitemap: ftp://a/b", "/x", False), ("Sitemap: https://a.example/b", "/x", True), ("User-agent: *\nDisallow: /\x00", "/x", False), ("User-agent: *\n" + "# x\n" * 140_000, "/x", False),
        ("User-agent: *\nDisallow: /a b", "/a%20b", False), ("User-agent: *\nDisallow: /x\"y", "/x%22y", False), ("User-agent: *\nDisallow: /a|b", "/a%7Cb", False), ("User-agent: *\nDisallow: /a%5eb", "/a^b/c", False), ("User-agent: *\nDisallow: /a%3Ab", "/a:b", True),
        ("User-agent: *\nDisallow: /*" + "(a*" * 30, "/" + "(a" * 3000, False), ("User-agent: *\nDisallow: /a.c", "/abc", True), ("User-agent: *\nDisallow: /a*$", "/abc", False), ("User-agent: *\nDisallow: /a$b", "/a$b", False), ("User-agent: *\nDisallow: /é", "/%c3%a9x", False),
        ("User-agent: myplaza\nDisallow: /b", "/b/c", False), ("User-agent: *\nDisallow: /b*", "/b*c", False), ("User-agent: *\nCrawl-delay: 1\nUser-agent: plaza\nDisallow: /c", "/c", False),
    ],
)
def test_robots(text, path, allowed):
    assert markup.robots_allow(text, "plaza", path) is allowed


def test_robots_older_readings():
    text = "User-agent: plaza\nSitemap: https://a.example/s.xml\nUser-agent: other\nDisallow: /d"
    assert markup.robots_allow(text, "plaza", "/d") is False  # sitemaps don't end a group
    assert markup.Robots(markup.robots_records(text), "plaza", cautious=False).allow("/e") and not markup.Robots(markup.robots_records(text), "plaza", cautious=False).allow("/d")
    text = "User-agent: *\nDisallow: /a\nUser-agent: *\nDisallow: /b"
    assert [markup.robots_allow(text, "plaza", p) for p in ("/a", "/b", "/c")] == [False, False, True]


@pytest.mark.parametrize(
    ("page", "closures", "moves"),
    [
        ("<p>We have <i>permanently</i>  closed</p>", ["permanently closed"], []), ("The chef was born here before relocating", [], []), ("I'd consider moving to it. We are moving to it", [], ["moving to"]), ("The chef was born before relocating; then relocating again", [], ["relocating"]),
        ("celebrating the soft opening of our new location at Ottawa", [], []), ("celebrating the soft opening. Our new location at Ottawa", [], ["new location"]), ("<style>has closed", [], []), ("will close or will be closed", ["will close", "will be closed"], []), (None, [], []),
    ],
)
def test_lifecycle(spark, page, closures, moves):
    told = spark.range(1).select(markup.lifecycle_language(F.lit(page).cast("string")).alias("x")).first().x
    assert (told.closures, told.moves) == (closures, moves)


def test_titles(spark):
    cases = [("Featured Event. Meet Juno", "Meet Juno"), ("A B Featured Event. A B", "A B"), ("Featured Event. M Featured Event. M", "M"), ("A Featured Event. B", "A Featured Event. B"), ("x y  x y", "x y"), (None, None), ("", "")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r[0] for r in df.select(T.display_title("t"), "want").collect()] == [w for _, w in cases]
    folded = spark.createDataFrame([("É e\u0301 ﬁ Ａ ế Ώ",)], "t string").select(T.fold_compatible("t"), T.fold("t")).first()
    assert folded[0] == "e e fi a e ω" and folded[1] == "e e ﬁ ａ e ω"


def test_calendar():
    text = "BEGIN:VEVENT\r\nUID:1\r\nDTSTART;VALUE=DATE:20240116\r\nSUMMARY:a\\, b\r\n  c\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2"
    assert markup.calendar_events(text) == [{"uid": "1", "summary": "a, b c", "starts": "2024-01-16", "ends": None, "all_day": True, "location": None}]


def test_first_of_tied_links_leads(spark, tmp_path):
    lines = [(1, 2, 7, 41.0), (1, 2, 7, 7.0), (1, 3, 5, 1.0), (2, 1, 9, 7.0), (2, 1, 9, 41.0), (3, 1, 8, 11.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = duckdb.connect().sql(probes.oracle_sql()["flt-13"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert rows(probes.queries()["flt-13"](spark, str(tmp_path)), "l_orderkey", "action") == sorted(want) == [(1, 7), (2, None), (3, 8)]


def test_orphans_are_found_without_a_broadcast(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "k int, v string")
    right = spark.createDataFrame([(1,), (1,), (None,), (3,)], "k int")
    kept, orphans = J.with_orphans(left, right, "k", "unknown")
    assert rows(kept, "k", "v") == [(1, "a"), (1, "d")] and kept.columns == ["k", "v"]
    assert rows(orphans, "v", "reason") == [("b", "unknown"), ("c", "unknown")]
    assert rows(J.with_reason(left, right, "k", "unknown"), "v", "reason") == [("a", None), ("b", "unknown"), ("c", "unknown"), ("d", None)]
    for df in (kept, orphans, J.with_reason(left, right, "k", "unknown")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
