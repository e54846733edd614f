"""Reviews, series and discovery on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from plaza.operators import joins as J
from plaza.operators import review as V
from plaza.operators import sets as U
from plaza.operators import windows as W
from plaza.sources import discovery


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_islands_and_blocks(spark):
    days = [("a", d) for d in (1, 2, 3, 5, 6, 7, 8)] + [("a", 3), ("b", 1)]
    df = spark.createDataFrame([(k, dt.date(2024, 1, d)) for k, d in days], "k string, day date")
    day = lambda d: dt.date(2024, 1, d)
    assert rows(W.islands(df, ["k"], "day")) == sorted([("a", day(1), day(3), 3), ("a", day(5), day(8), 4), ("b", day(1), day(1), 1)], key=str)
    assert rows(W.full_blocks(df, ["k"], "day", 3)) == [("a", day(1)), ("a", day(5)), ("a", day(6))]


def test_decisions_by_id_then_url(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    posts = spark.createDataFrame([(1, "u1", at(1)), (2, "u2", at(1)), (3, None, at(1))], "id int, url string, published timestamp_ntz")
    said = spark.createDataFrame([(1, None, "rejected", None, None), (None, "u1", "approved", None, None), (None, "u2", "approved", at(9), None)], "id int, url string, decision string, expires_at timestamp_ntz, review_due_at timestamp_ntz")
    now = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp_ntz")
    assert rows(V.decide_posts(posts, said, now(8)), "id", "decision", "current") == [(1, "rejected", False), (2, "approved", True), (3, "undecided", False)]
    assert rows(V.decide_posts(posts, said, now(9)).where("id = 2"), "current") == [(False,)]


def test_folded_decisions(spark):
    items = spark.range(4)
    said = spark.createDataFrame([(0, 2, "withdrawn"), (0, 1, "approved"), (1, 1, "withdrawn"), (2, 1, "rejected"), (2, 2, "approved")], "id long, at int, decision string")
    assert rows(V.fold_decisions(items, said, "id")) == [(0, "withdrawn"), (1, "pending"), (2, "approved"), (3, "pending")]


def test_ranges_need_one_index_row(spark):
    index = spark.createDataFrame([("a", 0, 10), ("b", 0, 10), ("b", 5, 10)], "k string, offset long, length long")
    asked = spark.createDataFrame([("a", 0, 9, 10), ("b", 0, 9, 10), ("c", 0, 9, 10)], "k string, first long, last long, size long")
    assert rows(V.index_fits(index, asked, ["k"])) == [("a", "fits"), ("b", "ambiguous"), ("c", "missing")]
    assert rows(V.index_fits(index, asked.withColumn("size", F.col("size") - 1), ["k"]).where("k = 'a'")) == [("a", "mismatch")]


def test_corrections_keep_to_their_sources(spark):
    data = spark.createDataFrame([(1, "x", "s"), (2, "x", "t")], "k int, place string, source string")
    fixes = spark.createDataFrame([(1, "y", ["t"]), (2, "y", None)], "k int, place string, sources array<string>")
    assert rows(V.correct_occurrences(data, fixes, ["k"], "place")) == [(1, "x", "s", False), (2, "y", "t", True)]


def test_first_wins_keeps_rows_without_a_key(spark):
    data = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 3)], "k string, v int")
    assert rows(U.first_wins(data, ["k"], ["v"])) == sorted([("a", 1), (None, 3), (None, 3)], key=str)


def test_pairs_meet_once(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, None, "p"), (3, None, None)], "id int, name string, phone string")
    got = J.blocked_pairs(a, a.withColumnRenamed("name", "called").withColumnRenamed("called", "name"), [(F.col("name"), F.col("r_name")), (F.col("phone"), F.col("r_phone"))])
    assert rows(got, "id", "r_id") == [(1, 1), (1, 2), (2, 1), (2, 2)] and rows(got.where("id = 2 and r_id = 1"), "phone", "r_name") == [("p", "x")]


def test_handles(spark):
    urls = ["https://www.facebook.com/Corner.Cafe/posts/1", "https://facebook.com/sharer?u=1", "https://facebook.com/permalink.php?id=3", "https://m.facebook.com/profile.php?id=9", "https://twitter.com/@corner", "https://linkedin.com/company/corner", "https://linkedin.com/feed", "https://notfacebook.com/x", "https://instagram.com/", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(discovery.profile("u").alias("p"))
    assert [r.p and (r.p.platform, r.p.handle) for r in df.collect()] == [("facebook", "Corner.Cafe"), None, None, ("facebook", "9"), ("x", "corner"), ("linkedin", "company/corner"), None, None, None, None]


def test_feeds(spark):
    html = '<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="stylesheet" href="x"><LINK href=\'a.xml\' type="application/atom+xml" rel=alternate>'
    assert spark.range(1).select(discovery.feeds(F.lit(html))).first()[0] == ["/feed", "a.xml"]
