"""Schedules, facts and sinks on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plaza.functions import schedules as H
from plaza.functions import text as S
from plaza.operators import facts
from plaza.operators import predicates as P
from plaza.sources import files, release, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "first", "last"),
    [
        ("June 3 – 5, 2024", (2024, 6, 3), (2024, 6, 5)), ("Sept. 30 - October 2, 2024", (2024, 9, 30), (2024, 10, 2)), ("Dec 30, 2024 — Jan 2, 2025", (2024, 12, 30), (2025, 1, 2)), ("on  May 9, 2024!", (2024, 5, 9), (2024, 5, 9)),
        ("opens May 9", (2023, 5, 9), (2023, 5, 9)), ("Feb 30, 2024", None, None), ("soon", None, None), (None, None, None),
    ],
)
def test_date_range(spark, text, first, last):
    got = one(spark, H.date_range(F.lit(text).cast("string"), F.lit(2023)))
    day = lambda d: dt.date(*d) if d else None
    assert (got.first if got else None, got.last if got else None) == (day(first), day(last))


def test_clocks(spark):
    assert [tuple(one(spark, H.clock(F.lit(c).cast("string")))) for c in ("12 am", "12:15 p.m.", "7", "19:30", "noon", None)] == [(0, 0, True), (12, 15, True), (7, 0, True), (19, 30, True), (12, 0, False), (12, 0, False)]
    assert tuple(one(spark, H.time_range(F.lit("doors 7 pm – 9:30 P.M. sharp")))) == ("7 pm", "9:30 P.M.")
    assert one(spark, H.compact_date(F.lit("3-Jan-24"))) == dt.date(2024, 1, 3) and one(spark, H.compact_date(F.lit("x"))) is None


@pytest.mark.parametrize(
    ("lines", "spans"),
    [
        (["Mo-We 09:00-17:00"], [(d, "09:00", "17:00", False) for d in range(3)]), (["Sat-Mo 10PM-2AM"], [(d, "22:00", "02:00", True) for d in (5, 6, 0)]), (["Fr 09:00-12:00", "Fr 13:00-17:00"], [(4, "09:00", "12:00", False), (4, "13:00", "17:00", False)]),
        (["Fr 09:00-12:00", "Fr 11:00-17:00"], None), (["Fr 09:00-12:00", "Fr 09:00-12:00"], [(4, "09:00", "12:00", False)] * 2), (["Fr 09:00-09:00"], None), (["Xy 09:00-10:00"], None), (["Fr 9-10"], None), ([], None), (None, None),
    ],
)
def test_weekly_strings(spark, lines, spans):
    got = one(spark, H.weekly_from_strings(F.lit(None).cast("array<string>") if lines is None else F.array(*map(F.lit, lines)).cast("array<string>")))
    assert (got and [tuple(x) for x in got]) == spans


def test_weekly_specs(spark):
    kind = "array<struct<dayOfWeek:array<string>,opens:string,closes:string>>"
    read = lambda text: one(spark, H.weekly_from_specs(F.from_json(F.lit(text), kind)))
    assert [tuple(x) for x in read('[{"dayOfWeek":["https://schema.org/Monday","Tuesday"],"opens":"9 AM","closes":"17:00"}]')] == [(0, "09:00", "17:00", False), (1, "09:00", "17:00", False)]
    assert read('[{"dayOfWeek":["Someday"],"opens":"9 AM","closes":"17:00"}]') is None and read('[{"dayOfWeek":["Monday"],"opens":"9","closes":"17:00"}]') is None


def test_hours_on(spark):
    df = spark.sql("SELECT 'old' AS o, array(named_struct('date', '2024-01-05', 'hours', 'once')) AS d, array(named_struct('from', '2024-01-01', 'hours', 'a'), named_struct('from', '2024-01-04', 'hours', 'b'), named_struct('from', '2024-02-01', 'hours', 'c')) AS r")
    at = lambda day: df.select(H.hours_on("o", "d", "r", F.lit(day))).first()[0]
    assert [at(d) for d in ("2023-12-31", "2024-01-03", "2024-01-05", "2024-01-06", "2025-01-01")] == ["old", "a", "once", "b", "c"]
    none = df.select(H.hours_on("o", F.lit(None).cast("array<struct<date:string,hours:string>>"), F.lit(None).cast("array<struct<from:string,hours:string>>"), F.lit("2024-01-05"))).first()[0]
    assert none == "old"


def test_borders(spark):
    assert one(spark, F.lit("bandé").rlike(S.borders(r"band\b"))) and not one(spark, F.lit("bands").rlike(S.borders(r"band\b")))


def test_chain_policy(spark):
    rows = spark.createDataFrame([("Hut's", None, None), ("Big Hut", None, None), ("Hutch", "https://a.hut.example", None), (None, "https://ahut.example", "Hut")], "name string, site string, brand string")
    got = P.chain_policy(rows, {"name": "name", "brand": "brand"}, {"website": "site"}, ["hut"], ["hut.example"]).collect()
    assert [r.chain and (r.chain.reason, r.chain.field, r.chain.token, r.chain.value) for r in got] == [
        ("non_local_chain_label", "name", "hut", "Hut's"), ("non_local_chain_label", "name", "hut", "Big Hut"), ("non_local_chain_website", "website", "hut.example", "https://a.hut.example"), ("non_local_chain_label", "brand", "hut", "Hut"),
    ]


def test_event_key_needs_evidence(spark):
    key = lambda title, venue, url=None, kind="x": one(spark, facts.event_key(F.lit(kind), F.lit(url).cast("string"), F.lit("2024-01-05 20:00:00").cast("timestamp"), F.lit(title), F.lit(None).cast("string"), F.lit(venue).cast("string"), {"a": "a1", "b": "b1"}, {}, ["lib.example"]))
    assert key("A vs B", "hall").startswith("a1|b1|hall|") and key("A v. B", None) is None and key("A vs C", "hall") is None and key("Concert", "hall") is None
    assert key("x", None, "https://lib.example/v2/events/ab1", "public_library_calendar") == key("y", "z", "https://lib.example/events/ab1/", "public_library_calendar")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a"; </script>'), (2, None)], "id int, name string")
    folder = str(tmp_path / "t")
    sinks.write_twins(rows, folder, "ROWS")
    assert sinks.twins_agree(spark, folder, rows.schema).first() == (0, 0, True)
    assert sorted(map(tuple, sinks.read_script(spark, f"{folder}/script", rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        sinks.write_script(rows, folder + "x", "a b")
    nested = spark.sql("SELECT 1 AS id, 'x' AS n, array(named_struct('v', 5), named_struct('v', 6)) AS kids")
    sinks.write_tables(nested, folder + "/db", "id", ["kids"])
    sinks.upsert(spark, folder + "/db", "kids", spark.createDataFrame([(1, 1, 60), (2, 0, 7)], "id int, ordinal int, v int"), ["id", "ordinal"])
    assert sorted(map(tuple, release.table(spark, folder + "/db", "kids").collect())) == [(1, 0, 5), (1, 1, 60), (2, 0, 7)]
    assert sinks.sitemap(spark.range(10).selectExpr("concat('u', id) AS url"), most=4).count() == 3
    assert files.shared_folder(spark) != files.shared_folder(spark)


def test_snapshot_guard(spark):
    ids = lambda city, n: [(city, str(k)) for k in range(n)]
    old = spark.createDataFrame(ids("a", 20) + ids("b", 20) + ids("c", 19) + ids("d", 5), "city string, id string")
    new = spark.createDataFrame(ids("a", 14) + ids("b", 15) + ids("c", 1) + ids("e", 1), "city string, id string")
    got = {r.city: r.state for r in facts.accept_snapshot(new, old, "city", "id").collect()}
    assert got == {"a": "fell", "b": "accepted", "c": "accepted", "d": "retained", "e": "accepted"}
