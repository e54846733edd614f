import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plaza.functions import collections as C
from plaza.functions import dates as D
from plaza.functions import numbers as N
from plaza.functions import text as S
from plaza.operators import facts
from plaza.probes.extraction import sentences


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "key"), [("The Café Ünï!", "cafeuni"), ("Theatre", "theatre"), ("", ""), ("over the hill", "overhill")])
def test_compact_key(spark, text, key):
    assert value(spark, S.compact_key(F.lit(text))) == key


@pytest.mark.parametrize(("address", "civic"), [("12 Elm St", "12"), ("12a Elm", "12A"), ("12-14 Elm", None), ("Unit 4, 12 Elm", None), (None, None)])
def test_civic_number(spark, address, civic):
    assert value(spark, S.civic_number(F.lit(address).cast("string"))) == civic


@pytest.mark.parametrize(("url", "kept"), [("https://A.example/x?b=2&utm_source=q&a=1#t", "https://a.example/x?a=1&b=2"), ("http://a.example/", None), ("https://a.example", "https://a.example/"), ("nonsense", None)])
def test_canonical_url(spark, url, kept):
    assert value(spark, S.canonical_url(F.lit(url))) == kept


@pytest.mark.parametrize(("text", "ok"), [("2024-02-29", True), ("2023-02-29", False), ("2024-2-9", False), ("", False)])
def test_strict_date(spark, text, ok):
    assert (value(spark, D.strict_date(F.lit(text))) is not None) == ok


@pytest.mark.parametrize(("text", "want"), [("2024-01-16T12:00:00Z", "2024-01-16 12:00:00"), ("Tue, 16 Jan 2024 12:00:00 GMT", "2024-01-16 12:00:00"), ("Wed, 16 Jan 2024 12:00:00 GMT", None), ("2024-01-16T24:00:00Z", None), ("16 Jan 2024", None)])
def test_strict_instant(spark, text, want):
    assert value(spark, F.date_format(D.strict_instant(F.lit(text)), "yyyy-MM-dd HH:mm:ss")) == want


def test_date_line_of_daylight_saving(spark):
    at = F.lit("2024-03-10 05:30:00").cast("timestamp_ntz")
    assert str(value(spark, D.local(at))) == "2024-03-10 01:30:00"
    assert str(value(spark, D.local(F.lit("2024-03-10 06:30:00").cast("timestamp_ntz")))) == "2024-03-10 03:30:00"


@pytest.mark.parametrize(("ms", "state", "recent"), [(1, "valid", True), (-1, "future", False), (180 * D.DAY_MS, "valid", True), (180 * D.DAY_MS + 1, "valid", False)])
def test_publication_clock(spark, ms, state, recent):
    at = F.timestamp_millis(F.unix_millis(F.lit("2024-01-16 12:00:00").cast("timestamp")) - ms).cast("timestamp_ntz")
    assert value(spark, D.publication_state(at, "2024-01-16 12:00:00")) == state
    assert value(spark, D.is_recent(at, "2024-01-16 12:00:00", 180)) is recent


@pytest.mark.parametrize(("clock", "state"), [("2024-01-20 01:30:00", "open"), ("2024-01-20 03:00:00", "closed"), ("2024-01-19 23:00:00", "open"), ("2024-01-21 12:00:00", "unknown"), ("2024-01-22 12:00:00", "unknown")])
def test_overnight_hours(spark, clock, state):
    span = F.array(F.struct(F.lit("18:00").alias("open"), F.lit("02:00").alias("close")))
    none = F.array().cast("array<struct<open:string,close:string>>")
    weekly = F.create_map(F.lit("friday"), span, F.lit("saturday"), none)  # other days unknown
    assert value(spark, D.hours_state(weekly, F.lit(clock).cast("timestamp_ntz"))) == state


def test_cadence(spark):
    got = value(spark, D.cadence(F.lit("Fri-Mon 11:30am-12pm")))
    assert (got.days, got.opens, got.closes) == (["friday", "saturday", "sunday", "monday"], "11:30", "12:00")
    assert value(spark, D.cadence(F.lit("whenever"))) is None


def test_weekend(spark):
    for day, friday in (("2024-01-15", "2024-01-19"), ("2024-01-19", "2024-01-19"), ("2024-01-21", "2024-01-19")):
        assert str(value(spark, D.weekend_of(F.lit(day).cast("date"))[0])) == friday


def test_keyed_union_keeps_first(spark):
    item = lambda *rows: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rows])
    got = value(spark, C.keyed_union(item(("a", 1), ("b", 2)), item(("a", 9), ("c", 3)), "k"))
    assert [(x.k, x.v) for x in got] == [("a", 1), ("b", 2), ("c", 3)]


def test_slots_never_promote(spark):
    assert value(spark, C.slots(F.array(*map(F.lit, (1, 5, 2, 7))), 3, lambda x: x > 3)) == [5]


def test_lcg_and_quantile():
    assert N.lcg(1729, 2) == [(1729 * 1664525 + 1013904223) % 2**32, (((1729 * 1664525 + 1013904223) % 2**32) * 1664525 + 1013904223) % 2**32]
    assert N.quantile([1, 2, 3], 0.1) == pytest.approx(1.2)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20), st.floats(0, 1))
def test_quantile_stays_inside(values, p):
    assert min(values) <= N.quantile(values, p) + 1e-6 and N.quantile(values, p) <= max(values) + 1e-6


def test_image_size():
    assert N.image_size(b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little") + bytes(8)) == (7, 9)
    assert N.image_size(b"no image at all, really") is None and N.image_size(None) is None


def test_retry_after(spark):
    seen = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    assert value(spark, D.retry_not_before(F.lit("90"), seen)) == dt.datetime(2024, 1, 16, 12, 1, 30)
    assert value(spark, D.retry_not_before(F.lit("Wed, 17 Jan 2024 00:00:00 GMT"), seen)) == dt.datetime(2024, 1, 17)
    assert value(spark, D.retry_not_before(F.lit("soon"), seen)) is None


def test_sentences_keep_digits_at_their_ends(spark):
    texts = ["Reouti anatha. 19.37.233.111", "One of them is here. 1 is the first one", " short. 1234567890 1 ", "\u00a0elevenchars\u3000. \ta tab counts", None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, text string")
    got = {r.k: r.s for r in rows.select("k", sentences("text").alias("s")).collect()}
    assert got == {0: ["Reouti anatha", "19.37.233.111"], 1: ["One of them is here", "1 is the first one"], 2: ["1234567890 1"], 3: ["\ta tab counts"], 4: None}


def test_words_are_found_as_by_regular_expressions(spark):
    words = [*facts.IMPORT_CATEGORIES, *facts.CLEAN_CATEGORIES]
    parts = ["game", "games", "vs", "vs.", "evs", "dj", "djs", "standup", "stand-up", "stand up", "stand  up", "hip hop", "art", "arts", "cart", "party", "tour", "détour", "éart", "arté", "paddle", "x", "fair", "fairs", "all-ages", "jimmy carr", "rock", "rocks_", "play", "", "opera"]
    texts = [*parts, *[f"{a}{mark}{b}" for a in parts for b in parts[::3] for mark in (" ", "_", ".", "é")], "a\nvs.\nb", None]
    found = lambda how: F.array(*[how(F.col("t"), w) for _, w in words])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", found(S.holds_any).alias("a"), found(lambda c, w: c.rlike(S.borders(w))).alias("b")).collect()
    assert len(got) == len(texts) and all(r.a == r.b for r in got)


def test_words_are_looked_for_before_patterns(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(facts.categories("t"))._jdf.queryExecution().analyzed().toString()
    assert "Contains" in plan or "contains" in plan
    with pytest.raises(ValueError):
        S.holds_any("t", "[ab]c")
