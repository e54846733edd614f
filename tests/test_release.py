"""Releases appear whole or not at all; lists of pages are taken whole or not at all."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plaza.operators import review
from plaza.operators.predicates import post_expiry
from plaza.sources import paged, release, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "r")
    assert release.current(spark, folder) is None
    with pytest.raises(ValueError):
        release.table(spark, folder, "a")
    release.publish(spark, folder, {"a": spark.range(3), "b": spark.range(2)}, "2024-01-01")
    release.publish(spark, folder, {"a": spark.range(5)}, "2024-01-02")
    assert release.table(spark, folder, "a").count() == 5 and release.table(spark, folder, "b").count() == 2
    assert release.verify(spark, folder).isEmpty() and release.current(spark, folder)["sequence"] == 2
    with pytest.raises(release.Stale):
        release.publish(spark, folder, {"a": spark.range(1)}, "2024-01-01")  # no way back to older data
    with pytest.raises(release.Stale):
        release.publish(spark, folder, {"a": spark.range(1)}, "2024-01-03", based_on=1)
    assert release.table(spark, folder, "a").count() == 5


def test_a_failed_writer_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "r")
    release.publish(spark, folder, {"a": spark.range(4)}, "1")
    broken = spark.range(0, 40, 1, 4).select(F.when(F.col("id") < 35, F.col("id")).otherwise(F.raise_error(F.lit("killed"))).alias("id"))
    with pytest.raises(Exception, match="killed"):
        release.publish(spark, folder, {"b": spark.range(1), "a": broken}, "2")
    assert rows(release.table(spark, folder, "a")) == [(0,), (1,), (2,), (3,)] and release.verify(spark, folder).isEmpty()
    # a writer that was killed has not even cleaned up
    spark.range(9).write.parquet(f"{folder}/v-dead/a")
    assert release.table(spark, folder, "a").count() == 4
    release.publish(spark, folder, {"a": spark.range(6)}, "2")
    assert "v-dead" in release.retire(spark, folder) and release.table(spark, folder, "a").count() == 6 and release.verify(spark, folder).isEmpty()
    assert len([p for p in Path(folder).iterdir() if p.name.startswith("v-")]) == 1


def test_damage_is_told(spark, tmp_path):
    folder = str(tmp_path / "r")
    release.publish(spark, folder, {"a": spark.range(0, 9, 1, 3)}, "1")
    at = Path(folder) / release.current(spark, folder)["tables"]["a"]
    first, second, *_ = sorted(at.glob("part-*"))
    shutil.copy(first, at / "part-more.parquet")
    second.unlink()
    first.write_bytes(first.read_bytes() + b"x")
    for crc in at.glob(".*.crc"):
        crc.unlink()
    assert sorted(r.state for r in release.verify(spark, folder).collect()) == ["changed", "extra", "missing"]


def test_tables_with_clashing_fields(spark, tmp_path):
    folder = str(tmp_path / "r")
    nested = spark.sql("SELECT 1 AS id, array(named_struct('id', 5, 'Ordinal', 6, 'v', 7)) AS kids")
    sinks.write_tables(nested, folder, "id", ["kids"])
    assert release.table(spark, folder, "kids").columns == ["id", "ordinal", "item_id", "item_Ordinal", "v"]
    assert rows(release.table(spark, folder, "kids")) == [(1, 0, 5, 6, 7)]


# --- lists of pages ------------------------------------------------------------


def page(key, n, total, ids):
    return key, n, total, json.dumps([{"id": i, "link": f"https://m/{i}", "name": str(i)} for i in ids])


CASES = {
    "whole": ([page("x", 1, 5, [1, 2, 3]), page("x", 2, 5, [4, 5])], range(1, 6), []),
    "one page": ([page("x", 1, 1, [9])], [9, 10], []),
    "missing": ([page("x", 1, 5, [1, 2, 3]), page("x", 3, 5, [5])], range(1, 6), ["page_missing", "count_mismatch"]),
    "no first": ([page("x", 2, 2, [1, 2])], [1, 2], ["page_missing"]),
    "repeated": ([page("x", 1, 2, [1, 2]), page("x", 1, 2, [1, 2])], [1, 2], ["page_repeated"]),
    "sixth": ([page("x", n, 6, [n]) for n in range(1, 7)], range(1, 7), ["too_many_pages"]),
    "totals differ": ([page("x", 1, 2, [1]), page("x", 2, 3, [2])], [1, 2], ["total_invalid"]),
    "no total": ([("x", 1, None, page("x", 1, 1, [1])[3])], [1], ["total_invalid", "count_mismatch"]),
    "unreadable": ([page("x", 1, 2, [1, 2]), ("x", 2, 2, "<html>")], [1, 2], ["page_unreadable"]),
    "member twice": ([page("x", 1, 3, [1, 2]), page("x", 2, 3, [2])], [1, 2], ["count_mismatch"]),
    "details lack": ([page("x", 1, 2, [1, 2])], [1, 7], ["detail_incomplete"]),
    "empty": ([page("x", 1, 0, [])], [], ["total_invalid"]),
}


@pytest.mark.parametrize("case", CASES)
def test_lists_fail_closed(spark, case):
    pages, details, problems = CASES[case]
    pages = spark.createDataFrame([*pages, page("other", 1, 1, [1])], "k string, page int, total int, body string")
    details = spark.createDataFrame([("x", i) for i in details] + [("other", 1)], "k string, id long")
    got = {r.k: r for r in paged.completeness(pages, details, "k").collect()}
    assert got["x"].problems == problems and got["other"].problems == []
    members = {(r.k, r.id) for r in paged.whole_members(pages, details, "k").collect()}
    assert ("other", 1) in members and ({k for k, _ in members} == {"x", "other"}) is (problems == [])


def fetch(of, n):
    pages = {"three": 3, "six": 6, "none": 0}[of]
    return json.dumps({"total": pages, "pages": pages, "members": [{"id": n, "link": f"https://m/{n}", "name": "m"}]})


def test_paged_source(spark):
    paged.register(spark)
    read = lambda of: spark.read.format("plaza_pages").option("fetch", "tests.test_release:fetch").option("of", of).load()
    pages = read("three")
    assert [r.page for r in pages.collect()] == [3, 2, 1] and pages.rdd.getNumPartitions() == 3
    keyed = pages.withColumn("k", F.lit("x"))
    assert paged.whole_members(keyed, spark.createDataFrame([("x", i) for i in (1, 2, 3)], "k string, id long"), "k").count() == 3
    for of in ("six", "none"):
        with pytest.raises(Exception, match="at most 5"):
            read(of).collect()


# --- reviews and expiry ----------------------------------------------------------


def test_several_reviews_of_a_field(spark):
    table = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id int, name string, n double")
    said = [(1, "name", "override", "x", 1), (1, "name", "reject", None, 2), (1, "n", "override", "5", None), (1, "n", "override", "7", 1), (2, "name", "reject", None, 3), (2, "name", "override", "z", 3), (2, None, "reject", None, 1)]
    reviews = spark.createDataFrame(said, "id int, field string, verdict string, value string, at int")
    assert rows(review.field_rejections(table, reviews, "id", ["name", "n"])) == [(1, None, 7.0, ["name:rejected", "n:overridden"]), (2, None, 3.0, ["name:rejected"])]
    assert review.queue(table, spark.createDataFrame([(1, "a"), (1, "b")], "id int, decision string"), "id").count() == 2
    fixes = spark.createDataFrame([(1, "p", None), (1, "q", ["s"]), (2, "r", ["t"])], "id int, place string, sources array<string>")
    places = spark.createDataFrame([(1, "o", "s"), (2, "o", "s"), (3, "o", None)], "id int, place string, source string")
    assert rows(review.correct_occurrences(places, fixes, ["id"], "place")) == [(1, "q", "s", True), (2, "o", "s", False), (3, "o", None, False)]


def test_no_expiry_without_publication(spark):
    at = F.lit("2024-01-05").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    got = spark.range(1).select(post_expiry(F.lit("x"), none, at).alias("a"), post_expiry(F.lit("x"), F.lit("2024-01-01").cast("timestamp_ntz"), at).cast("string").alias("b")).first()
    assert got.a is None and got.b == "2024-01-05 00:00:00"
