"""Collection states: the order of attempts does not depend on how they are dealt."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from plaza.streaming.runs import NOTHING, advance, collection_states, rocksdb_states

DAY0 = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "source string, at timestamp, status int, etag string, retired boolean"


def ms(moment):
    return int(moment.timestamp() * 1000)


def made_up(seed, n=200, sources="abc"):
    draw = random.Random(seed)
    return [
        (draw.choice(sources), DAY0 + timedelta(hours=draw.randint(0, 400), microseconds=draw.randint(0, 5)), draw.choice([200, 200, 304, 429, 500, None]), draw.choice(["x", "y", None]), draw.random() < 0.03)
        for _ in range(n)
    ]


def wanted(rows):
    until = max(ms(r[1]) for r in rows)
    out = []
    for source in {r[0] for r in rows}:
        _, said = advance(NOTHING, [(ms(r[1]), *r[2:]) for r in rows if r[0] == source], until)
        out += [(source, at, state, tag, hold) for at, state, tag, hold in said]
    return sorted(out, key=str)


def run(spark, folder, parts, late="0 seconds", each=10_000):
    """The outcomes of a stream that gets ``parts`` one after another, started anew for each."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", each)
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*")
            with rocksdb_states(spark):
                query = collection_states(stream, late).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = spark.read.parquet(f"{folder}/out").collect()
    return sorted([(r.source, ms(r.at.astimezone()), r.state, r.etag, r.not_before and ms(r.not_before.astimezone())) for r in found], key=str)


def test_attempts_of_one_source_by_time():
    hour = 3_600_000
    known, out = advance(NOTHING, [(26 * hour, 200, "a", False), (0, 429, None, False), (5 * hour, 200, "b", False), (30 * hour, 304, None, False), (31 * hour, 500, None, False), (32 * hour, 200, "a", False)], 40 * hour)
    assert [x[:2] for x in out] == [(0, "held"), (5 * hour, "backoff"), (24 * hour, "released"), (26 * hour, "accepted"), (30 * hour, "unchanged"), (31 * hour, "failed"), (32 * hour, "unchanged")]
    assert known == ("a", 32 * hour, None)


def test_a_retired_source_keeps_its_hold():
    hour = 3_600_000
    known, out = advance(("t", 0, None), [(hour, 403, None, False), (2 * hour, None, None, True), (3 * hour, 200, "t", False)], 4 * hour)
    assert [x[1] for x in out] == ["held", "retired", "backoff"] and known == (None, None, 25 * hour)
    assert advance(known, [], 25 * hour) == (NOTHING, [(25 * hour, "released", None, None)])
    assert advance(("t", 0, None), [(1, None, None, True), (2, 200, "t", False)], 2)[1][1][1] == "accepted"  # nothing is remembered without a hold


@pytest.mark.parametrize("each", [5, 10_000])
def test_falling_time_in_small_batches(spark, tmp_path, each):
    rows = [("s", DAY0 + timedelta(days=k + 7 if k else 7), 200, "one", False) for k in range(15)][::-1]
    got = run(spark, str(tmp_path), [rows], each=each)
    assert got == wanted(rows)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])][0] == "accepted" and sum(r[2] == "unchanged" for r in got) == 14


def test_any_deal_gives_the_same_rows(spark, tmp_path):
    rows = made_up(4)
    assert run(spark, str(tmp_path), [rows], each=7) == wanted(rows)


def test_restarts_and_late_parts(spark, tmp_path):
    """Parts up to the allowed lateness out of order, each read by a stream started again."""
    rows = sorted(made_up(6), key=lambda r: r[1])
    end = ("z", DAY0 + timedelta(hours=1000), 200, "e", False)  # moves the watermark past all others
    parts = [[r for r in rows if r[1] < DAY0 + timedelta(hours=200)][::-1], [r for r in rows if r[1] >= DAY0 + timedelta(hours=200)][::-1], [end]]
    random.Random(1).shuffle(parts[0])
    moved = [r for r in parts[0] if r[1] > DAY0 + timedelta(hours=150)][:20]
    parts[0] = [r for r in parts[0] if r not in moved]
    parts[1] = [*parts[1], *moved]
    lateness = timedelta(hours=400)
    got = run(spark, str(tmp_path), parts, late="400 hours")
    want = [r for r in wanted([*rows, end]) if r[0] != "z"]
    until = ms(end[1] - lateness)
    assert [r for r in got if r[0] != "z"] == [r for r in want if r[1] <= until]
