"""Streams: reconciliation by micro-batch, and collection state by source."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plaza.operators.sets import reconcile

BACKOFF_MS = 24 * 3_600_000

OUTCOME = "source string, at timestamp, state string, etag string, not_before timestamp"
_ATTEMPT = "at long, status int, etag string, retired boolean"
_KNOWN = "etag string, success long, hold long"
_OUT = "source string, at long, state string, etag string, not_before long"

#: etag, last success and end of the hold of a source of which nothing is known.
NOTHING = (None, None, None)


def advance(known: tuple, attempts: Iterable[tuple], until: int) -> tuple[tuple, list[tuple]]:
    """What is known of a source after ``attempts`` (at, status, etag, retired), and each outcome (at, state, etag, not_before).

    Times are milliseconds. Attempts are taken by time, then status, then tag; a
    hold that ends by an attempt's time, or by ``until``, is released first.
    """
    etag, success, hold = known
    out = []

    def release(by: int) -> None:
        nonlocal hold
        if hold is not None and hold <= by:
            out.append((hold, "released", etag, None))
            hold = None

    for at, status, tag, retired in sorted(attempts, key=lambda x: (x[0], bool(x[3]), x[1] is None, x[1] or 0, x[2] is not None, x[2] or "")):
        release(at)
        if retired:
            said, etag, success = "retired", None, None
        elif hold is not None:
            said = "backoff"
        elif status in (401, 403, 429):
            said, hold = "held", at + BACKOFF_MS
        elif status == 304 or (status == 200 and etag is not None and tag == etag):
            said, success = "unchanged", at
        elif status == 200:
            said, etag, success = "accepted", tag, at
        else:
            said = "failed"
        out.append((at, said, etag, hold))
    release(until)
    return (etag, success, hold), out


class _Collection(StatefulProcessor):
    """Keeps a source's attempts until the watermark has passed them, then takes them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ATTEMPT)
        self.known = handle.getValueState("known", _KNOWN)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for batch in rows:
            some = [
                (int(at), None if pd.isna(status) else int(status), None if pd.isna(tag) else tag, bool(retired))
                for at, status, tag, retired in zip(batch["ms"], batch["status"], batch["etag"], batch["retired"])
            ]
            self.waiting.appendList(some)
            first = min([x[0] for x in some] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for x in self.waiting.get() if self.waiting.exists() else ():
            (due if x[0] <= until else rest).append(tuple(x))
        known, out = advance(tuple(self.known.get()) if self.known.exists() else NOTHING, due, until)
        self.waiting.put(rest) if rest else self.waiting.clear()
        # a retired source without a hold leaves nothing behind
        self.known.clear() if known == NOTHING else self.known.update(known)
        for at in {min((x[0] for x in rest), default=None), known[2]} - {None}:
            self.handle.registerTimer(at)
        if out:
            at, said, etag, hold = zip(*out)
            yield pd.DataFrame({"source": [key[0]] * len(out), "at": at, "state": said, "etag": etag, "not_before": pd.array(hold, "Int64")})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_states(spark: SparkSession):
    """Within it, streams start with the state store that ``collection_states`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def collection_states(attempts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """What each attempt on a source means, from a stream (source, at, status, etag, and retired where there is such a column).

    accepted (new content), unchanged (304, or 200 with the known tag), held
    (401, 403, 429: nothing for 24 hours), backoff (within such a hold), failed;
    released where a hold runs out, and retired where the source was taken off the
    list. A retired source loses its tag and last success; its hold stays until it
    runs out, so that a source put on the list again does not escape it.

    Attempts wait in the state until the watermark, ``late`` behind the latest
    attempt of any source, has passed them, and are then taken by time, in
    milliseconds, then status and tag: batches, files and restarts may deal them
    in any order. Those that come later than that are dropped, as the watermark
    says; those within ``late`` of the stream's end are not yet decided. A task
    holds the attempts of one source that wait. Start the stream within
    ``rocksdb_states``.
    """
    gone = F.coalesce(F.col("retired"), F.lit(False)) if "retired" in attempts.columns else F.lit(False)
    rows = attempts.select("source", F.date_trunc("millisecond", "at").alias("at"), F.col("status").cast("int"), F.col("etag").cast("string"), gone.alias("retired"))
    rows = rows.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    out = rows.groupBy("source").transformWithStateInPandas(_Collection(), _OUT, "Append", "EventTime")
    return out.select("source", F.timestamp_millis("at").alias("at"), "state", "etag", F.timestamp_millis("not_before").alias("not_before"))


def reconcile_batches(target: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch wins over what the table at ``target`` holds.

    A batch writes a new version folder and names it last, so a batch that is
    run again gives the same table.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = f"{target}/v{epoch - 1}"
        try:
            before = spark.read.schema(batch.schema).parquet(old) if epoch else batch.where(F.lit(False))
            merged = reconcile(batch, before, keys, order)
        finally:
            batch.unpersist()
        merged.write.mode("overwrite").parquet(f"{target}/v{epoch}")

    return merge


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with late ones admitted up to the watermark. An addition to the batch operators."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a user without a longer gap, as sessions. An addition to the batch operators."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
