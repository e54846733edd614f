"""Snapshot reconciliation: what a new snapshot keeps, loses, carries over or holds back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaza.functions.dates import moment
from plaza.operators.sets import first_wins


def future_losses(current: DataFrame, previous: DataFrame, id_col: str, source: str, start: str, status: str, as_of, failed: DataFrame, past_hours: int = 6, future_days: int = 400) -> DataFrame:
    """Previous rows absent from the current snapshot, each with a verdict.

    cancelled, invalid, expired, retained (its source failed) or held. ``failed``
    has the sources that failed.
    """
    now = moment(as_of)
    lost = previous.join(current.select(id_col).distinct(), id_col, "left_anti").join(failed.select(F.col(source), F.lit(True).alias("_failed")).distinct(), source, "left")
    verdict = (
        F.when(F.col(status) == "cancelled", "cancelled")
        .when(F.col(start).isNull() | (F.col(start) > now + F.expr(f"interval {future_days} days")), "invalid")
        .when(F.col(start) < now - F.expr(f"interval {past_hours} hours"), "expired")
        .when(F.col("_failed"), "retained")
        .otherwise("held")
    )
    return lost.withColumn("verdict", verdict).drop("_failed")


def source_drift(current: DataFrame, previous: DataFrame, source: str, snapshot_age_days: float, least: int = 20, newest_days: float = 3, carry_days: float = 7) -> DataFrame:
    """Counts of each source in both snapshots and whether a source that yielded enough and now yields nothing is carried on."""
    count = lambda rows, name: rows.groupBy(source).agg(F.count("*").alias(name))
    both = count(previous, "before").join(count(current, "now"), source, "full").na.fill(0, ["before", "now"])
    gone = (F.col("before") >= least) & (F.col("now") == 0)
    age = F.lit(snapshot_age_days)
    return both.withColumn("state", F.when(gone & (age <= newest_days), "carried").when(gone & (age <= carry_days), "carried_old").when(gone, "dropped").otherwise("normal"))


def retain_failed(current: DataFrame, previous: DataFrame, failures: DataFrame, id_col: str, source: str) -> DataFrame:
    """The current rows and, of failed sources, the previous rows that aren't among them; ``retained`` tells which."""
    kept = previous.join(failures.select(source).distinct(), source, "left_semi").join(current.select(id_col).distinct(), id_col, "left_anti")
    return current.withColumn("retained", F.lit(False)).unionByName(kept.withColumn("retained", F.lit(True)))


def retain_recent(current: DataFrame, previous: DataFrame, id_col: str, seen: str, cutoff) -> DataFrame:
    """The current rows and the previous ones that are new enough and not among them."""
    kept = previous.where(F.col(seen) >= moment(cutoff)).join(current.select(id_col).distinct(), id_col, "left_anti")
    return current.unionByName(kept)


def fact_changes(previous: DataFrame, fresh: DataFrame, observed: DataFrame, id_col: str, evidence: str) -> DataFrame:
    """changed, unchanged, failed or not_attempted for each id of either side; ``observed`` has the state of attempts."""
    a = previous.select(id_col, F.col(evidence).alias("_old"))
    b = fresh.select(id_col, F.col(evidence).alias("_new"))
    rows = a.join(b, id_col, "full").join(observed.select(id_col, "state"), id_col, "left")
    outcome = (
        F.when(F.col("_new").isNotNull(), F.when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed"))
        .when(F.col("state") == "failed", "failed")
        .otherwise("not_attempted")
    )
    return rows.select(id_col, outcome.alias("outcome"), F.coalesce("_new", "_old").alias(evidence))


def history(versions: DataFrame, id_col: str, evidence: str, clock: str) -> DataFrame:
    """Each version whose evidence differs from the one before, with the clock at which the next took over."""
    w = Window.partitionBy(id_col).orderBy(clock)
    new = versions.withColumn("_before", F.lag(evidence).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(evidence))).drop("_before")
    return new.withColumn("valid_to", F.lead(clock).over(w))


def quarantine(rows: DataFrame, archive: DataFrame, id_col: str, guards: list[str]) -> DataFrame:
    """kept, quarantined, or mismatch where a row of the archive's id differs in a guarded field; a mismatch is never removed."""
    marked = archive.select(id_col, *[F.col(g).alias(f"_{g}") for g in guards], F.lit(True).alias("_in"))
    same = F.lit(True)
    for g in guards:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    verdict = F.when(F.col("_in").isNull(), "kept").when(same, "quarantined").otherwise("mismatch")
    return rows.join(marked, id_col, "left").withColumn("verdict", verdict).drop("_in", *[f"_{g}" for g in guards])


def sweep(rows: DataFrame, id_col: str, nested: str, bad: Column, element_bad) -> tuple[DataFrame, DataFrame]:
    """Rows without the bad ones and the bad elements of ``nested``, and what was taken out with its parent's id and the reason."""
    items = rows.where(~bad).select(id_col, F.explode(nested).alias("item"))
    taken = rows.where(bad).select(F.col(id_col), F.lit("row").alias("reason")).unionByName(items.where(element_bad(F.col("item"))).select(F.col(id_col), F.lit("element").alias("reason")))
    return rows.where(~bad).withColumn(nested, F.filter(nested, lambda x: ~element_bad(x))), taken


def replace_source(rows: DataFrame, fresh: DataFrame, source: str, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fresh rows in place of their sources' old ones where they reach the source's floor; the second table has the verdicts."""
    verdicts = fresh.groupBy(source).agg(F.count("*").alias("n")).join(floors.select(source, "floor"), source, "full").na.fill(0, ["n"])
    verdicts = verdicts.withColumn("replaced", F.col("n") >= F.coalesce("floor", F.lit(1)))
    done = verdicts.where("replaced").select(source)
    return rows.join(done, source, "left_anti").unionByName(fresh.join(done, source, "left_semi")), verdicts


def qualification(previous_state: Column, assessed_ok: Column) -> Column:
    """What becomes of a source: accepted, retained on a failed check of an accepted one, disqualified, or pending."""
    return F.when(assessed_ok, "accepted").when(previous_state == "accepted", "retained").when(assessed_ok.isNull(), "pending").otherwise("disqualified")


def carry_forward(current: DataFrame, previous: DataFrame, keys: list[str], seen: str, as_of, days: int) -> DataFrame:
    """Current relations, and verified previous ones of at most ``days``, with their refresh state."""
    old = previous.where(F.col(seen) >= moment(as_of) - F.expr(f"interval {days} days")).join(current.select(*keys).distinct(), keys, "left_anti")
    return current.withColumn("refresh_state", F.lit("current")).unionByName(old.withColumn("refresh_state", F.lit("carried")))


def plan_lanes(lanes: DataFrame, as_of, most: int = 3, retries: int = 3) -> DataFrame:
    """What each lane does next: run, wait for a backoff, reserved, or exhausted; at most ``most`` run, the longest overdue first.

    Needs lane, due, reserved, attempts and last_attempt. Lanes are a fixed registry.
    """
    now = moment(as_of)
    wait = F.when(F.col("attempts") <= 1, F.expr("interval 5 minutes")).otherwise(F.expr("interval 30 minutes"))
    state = (
        F.when(F.col("reserved"), "reserved")
        .when(F.col("attempts") >= retries, "exhausted")
        .when(F.col("due") > now, "not_due")
        .when((F.col("attempts") > 0) & (F.col("last_attempt") + wait > now), "backoff")
        .otherwise("run")
    )
    rows = lanes.withColumn("state", state)
    order = Window.partitionBy("state").orderBy(F.col("due").asc_nulls_first(), "lane")
    return rows.withColumn("state", F.when((F.col("state") == "run") & (F.row_number().over(order) > most), "later").otherwise(F.col("state")))


def overdue(lanes: DataFrame, as_of) -> DataFrame:
    return lanes.where(F.col("due").isNull() | (F.col("due") <= moment(as_of)))


def last_known_good(rows: DataFrame, key: str, clock: str, value: str) -> DataFrame:
    """Each attempt with the value of the last good one up to it."""
    w = Window.partitionBy(key).orderBy(clock).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("known", F.last(value, ignorenulls=True).over(w))


def archive_audit(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """missing, orphan, duplicate or ok for each key of either side."""
    have = actual.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = expected.select(*keys, F.lit(True).alias("_e")).distinct().join(have, keys, "full")
    return rows.select(*keys, F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "orphan").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("state"))


def training_rows(rows: DataFrame, issued, available: str, target: str, target_day) -> DataFrame:
    """Scores that were there before the issue and aren't of the same target."""
    return rows.where((F.col(available) < moment(issued)) & (F.col(target) != target_day))


def lineage(runs: DataFrame, number: str, ok: str, digest: str, needs: str) -> DataFrame:
    """Whether each run's predecessor is the run before, succeeded and has the digest that this one names. Runs are one short sequence per lane."""
    w = Window.partitionBy("lane").orderBy(number)
    exact = (F.lag(number).over(w) == F.col(number) - 1) & F.lag(ok).over(w) & F.lag(digest).over(w).eqNullSafe(F.col(needs))
    return runs.withColumn("resolved", F.coalesce(exact, F.lit(False)))


def access_log(receipts: DataFrame, key: str, order: str, code: str) -> DataFrame:
    """Receipts with their number in their host's sequence and whether one before them suspended the host."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return receipts.withColumns({"number": F.row_number().over(w), "suspended": F.coalesce(F.max(F.col(code) == 429).over(before), F.lit(False))})


def access_sweep(requests: DataFrame, host: str, started: str, ended: str, code: str, denials: tuple[int, ...] = (401, 403, 429)) -> DataFrame:
    """``requests`` with suspended_at, state, and number, in_flight, drained_at of their host.

    A host is suspended when the first denial comes in. States: settled (answered
    by then), denied (that very answer; several at one instant are all denied),
    late (sent before and answered after: its answer counts as evidence only),
    unsettled (sent before, never answered) and refused (begun at the suspension or
    later: it must not have been sent). ``in_flight`` is what the host had open at
    the suspension, by a sweep over starts (+1) and answers (-1); ``drained_at`` is
    when the last of them was answered, null while one is not. ``number`` counts a
    host's requests by start, then answer (null last). Without a denial all
    answered requests are settled and the three are null. A null start is unknown
    and stays out of the sweep: state unknown.
    """
    by_host = Window.partitionBy(host)
    at = F.min(F.when(F.col(code).isin(*denials), F.col(ended))).over(by_host)
    rows = requests.withColumn("suspended_at", at).withColumn("number", F.row_number().over(by_host.orderBy(F.col(started).asc_nulls_last(), F.col(ended).asc_nulls_last(), code)))
    begun, answered = F.col(started) < F.col("suspended_at"), F.col(ended) < F.col("suspended_at")
    state = (
        F.when(F.col(started).isNull(), "unknown").when(F.col("suspended_at").isNull(), F.when(F.col(ended).isNotNull(), "settled").otherwise("unsettled")).when(~begun, "refused")
        .when(F.col(ended).isNull(), "unsettled").when(answered, "settled").when((F.col(ended) == F.col("suspended_at")) & F.col(code).isin(*denials), "denied").otherwise("late")
    )
    rows = rows.withColumn("state", state)
    moves = F.when(begun, 1).otherwise(0) - F.when(begun & answered, 1).otherwise(0)
    waited = F.col("state").isin("late", "unsettled", "denied")
    open_ = F.sum(moves).over(by_host)
    drained = F.when(F.sum((F.col("state") == "unsettled").cast("int")).over(by_host) == 0, F.max(F.when(waited, F.col(ended))).over(by_host))
    return rows.withColumns({"in_flight": F.when(F.col("suspended_at").isNotNull(), open_), "drained_at": F.when(F.col("suspended_at").isNotNull(), drained)})


def newest(rows: DataFrame, keys: list[str], clock: str) -> DataFrame:
    return first_wins(rows, keys, [F.col(clock).desc()])
