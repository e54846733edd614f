"""Forecasts against what came true: scoring, pairing of two forecasters, and what a later issue may learn from.

A target is a place, a variable with its unit and event, and an exact interval;
a case is a target with the time of issue. Everything joins on these as equal
columns, so a day of one place makes no product; what doesn't match is kept and
counted with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = ["location", "variable", "unit", "event", "valid_start", "valid_end"]
CASE = [*TARGET, "issued_at"]
#: What a score must share with an issue to be learnt from.
SCOPE = ["algorithm", "registry", "locations", "versions"]


def _keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` also as keys that are never null."""
    return rows.withColumns({f"_k_{c}": F.struct(F.col(c).isNull().alias("none"), F.col(c)) for c in columns})


def score(forecasts: DataFrame, truths: DataFrame, scored_at: Column) -> DataFrame:
    """Each forecast (CASE, prediction, any others) with truth, error, receipt and state.

    ``truths``: TARGET, value, available_at, retrieved_at, receipt. A truth fits the
    very interval of its target and no other. States, the first that holds:
    issued_late (not issued before the target ended), truth_missing (none, or its
    value is null), truth_ambiguous (several for the target: a revision is not
    chosen), truth_early (available before the target ended or retrieved before
    available), truth_unavailable (retrieved after ``scored_at``), scored. Only
    scored rows have truth and error. Null columns of a target equal each other.
    """
    on = [f"_k_{c}" for c in TARGET]
    said = _keys(truths, TARGET).groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_{c}") for c in ("value", "available_at", "retrieved_at", "receipt")])
    rows = _keys(forecasts, TARGET).join(said, on, "left")
    no = lambda test: ~F.coalesce(test, F.lit(False))
    state = (
        F.when(no(F.col("issued_at") < F.col("valid_end")), "issued_late").when(F.col("_n") > 1, "truth_ambiguous").when(F.col("_value").isNull(), "truth_missing")
        .when(no((F.col("_available_at") >= F.col("valid_end")) & (F.col("_retrieved_at") >= F.col("_available_at"))), "truth_early")
        .when(no(F.col("_retrieved_at") <= scored_at), "truth_unavailable").otherwise("scored")
    )
    rows = rows.withColumn("state", state)
    known = lambda value: F.when(F.col("state") == "scored", value)
    return rows.select(*forecasts.columns, known(F.col("_value")).alias("truth"), known(F.col("prediction") - F.col("_value")).alias("error"), known(F.col("_receipt")).alias("receipt"), "state")


def pair(challenger: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row of each case of scored rows (CASE, truth, error, receipt) on either side: challenger and baseline error and state.

    paired, unpaired_challenger, unpaired_baseline, duplicate (a side has the case
    several times) or truth_differs (both have it, by other receipts or values);
    errors are null but for paired cases.
    """
    on = [f"_k_{c}" for c in CASE]

    def side(rows: DataFrame, name: str) -> DataFrame:
        one = [F.first(c).alias(f"{name}_{c}") for c in ("truth", "error", "receipt")]
        return _keys(rows, CASE).groupBy(*on).agg(F.count("*").alias(f"{name}_n"), *one)

    rows = side(challenger, "a").join(side(baseline, "b"), on, "full")
    state = (
        F.when(F.greatest("a_n", "b_n") > 1, "duplicate").when(F.col("b_n").isNull(), "unpaired_challenger").when(F.col("a_n").isNull(), "unpaired_baseline")
        .when(~(F.col("a_receipt").eqNullSafe(F.col("b_receipt")) & F.col("a_truth").eqNullSafe(F.col("b_truth"))), "truth_differs").otherwise("paired")
    )
    rows = rows.withColumn("state", state)
    known = lambda c: F.when(F.col("state") == "paired", F.col(c))
    return rows.select(*[F.col(f"_k_{c}")[c].alias(c) for c in CASE], known("a_error").alias("challenger_error"), known("b_error").alias("baseline_error"), "state")


def paired_report(pairs: DataFrame) -> DataFrame:
    """One row: cases by state, days, mean absolute errors of both sides, and the mean over days of the mean difference of absolute errors."""
    gain = F.abs("challenger_error") - F.abs("baseline_error")
    days = pairs.where("state = 'paired'").groupBy(F.to_date("valid_start").alias("day")).agg(F.avg(gain).alias("delta"))
    days = days.agg(F.count("*").alias("days"), F.avg("delta").alias("day_mean_delta"))
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("paired", "unpaired_challenger", "unpaired_baseline", "duplicate", "truth_differs")]
    return pairs.agg(*counts, F.avg(F.abs("challenger_error")).alias("challenger_mae"), F.avg(F.abs("baseline_error")).alias("baseline_mae")).crossJoin(days)  # two tables of one row


def eligible(scores: DataFrame, issues: DataFrame, issue: str) -> DataFrame:
    """(issue, score) for each score that an issue may learn from, without a look at what was not known when it was made.

    ``issues``: issue, issued_at, lead_hours, TARGET, SCOPE. ``scores``: score,
    CASE, SCOPE, versions_known, available_at, retrieved_at, scored_at. A score fits
    if its model versions are known; if its scope, place, variable, unit and event
    are the issue's; if truth was available and retrieved and the score made before
    the issue; if its target ended before the issue and shares neither start nor
    end with the issue's; and if it was issued as long before its target. A score
    or a case that stands twice fits nothing, as one of them revises the other.
    """
    same = ["location", "variable", "unit", "event", *SCOPE]
    twice = lambda rows, keys: _keys(rows, keys).groupBy(*[f"_k_{c}" for c in keys]).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    once = _keys(scores.where("versions_known"), list(dict.fromkeys(["score", *CASE, *SCOPE])))
    lost = lambda keys: once.join(twice(scores, keys), [f"_k_{c}" for c in keys], "left_anti")
    once = lost(["score"])
    once = once.join(twice(scores, CASE), [f"_k_{c}" for c in CASE], "left_anti")
    lead = F.timestamp_diff("MICROSECOND", "s_issued_at", "s_valid_start") / 3_600_000_000
    names = ["score", "valid_start", "valid_end", "issued_at", "available_at", "retrieved_at", "scored_at"]
    once = once.select(*[f"_k_{c}" for c in same], *[F.col(c).alias(f"s_{c}") for c in names]).withColumn("_lead", lead)
    asked = _keys(issues, same).withColumn("_lead", F.col("lead_hours").cast("double"))
    # the lead is among the keys, so an issue meets the scores of its own lead only
    met = asked.join(once, [*[f"_k_{c}" for c in same], "_lead"])
    before = F.greatest("s_available_at", "s_retrieved_at", "s_scored_at", "s_valid_end") < F.col("issued_at")
    known = F.col("s_available_at").isNotNull() & F.col("s_retrieved_at").isNotNull() & F.col("s_scored_at").isNotNull()
    other = (F.col("s_valid_start") != F.col("valid_start")) & (F.col("s_valid_end") != F.col("valid_end"))
    return met.where(before & known & other).select(issue, F.col("s_score").alias("score"))
