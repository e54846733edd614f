"""Forecast aggregation and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaza.functions.numbers import lcg, quantile


def family_mean(rows: DataFrame, target: list[str], least: int = 2) -> DataFrame:
    """Mean of rows for a model, of models for a family, of families for a target; targets with too few families go.

    Needs family, model and value.
    """
    models = rows.groupBy(*target, "family", "model").agg(F.avg("value").alias("value"))
    families = models.groupBy(*target, "family").agg(F.avg("value").alias("value"), F.count("*").alias("models"))
    out = families.groupBy(*target).agg(F.avg("value").alias("mean"), F.count("*").alias("families"), F.sum("models").alias("models"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.where(F.col("families") >= least)


def weighted_quantiles(rows: DataFrame, target: list[str], value: str, weight: str, ps: dict[str, float]) -> DataFrame:
    """The smallest value whose cumulative share of weight reaches each p.

    Equal values are summed first, so a running sum never depends on their order.
    """
    sums = rows.groupBy(*target, value).agg(F.sum(weight).alias("w"))
    run = Window.partitionBy(*target).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = sums.groupBy(*target).agg(F.sum("w").alias("total"))
    cum = sums.withColumn("cum", F.sum("w").over(run)).join(total, target)
    return cum.groupBy(*target).agg(*[F.min(F.when(F.col("cum") / F.col("total") >= p - 1e-12, F.col(value))).alias(n) for n, p in ps.items()])


def member_weights(rows: DataFrame, target: list[str]) -> DataFrame:
    """``rows`` with weight 1 / (families x models of the family x rows of the model), so a family is one vote."""
    n = lambda keys, counted, name: rows.groupBy(*keys).agg((F.count_distinct(counted) if counted else F.count("*")).alias(name))
    out = rows.join(n(target, "family", "f"), target).join(n([*target, "family"], "model", "m"), [*target, "family"]).join(n([*target, "family", "model"], None, "r"), [*target, "family", "model"])
    return out.withColumn("weight", 1 / (F.col("f") * F.col("m") * F.col("r"))).drop("f", "m", "r")


def headline(points: DataFrame, target: list[str], signature: str, expected: int = 3) -> DataFrame:
    """Mean over the core points where all are there under one signature."""
    out = points.groupBy(*target).agg(F.avg("value").alias("headline"), F.count("*").alias("points"), F.count_distinct(signature).alias("signatures"))
    return out.where((F.col("points") == expected) & (F.col("signatures") == 1)).select(*target, "headline")


def scores(rows: DataFrame, groups: list[list[str]]) -> DataFrame:
    """MAE, RMSE, bias and Brier score overall and by each grouping. Needs error, and brier (null if no probability)."""
    names = sorted({c for g in groups for c in g})
    measures = [F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"), F.avg("brier").alias("brier")]
    return rows.groupingSets([[F.col(c) for c in g] for g in groups], *[F.col(c) for c in names]).agg(*measures)


def shrinkage(rows: DataFrame, key: list[str], day: str, prior: int = 20, least: int = 20, most: float = 2.0) -> DataFrame:
    """Bias correction from day means: -mean x d / (d + prior), within bounds, from ``least`` days on."""
    days = rows.groupBy(*key, day).agg(F.avg("error").alias("e"))
    out = days.groupBy(*key).agg(F.avg("e").alias("mean"), F.count("*").alias("days")).where(F.col("days") >= least)
    shift = -F.col("mean") * F.col("days") / (F.col("days") + prior)
    return out.withColumn("correction", F.greatest(F.lit(-most), F.least(F.lit(most), shift)))


def bootstrap(days: DataFrame, key: str, seed: int = 1729, draws: int = 1000, block: int = 3, least_days: int = 30, least_blocks: int = 10) -> DataFrame:
    """Interval of the mean daily difference by resampling blocks of consecutive days; null under ``least_days`` days or ``least_blocks`` blocks.

    ``days`` (key, day number, difference) is a day series, a few hundred rows a key.
    """

    def one(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("day")
        day, diff = series["day"].tolist(), series["difference"].tolist()
        blocks = [diff[i : i + block] for i in range(len(day) - block + 1) if day[i + block - 1] == day[i] + block - 1]
        name = series[key].iloc[0]
        if len(diff) < least_days or len(blocks) < least_blocks:
            return pd.DataFrame([(name, None, None, len(blocks))], columns=[key, "low", "high", "blocks"])
        need = -(-len(diff) // block)
        picks = lcg(seed, draws * need)
        means = []
        for d in range(draws):
            drawn = [x for p in picks[d * need : (d + 1) * need] for x in blocks[p * len(blocks) >> 32]][: len(diff)]
            means.append(sum(drawn) / len(drawn))
        return pd.DataFrame([(name, quantile(means, 0.025), quantile(means, 0.975), len(blocks))], columns=[key, "low", "high", "blocks"])

    kind = dict(days.dtypes)[key]
    return days.groupBy(key).applyInPandas(one, f"{key} {kind}, low double, high double, blocks int")
