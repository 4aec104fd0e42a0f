"""Population stability of features and performance gates over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import policy, session
from riskloom.operators import ranking

BINS = 10
FLOOR = 1e-6  # own choice: an empty bin counts as this share


def bin_limits(reference: DataFrame, features: list[str]) -> DataFrame:
    """(feature, q): the exact deciles of the reference rows; pass a written table."""
    return ranking.column_quantiles(reference, features, [i / BINS for i in range(1, BINS)]) \
        .withColumnRenamed("column", "feature")


def _binned(df: DataFrame, features: list[str], key: Column, limits: DataFrame) -> DataFrame:
    """(key, feature, bin) of every present value; bin is the number of limits below it."""
    values = df.select(key.alias("key"), *[F.col(c).cast("double").alias(c) for c in features]) \
        .unpivot("key", features, "feature", "value").filter(F.col("value").isNotNull())
    # One row per feature named by the caller.
    located = values.join(F.broadcast(limits), "feature")
    bin_number = F.lit(0)
    for i in range(BINS - 1):
        bin_number = bin_number + F.when(F.col("q")[i] < F.col("value"), 1).otherwise(0)
    return located.select("key", "feature", bin_number.alias("bin"))


def daily_bins(df: DataFrame, features: list[str], ts: str, limits: DataFrame) -> DataFrame:
    """(day, feature, bin, n): the rows of each day by bin.

    A table for keeping: counts of new days are appended, those of a day that comes in
    parts are added, and any two windows are compared without another scan. Rows
    without a time have a null day.
    """
    return _binned(df, features, F.to_date(ts), limits).groupBy(F.col("key").alias("day"), "feature", "bin") \
        .agg(F.count("*").alias("n"))


def _stability(per_bin: DataFrame) -> DataFrame:
    """PSI and verdict per feature from (feature, bin, reference, current)."""
    whole = Window.partitionBy("feature")  # at most ten bins a feature
    shares = per_bin.select("feature", "bin", *[
        F.greatest(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(FLOOR)).alias(c)
        for c in ("reference", "current")])
    p, q = F.col("current"), F.col("reference")
    return shares.groupBy("feature").agg(F.sum((p - q) * F.log(p / q)).alias("psi")) \
        .withColumn("drifted", F.col("psi") > policy.DRIFT_LIMIT)


def stability_between(bins: DataFrame, reference: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """PSI per feature between two windows of days (first and last included) of ``daily_bins``.

    A feature without a row in one of the windows counts every bin of it as the least share.
    """
    inside = [F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in (reference, current)]
    return _stability(bins.groupBy("feature", "bin").agg(
        F.coalesce(F.sum(F.when(inside[0], F.col("n"))), F.lit(0)).alias("reference"),
        F.coalesce(F.sum(F.when(inside[1], F.col("n"))), F.lit(0)).alias("current")))


def population_stability(df: DataFrame, features: list[str], ts: str, cut: str) -> DataFrame:
    """PSI per feature: rows from ``cut`` on against the earlier reference rows.

    Bins are the exact deciles of the reference. Rows are counted per bin before any
    shuffle. Rows without a time belong to neither side. Pass a written table.
    """
    recent = F.col(ts) >= F.lit(cut).cast("timestamp")
    limits = session.measured(bin_limits(df.filter(~recent), features), "limits")
    return _stability(_binned(df, features, recent, limits).groupBy("feature", "bin").agg(
        F.count_if(~F.col("key")).alias("reference"), F.count_if("key").alias("current")))


def performance_gate(current: DataFrame, reference: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Current against reference metric per model: gate passed, degradation alert."""
    before = reference.select("model", F.col(metric).alias("reference"))
    joined = current.select("model", F.col(metric).alias("current")).join(before, "model")
    return joined.select(
        "model", "reference", "current",
        (F.col("current") >= policy.PERFORMANCE_LIMIT).alias("gate_passed"),
        (F.col("reference") - F.col("current") > policy.DEGRADATION_LIMIT).alias("degraded"))


def retrain_due(registry: DataFrame, as_of: str) -> DataFrame:
    """Days since training per model and whether retraining is due."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("trained_at"))
    return registry.withColumn("age_days", age) \
        .withColumn("retrain_due", F.col("age_days") > policy.RETRAIN_AFTER_DAYS)
