"""Fairness of decisions across protected groups and the compliance verdict.

All group metrics come from one aggregation per (attribute, group); nothing is joined
back to the applications. ``df`` must be scored. The metric formulas are own choices
after the public literature; 1 is fairest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import policy, session

ATTRIBUTES = policy.PROTECTED_ATTRIBUTES
Outcome = Callable[[], Column]
GROUP_METRICS = ["demographic_parity", "equalized_odds", "calibration"]


def group_counts(df: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Decision, label and score sums per (attribute, group): one pass over ``df``.

    The counts are a written table of a few dozen rows, which every metric re-reads.
    """
    facts = df.select(
        *[F.col(a).cast("string").alias(a) for a in attributes],
        (F.col("decision") == policy.DECISIONS[0]).alias("approved"),
        (F.col("default_risk") == 1).alias("bad"),
        F.coalesce(F.col("risk_score") > policy.PROXY_CUT, F.lit(False)).alias("flagged"),
        F.col("risk_score"), F.col("default_risk"),
    )
    keep = ["approved", "bad", "flagged", "risk_score", "default_risk"]
    counts = facts.unpivot(keep, attributes, "attribute", "member") \
        .filter(F.col("member").isNotNull()) \
        .groupBy("attribute", "member").agg(
            F.count("*").alias("n"),
            F.count_if("approved").alias("approved"),
            F.count_if("bad").alias("bad"),
            F.count_if(F.col("bad") & F.col("flagged")).alias("bad_flagged"),
            F.count_if(~F.col("bad") & F.col("flagged")).alias("good_flagged"),
            F.avg("risk_score").alias("mean_score"),
            F.avg("default_risk").alias("bad_rate"))
    return session.materialize(counts, "group-counts")


def group_rates(counts: DataFrame) -> DataFrame:
    return counts.select(
        "attribute", "member", "n",
        F.try_divide("approved", "n").alias("approval_rate"),
        F.try_divide("bad_flagged", "bad").alias("true_positive_rate"),
        F.try_divide(F.col("good_flagged"), F.col("n") - F.col("bad")).alias("false_positive_rate"),
        F.abs(F.col("mean_score") - F.col("bad_rate")).alias("calibration_gap"))


def bias_metrics(counts: DataFrame) -> DataFrame:
    """Demographic parity, equalized odds, calibration and significance per attribute."""
    gap = lambda c: F.max(c) - F.min(c)
    metrics = group_rates(counts).groupBy("attribute").agg(
        F.try_divide(F.min("approval_rate"), F.max("approval_rate")).alias("demographic_parity"),
        (1 - F.greatest(gap("true_positive_rate"), gap("false_positive_rate")))
        .alias("equalized_odds"),
        (1 - F.max("calibration_gap")).alias("calibration"))
    return metrics.join(chi_square(counts), "attribute")  # one row per attribute on both sides


def chi_square(counts: DataFrame) -> DataFrame:
    """Chi-square of group against approval, and whether its p-value is below 5 %."""
    totals = counts.groupBy("attribute").agg(
        F.sum("n").alias("_n"), F.sum("approved").alias("_approved"),
        (F.count("*") - 1).alias("degrees_of_freedom"))
    # Group tables are as small as the protected domains; joined by attribute.
    cells = counts.join(totals, "attribute")
    expected = F.col("n") * F.col("_approved") / F.col("_n")
    off = F.col("approved") - expected
    statistic = F.try_divide(off * off, expected) + F.try_divide(off * off, F.col("n") - expected)
    tested = cells.groupBy("attribute", "degrees_of_freedom").agg(
        F.sum(statistic).alias("chi_square"))
    return tested.withColumn("significant", chi_square_tail(
        F.col("chi_square"), F.col("degrees_of_freedom")) < policy.SIGNIFICANCE)


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """Probability of a larger chi-square value, null below one degree of freedom.

    The power series of the lower incomplete gamma function, whose terms fall faster
    than any power once they pass half the statistic. More than 60 standard deviations
    above the mean the tail is below the precision of a double and given as 0.
    """
    a, h = degrees / 2, statistic / 2
    odd = degrees % 2 == 1
    first = F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
    log_gamma = F.when(odd, F.lit(math.log(math.pi) / 2)).otherwise(F.lit(0.0)) + F.aggregate(
        F.sequence(F.lit(0), (F.ceil(a) - 1).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(first + i))
    terms = (F.greatest(h - a, F.lit(0.0)) + 10 * F.sqrt(h) + 60).cast("int")
    series = F.aggregate(
        F.sequence(F.lit(1), terms), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, i: F.struct((s["term"] * h / (a + i)).alias("term"),
                              (s["total"] + s["term"] * h / (a + i)).alias("total")),
        lambda s: s["total"])
    tail = 1 - F.exp(a * F.ln(h) - h - log_gamma) * series
    return F.when(degrees >= 1, F.when(statistic <= 0, F.lit(1.0))
                  .when(statistic > degrees + 60 * F.sqrt(2 * degrees), F.lit(0.0))
                  .when(statistic.isNotNull(), F.greatest(tail, F.lit(0.0))))


def similarity_cell() -> list[Column]:
    """Cells of similar applicants for the consistency metric."""
    return [
        F.floor(F.col("credit_score") / 50).alias("score_cell"),
        F.floor(F.col("annual_income") / 25000).alias("income_cell"),
        F.floor(F.col("debt_to_income") * 10).alias("debt_cell"),
        F.floor(F.col("loan_amount") / 25000).alias("loan_cell"),
    ]


def individual_fairness(df: DataFrame) -> DataFrame:
    """1 minus the mean distance of an outcome from the mean outcome of its cell.

    With yes/no outcomes a cell of n rows and approval rate p adds 2np(1-p), so the
    cells alone decide; rows never meet their cell again.
    """
    cells = df.groupBy(*similarity_cell()).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("decision") == policy.DECISIONS[0]).alias("approved"))
    p = F.col("approved") / F.col("n")
    return cells.agg(
        (1 - F.try_divide(F.sum(2 * F.col("n") * p * (1 - p)), F.sum("n"))).alias("individual_fairness"))


def counterfactual_fairness(df: DataFrame, flips: dict[str, tuple[Outcome, Column]]) -> DataFrame:
    """Share of unchanged outcomes per attribute: (attribute, counterfactual_fairness).

    ``flips`` gives per attribute an outcome and the attribute's other value. The outcome is
    computed from the row as it is and again from the row with the other value in place.
    """
    for name, (outcome, other) in flips.items():
        df = df.withColumn(f"_{name}_actual", outcome()).withColumns({f"_{name}_kept": F.col(name), name: other}) \
            .withColumn(f"_{name}_flipped", outcome()).withColumn(name, F.col(f"_{name}_kept"))
    row = df.agg(*[
        F.avg(F.col(f"_{name}_actual").eqNullSafe(F.col(f"_{name}_flipped")).cast("double")).alias(name)
        for name in flips])
    return row.unpivot([], list(flips), "attribute", "counterfactual_fairness")


def overall_metrics(df: DataFrame) -> DataFrame:
    """(metric, value, passed): the worst attribute of each group metric and consistency."""
    worst = bias_metrics(group_counts(df)).agg(*[F.min(m).alias(m) for m in GROUP_METRICS]) \
        .unpivot([], GROUP_METRICS, "metric", "value")
    consistency = individual_fairness(df).unpivot([], ["individual_fairness"], "metric", "value")
    return worst.unionByName(consistency) \
        .withColumn("passed", F.coalesce(F.col("value") >= policy.FAIRNESS_PASS, F.lit(False)))


def verdict(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.when(F.bool_and("passed"), "PASS").otherwise("REVIEW_REQUIRED").alias("compliance_status"))


def bias_alerts(metrics: DataFrame) -> DataFrame:
    """(attribute, metric, gap) where the gap to 1 exceeds the limit."""
    return metrics.unpivot("attribute", GROUP_METRICS, "metric", "value") \
        .select("attribute", "metric", (1 - F.col("value")).alias("gap")) \
        .filter(F.col("gap") > policy.BIAS_LIMIT)


def bias_report(df: DataFrame, as_of: str) -> DataFrame:
    """Overall metrics, group analysis and verdict as one JSON document."""
    overall = overall_metrics(df)
    metric_map = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    groups = bias_metrics(group_counts(df)).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("attribute", F.struct(
            *GROUP_METRICS, F.col("significant").alias("statistical_significance"))))))).scalar()
    report = overall.agg(
        metric_map.alias("overall_metrics"),
        F.when(F.bool_and("passed"), "PASS").otherwise("REVIEW_REQUIRED").alias("compliance_status"),
    ).withColumn("group_analysis", groups)
    return report.select(F.to_json(F.struct(
        F.lit(as_of).alias("timestamp"), "overall_metrics", "group_analysis",
        "compliance_status")).alias("document"))
