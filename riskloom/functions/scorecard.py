"""The additive scorecard as column expressions.

Missing input gives a missing score: ``least`` and ``greatest`` skip nulls, so each
cap is guarded and null travels through the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom import policy


def guarded(value: Column, expression: Column) -> Column:
    return F.when(value.isNotNull(), expression)


def _risk_share(column: str, value: Column) -> Column:
    """Unweighted risk of one input, 0 for none."""
    if column == "credit_score":
        return guarded(value, 1 - F.least(value / policy.MAX_CREDIT_SCORE, F.lit(1.0)))
    if column == "annual_income":
        gap = (policy.INCOME_REFERENCE - value) / policy.INCOME_REFERENCE
        return guarded(value, F.greatest(F.lit(0.0), gap))
    if column == "employment_length":
        gap = (policy.EMPLOYMENT_REFERENCE - value) / policy.EMPLOYMENT_REFERENCE
        return guarded(value, F.greatest(F.lit(0.0), gap))
    if column == "loan_amount":
        return guarded(value, F.least(value / policy.LOAN_REFERENCE, F.lit(1.0)))
    return value


def contribution_at(column: str, value: Column) -> Column:
    """The weighted term of one input at a given value."""
    weight = {c: w for c, _, w in policy.SCORE_TERMS}[column]
    return _risk_share(column, value) * weight


def contributions() -> list[tuple[str, Column]]:
    """(label, weighted term) in evaluation order."""
    return [(label, contribution_at(column, F.col(column)))
            for column, label, _ in policy.SCORE_TERMS]


def uncapped_score(without: str | None = None) -> Column:
    """Sum of the terms, of all inputs or of all but one."""
    total = F.lit(0.0)
    for column, _, _ in policy.SCORE_TERMS:
        if column != without:
            total = total + contribution_at(column, F.col(column))
    return total


def capped(total: Column) -> Column:
    return guarded(total, F.least(total, F.lit(1.0)))


def risk_score() -> Column:
    return capped(uncapped_score())


def contribution_struct() -> Column:
    return F.struct(*[term.alias(label) for label, term in contributions()])


def risk_category(score: Column) -> Column:
    chain = F
    for low, high, label in policy.RISK_BANDS:
        chain = chain.when(score.between(low, high), label)
    return chain.otherwise(policy.FALLBACK_BAND)


def decision(score: Column, labels: list[str] = policy.DECISIONS) -> Column:
    approved, review, rejected = labels
    return (F.when(score <= policy.APPROVE_UP_TO, approved)
            .when(score <= policy.REVIEW_UP_TO, review).otherwise(rejected))


def risk_level(probability: Column) -> Column:
    return (F.when(probability > policy.REVIEW_UP_TO, "High")
            .when(probability > policy.APPROVE_UP_TO, "Medium").otherwise("Low"))


def recommendations(score: Column) -> Column:
    """Texts of the rules that fire, in rule order."""
    fired = F.array(
        F.when(F.col("credit_score") < 650, policy.RECOMMEND_SCORE),
        F.when(F.col("debt_to_income") > 0.4, policy.RECOMMEND_DEBT),
        F.when(F.col("credit_utilization") > 0.3, policy.RECOMMEND_UTILIZATION),
        F.when(F.col("employment_length") < 2, policy.RECOMMEND_EMPLOYMENT),
        F.when(score > policy.REVIEW_UP_TO, policy.RECOMMEND_COSIGNER),
        F.when(score > policy.REVIEW_UP_TO, policy.RECOMMEND_DOCUMENTS),
    )
    kept = F.array_compact(fired)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(policy.RECOMMEND_NONE)))


def default_risk_proxy() -> Column:
    """1 when the weighted proxy exceeds the cut, 0 otherwise (also when unknown)."""
    score_w, debt_w, utilization_w, delinquency_w, inquiry_w = policy.PROXY_WEIGHTS
    proxy = (
        (1 - F.col("credit_score") / policy.MAX_CREDIT_SCORE) * score_w
        + F.col("debt_to_income") * debt_w
        + F.col("credit_utilization") * utilization_w
        + F.col("delinquencies_2yrs") / policy.PROXY_DELINQUENCY_SCALE * delinquency_w
        + F.col("inquiries_6mths") / policy.PROXY_INQUIRY_SCALE * inquiry_w
    )
    return F.coalesce((proxy > policy.PROXY_CUT).cast("int"), F.lit(0))
