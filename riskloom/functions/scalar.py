"""Formatting, bands and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom import policy


def clip(value: Column, low, high) -> Column:
    """Limit to [low, high]; missing stays missing."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def currency(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 0))


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals, exact ties to even (``format_string`` would round them up)."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def percent(value: Column) -> Column:
    return F.concat(fixed(value * 100, 1), F.lit("%"))


def title_case(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def customer_code(number: Column, width: int = 5) -> Column:
    return F.format_string(f"CUST_%0{width}d", number)


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def review_date(as_of: Column, days: int) -> Column:
    return F.date_add(as_of, days)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def score_band(score: Column) -> Column:
    chain = F
    for low, high, label in policy.SCORE_BANDS:
        chain = chain.when(score.between(low, high), label)
    return chain


def policy_decision(score: Column) -> Column:
    return (F.when(score <= policy.AUTO_APPROVE, "AUTO_APPROVE")
            .when(score <= policy.MANUAL_REVIEW, "MANUAL_REVIEW")
            .when(score >= policy.AUTO_REJECT, "AUTO_REJECT")
            .when(score.isNotNull(), "SENIOR_REVIEW"))


def rating(percentage: Column, steps: list[tuple[int, str]]) -> Column:
    chain = F
    for limit, label in steps:
        chain = chain.when(percentage < limit, label)
    return chain.otherwise(policy.WORST_RATING)


def segment(score: Column) -> Column:
    chain = F
    for name, lowest, _, _ in policy.SEGMENTS[:-1]:
        chain = chain.when(score >= lowest, name)
    return chain.otherwise(policy.SEGMENTS[-1][0])


def segment_yield(score: Column) -> Column:
    chain = F
    for _, lowest, rate, _ in policy.SEGMENTS[:-1]:
        chain = chain.when(score >= lowest, F.lit(rate))
    return chain.otherwise(F.lit(policy.SEGMENTS[-1][2]))


def escalation_level(minutes_open: Column) -> Column:
    """Level from 0; an alert opened after the as-of time has not escalated."""
    steps = F.greatest(F.lit(0), F.floor(minutes_open / policy.ESCALATE_AFTER_MINUTES).cast("int"))
    return F.when(minutes_open.isNotNull(), F.least(F.lit(policy.MAX_ESCALATIONS), steps))


def impact_direction(phi: Column) -> Column:
    return F.when(phi > 0, "increases").otherwise("decreases")


def gauge_status(value: Column, target: Column) -> Column:
    """Traffic light of a gauge, blind to the direction of the metric."""
    return (F.when(value >= target, "success")
            .when(value >= target * policy.GAUGE_WARNING_SHARE, "warning").otherwise("error"))


def accuracy_zone(percentage: Column) -> Column:
    chain = F
    for limit, label in policy.ACCURACY_ZONES[:-1]:
        chain = chain.when(percentage < limit, label)
    return chain.otherwise(policy.ACCURACY_ZONES[-1][1])


def exact_money(value: Column) -> Column:
    """Money as a decimal, so that sums do not depend on the order of rows."""
    return value.cast("decimal(18,4)")
