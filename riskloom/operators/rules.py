"""Business rules: eligibility, purpose limits, policy decisions, retention, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import policy
from riskloom.functions import scalar


def eligibility_rules() -> dict[str, Column]:
    """Rule name -> passes. An unknown value does not pass."""
    low, high = policy.CREDIT_SCORE_RANGE
    rules = {
        "age": F.col("age").between(policy.MINIMUM_AGE, policy.MAXIMUM_AGE),
        "income": F.col("annual_income") >= policy.MINIMUM_INCOME,
        "loan_amount": F.col("loan_amount") <= policy.MAXIMUM_LOAN,
        "credit_score": F.col("credit_score").between(low, high),
        "debt_to_income": F.col("debt_to_income") <= policy.MAXIMUM_DEBT_RATIO,
        "employment_history": F.col("employment_length") * 12 >= policy.MINIMUM_EMPLOYMENT_MONTHS,
        "inquiries": F.col("inquiries_6mths") <= policy.MAXIMUM_INQUIRIES,
        "credit_history": F.col("credit_history_months") >= policy.MINIMUM_CREDIT_HISTORY_MONTHS,
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def eligibility(df: DataFrame) -> DataFrame:
    """Append ``reasons`` (failed rules in order) and ``eligible``."""
    failed = F.array_compact(F.array(*[
        F.when(~ok, name) for name, ok in eligibility_rules().items()]))
    return df.withColumn("reasons", failed).withColumn("eligible", F.size("reasons") == 0)


def is_eligible() -> Column:
    """Whether all eligibility rules pass."""
    passed = F.lit(True)
    for ok in eligibility_rules().values():
        passed = passed & ok
    return passed


def product(purpose: Column) -> Column:
    chain = F
    for name, target in policy.PURPOSE_PRODUCT.items():
        chain = chain.when(purpose == name, target)
    return chain.otherwise(policy.DEFAULT_PRODUCT)


def purpose_limit_check(df: DataFrame) -> DataFrame:
    """Append the product, its maximum amount and whether the loan stays within it."""
    limits = policy.purpose_limits(df.sparkSession).select("product", "max_amount")
    # Five rows, fixed by the policy module.
    return df.withColumn("product", product(F.col("loan_purpose"))) \
        .join(F.broadcast(limits), "product", "left") \
        .withColumn("within_limit", F.coalesce(F.col("loan_amount") <= F.col("max_amount"), F.lit(True)))


def factor_breaches() -> list[tuple[str, float, Column]]:
    """(factor, weight, breached) of the five-factor risk; unknown inputs do not breach."""
    on_time = 1 - F.try_divide(F.col("delinquencies_2yrs"), F.col("line_count"))
    value = {
        "income_debt_ratio": lambda t: F.col("debt_to_income") > t,
        "credit_history_length": lambda t: F.col("credit_history_months") < t,
        "payment_history": lambda t: on_time < t,
        "credit_utilization": lambda t: F.col("credit_utilization") > t,
        "recent_inquiries": lambda t: F.col("inquiries_6mths") > t,
    }
    return [(name, weight, F.coalesce(value[name](threshold), F.lit(False)))
            for name, weight, threshold in policy.RISK_FACTORS]


def five_factor_risk(df: DataFrame) -> DataFrame:
    """Append one flag per factor and the weighted sum of the breached ones."""
    factors = factor_breaches()
    total = F.lit(0.0)
    for _, weight, breached in factors:
        total = total + F.when(breached, F.lit(weight)).otherwise(F.lit(0.0))
    return df.withColumns({f"{name}_breach": breached for name, _, breached in factors}
                          | {"factor_risk": total})


def within_retention(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    return df.filter(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), policy.RETENTION_DAYS))


def prioritised_alerts(alerts: DataFrame, order: list[str]) -> DataFrame:
    """Alerts with their level's priority, most urgent first."""
    levels = F.broadcast(policy.alert_priorities(alerts.sparkSession))  # four rows
    return alerts.join(levels, "level", "left").orderBy(F.desc("priority"), *order)


def escalation(alerts: DataFrame, opened: str, as_of: str) -> DataFrame:
    """Append minutes open at ``as_of`` and the escalation level."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(opened)
    return alerts.withColumn("minutes_open", F.floor(seconds / 60)) \
        .withColumn("escalation_level", scalar.escalation_level(F.col("minutes_open")))


def pseudonymise(df: DataFrame, salt: str, id_column: str = "customer_id",
                 age: str | None = None, ip: str | None = None) -> DataFrame:
    """Salted hash instead of the id, age as a decade, the address cut to its /16 prefix."""
    changed = {id_column: F.sha2(F.concat(F.lit(salt), F.col(id_column)), 256)}
    if age:
        changed[age] = F.concat((F.floor(F.col(age) / 10) * 10).cast("string"), F.lit("s"))
    if ip:
        changed[ip] = F.concat(F.substring_index(F.col(ip), ".", 2), F.lit(".0.0"))
    return df.withColumns(changed)
