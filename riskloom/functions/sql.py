"""The scorecard as SQL functions; Catalyst inlines them, so no function call remains."""

from __future__ import annotations

from pyspark.sql import SparkSession

from riskloom import policy


def register(spark: SparkSession) -> None:
    """Create temporary functions risk_score, risk_category, risk_decision."""
    weight = {column: w for column, _, w in policy.SCORE_TERMS}
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION risk_score(
            credit_score DOUBLE, annual_income DOUBLE, debt_to_income DOUBLE,
            employment_length DOUBLE, loan_amount DOUBLE, credit_utilization DOUBLE)
        RETURNS DOUBLE
        RETURN CASE WHEN credit_score IS NOT NULL AND annual_income IS NOT NULL
                     AND debt_to_income IS NOT NULL AND employment_length IS NOT NULL
                     AND loan_amount IS NOT NULL AND credit_utilization IS NOT NULL
        THEN least(
            (1 - least(credit_score / {policy.MAX_CREDIT_SCORE}, 1D)) * {weight['credit_score']}D
          + greatest(0D, ({policy.INCOME_REFERENCE} - annual_income) / {policy.INCOME_REFERENCE})
              * {weight['annual_income']}D
          + debt_to_income * {weight['debt_to_income']}D
          + greatest(0D, ({policy.EMPLOYMENT_REFERENCE} - employment_length)
                         / {policy.EMPLOYMENT_REFERENCE}) * {weight['employment_length']}D
          + least(loan_amount / {policy.LOAN_REFERENCE}, 1D) * {weight['loan_amount']}D
          + credit_utilization * {weight['credit_utilization']}D, 1D) END""")
    bands = " ".join(f"WHEN score BETWEEN {low}D AND {high}D THEN '{label}'"
                     for low, high, label in policy.RISK_BANDS)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION risk_category(score DOUBLE) RETURNS STRING
        RETURN CASE {bands} ELSE '{policy.FALLBACK_BAND}' END""")
    approved, review, rejected = policy.DECISIONS
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION risk_decision(score DOUBLE) RETURNS STRING
        RETURN CASE WHEN score <= {policy.APPROVE_UP_TO}D THEN '{approved}'
                    WHEN score <= {policy.REVIEW_UP_TO}D THEN '{review}' ELSE '{rejected}' END""")
