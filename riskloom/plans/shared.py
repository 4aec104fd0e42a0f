"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom import session
from riskloom.operators import evaluation, scoring
from riskloom.sources import applications as views

AS_OF = "2001-08-01"
AUDIT_AS_OF = "2024-01-31"
PROFILE_COLUMNS = [
    "age", "annual_income", "credit_score", "loan_amount", "employment_length",
    "debt_to_income", "credit_utilization", "delinquencies_2yrs", "inquiries_6mths",
    "open_accounts", "total_accounts", "default_risk",
]
CATEGORY_COLUMNS = ["loan_purpose", "home_ownership", "employment_status"]
EXPLORER_COLUMNS = ["customer_id", *PROFILE_COLUMNS[:-1], *CATEGORY_COLUMNS, "default_risk"]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on row order in their last bits; six places do not."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def applications(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return views.applications(spark, sf_dir, list(columns) or None)


def prepared(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The view as a written table, for operators that pass over it more than once:
    one join of the base tables and one narrow table instead of a join per pass."""
    return session.materialize(applications(spark, sf_dir, *columns), "applications")


def prepared_scores(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return session.materialize(scored(spark, sf_dir, *more), "scores")


def scored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Scored applications with the scoring columns and ``more``."""
    columns = [*views.SCORING_COLUMNS, *[c for c in more if c not in views.SCORING_COLUMNS]]
    return scoring.score(views.applications(spark, sf_dir, columns))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecard, debt ratio and utilization as three competing scores."""
    return evaluation.predictions(scored(spark, sf_dir, "default_risk"), {
        "scorecard": "risk_score", "debt": "debt_to_income",
        "utilization": "credit_utilization"})
