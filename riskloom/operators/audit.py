"""Audit-trail aggregates, status shares and the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom import policy
from riskloom.functions import scalar, scorecard
from riskloom.operators import profiling


def daily_activity(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Activities, success rate and high-risk activities in one row."""
    return audit.agg(
        F.count("*").alias("total_activities"),
        F.avg((F.col("status") == "Success").cast("double")).alias("success_rate"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_activities"))


def error_alerts(audit: DataFrame) -> DataFrame:
    """Days on which more than the accepted share of activities failed: (date, n, failed, error_rate)."""
    daily = audit.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "Failed").alias("failed"))
    return daily.withColumn("error_rate", F.col("failed") / F.col("n")).filter(F.col("error_rate") > policy.SYSTEM_ERROR_LIMIT)


def status_share(df: DataFrame, column: str, good: str) -> DataFrame:
    """How many rows carry the good status, and the rate: (good, total, rate_pct)."""
    counts = df.agg(F.count_if(F.col(column) == good).alias("good"), F.count("*").alias("total"))
    return counts.withColumn("rate_pct", F.try_divide(F.col("good") * 100.0, F.col("total")))


def status_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per status and their share of all rows."""
    counts = profiling.value_counts(df, column)
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def top_activities(audit: DataFrame, n: int = 5) -> DataFrame:
    return profiling.value_counts(audit, "activity", n)


def recent_entries(audit: DataFrame, n: int = 10) -> DataFrame:
    return audit.orderBy(F.desc("timestamp"), "audit_id").limit(n).select(
        "audit_id", "activity", "user_id", "status",
        scalar.minute_stamp(F.col("timestamp")).alias("at"))


def recent_decisions(df: DataFrame, n: int = 5) -> DataFrame:
    """The latest scored applications with their amounts as text."""
    return df.orderBy(F.desc("application_ts"), F.desc("application_id")).limit(n).select(
        "application_id", "decision", scalar.minute_stamp(F.col("application_ts")).alias("at"),
        scalar.currency(F.col("loan_amount")).alias("amount"))


def decision_log(df: DataFrame) -> DataFrame:
    """Audit rows written by the scoring job, one per scored application."""
    return df.select(
        F.col("application_id").alias("audit_id"),
        F.col("application_ts").alias("timestamp"),
        F.to_date("application_ts").alias("date"),
        F.col("customer_id").alias("user_id"),
        F.lit("Prediction Request").alias("activity"),
        F.lit("Model_Scorecard").alias("resource"),
        F.when(F.col("risk_score").isNull(), "Failed")
        .when(F.col("decision") == "REVIEW", "Warning").otherwise("Success").alias("status"),
        scorecard.risk_level(F.col("risk_score")).alias("risk_level"))
