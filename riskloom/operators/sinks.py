"""Writers. Every sink is a directory of part files written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions import scalar
from riskloom.operators import scoring


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.option("ignoreNullFields", False).json(path)
    return path


def write_documents(documents: DataFrame, path: str, column: str = "document") -> str:
    """One JSON document per line."""
    documents.select(column).write.text(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """A text report in line order; reports are a few dozen lines, hence one file."""
    line = F.concat(F.lit("- "), F.col("metric"), F.lit(": "), F.coalesce("value", F.lit("")))
    report.orderBy("line_no").select(line.alias("line")).coalesce(1).write.text(path)
    return path


def write_results_and_summary(scored: DataFrame, path: str) -> tuple[str, str]:
    """Two tables side by side: all results, and the summary as (metric, value)."""
    scored.write.parquet(f"{path}/results")
    summary = summary_table(scored.sparkSession.read.parquet(f"{path}/results"))
    summary.write.parquet(f"{path}/summary")
    return f"{path}/results", f"{path}/summary"


def summary_table(scored: DataFrame) -> DataFrame:
    row = scoring.batch_summary(scored)
    entries = [
        ("Total Records", F.col("total_records").cast("string")),
        ("Approved", F.col("approved").cast("string")),
        ("Review Required", F.col("review").cast("string")),
        ("Rejected", F.col("rejected").cast("string")),
        ("Average Risk Score", scalar.percent(F.col("avg_risk_score"))),
    ]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in entries])))


def write_decision_log(log: DataFrame, path: str) -> str:
    """One folder per month, so that date filters read only what they need.

    The rebalance hint splits a month that is too large for one task and packs the
    small ones, so files come out near the advised size whatever the skew.
    """
    by_month = log.withColumn("month", F.date_format("date", "yyyy-MM"))
    by_month.hint("rebalance", F.col("month")).write.mode("append") \
        .partitionBy("month").parquet(path)
    return path
