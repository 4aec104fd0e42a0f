"""Text reports as (line_no, metric, value) rows built from small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import policy
from riskloom.functions import scalar, scorecard
from riskloom.operators import audit, explain, fairness, kpi, profiling, scoring


def whole(value: Column) -> Column:
    return F.format_string("%,d", value)


def with_share(n: Column, total: Column) -> Column:
    return F.concat(whole(n), F.lit(" ("), scalar.percent(F.try_divide(n, total)), F.lit(")"))


def lines(row: DataFrame, entries: list[tuple[str, Column]], start: int = 1) -> DataFrame:
    """One-row aggregate -> numbered report lines."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(start + i).alias("line_no"), F.lit(metric).alias("metric"),
                 value.cast("string").alias("value"))
        for i, (metric, value) in enumerate(entries)])))


def numbered(df: DataFrame, metric: str, value: Column, order: list, start: int) -> DataFrame:
    """Numbered lines from a table of a few rows."""
    position = (F.row_number().over(Window.orderBy(*order)) + (start - 1)).cast("int")
    return df.select(position.alias("line_no"), F.col(metric).alias("metric"),
                     value.cast("string").alias("value"))


def batch_report(scored: DataFrame) -> DataFrame:
    total = F.col("total_records")
    head = lines(scoring.batch_summary(scored), [
        ("Total Records Processed", whole(total)),
        ("Approved Applications", with_share(F.col("approved"), total)),
        ("Applications Requiring Review", with_share(F.col("review"), total)),
        ("Rejected Applications", with_share(F.col("rejected"), total)),
        ("Average Risk Score", scalar.percent(F.col("avg_risk_score"))),
        ("Model Version", F.lit(policy.ANALYSIS_VERSION)),
    ])
    bands = scored.groupBy("risk_category").agg(F.count("*").alias("n"))
    return head.unionByName(numbered(
        bands, "risk_category", F.col("n"), [F.desc("n"), "risk_category"], 7))


def exploration_report(df: DataFrame, columns: list[str],
                       duplicate_columns: list[str] | None = None) -> DataFrame:
    metrics = profiling.quality_metrics(df, duplicate_columns)
    records, cells = F.col("total_records"), F.col("total_records") * F.col("total_features")
    head = lines(metrics, [
        ("Total Records", whole(records)),
        ("Total Features", F.col("total_features")),
        ("Numeric Features", F.col("numeric_features")),
        ("Categorical Features", F.col("categorical_features")),
        ("Missing Values", with_share(F.col("missing_values"), cells)),
        ("Duplicate Records", with_share(F.col("duplicate_records"), records)),
    ])
    stats = profiling.describe(df, columns).withColumn(
        "metric", F.concat_ws(" ", "column", "stat"))
    return head.unionByName(numbered(
        stats, "metric", scalar.fixed(F.col("value"), 2), ["metric"], 7))


def business_report(scored: DataFrame, as_of: str) -> DataFrame:
    """KPIs of the latest month, margin against target, segments, next review."""
    months = kpi.monthly_kpis(scored)
    now = kpi.latest(months, "month", kpi.KPIS)
    target = {name: t for name, _, t, _, _ in policy.KPI_THRESHOLDS}["profit_margin"]
    head = lines(now, [
        (name.replace("_", " ").title(), scalar.percent(F.col(name))) for name in kpi.KPIS
    ] + [
        ("Profit Margin To Target", scalar.percent(F.col("profit_margin") - target)),
        ("Next Review", scalar.review_date(F.lit(as_of).cast("date"), 30).cast("string")),
    ])
    portfolio = kpi.segment_display(kpi.portfolio_by_segment(scored))
    text = F.concat_ws(" | ", F.col("loan_count").cast("string"), "total_amount",
                       "avg_loan_size", "default_rate", "yield_rate", "profit_margin")
    return head.unionByName(numbered(portfolio, "segment", text, ["segment"], 7))


def compliance_report(scored: DataFrame, trail: DataFrame, as_of: str) -> DataFrame:
    """Audit summary, fairness metrics, next review."""
    head = lines(audit.audit_summary(trail), [
        ("Total Activities", F.col("total_activities")),
        ("Success Rate", scalar.percent(F.col("success_rate"))),
        ("High Risk Activities", F.col("high_risk_activities")),
        ("Next Review Date", scalar.review_date(F.lit(as_of).cast("date"), 90).cast("string")),
    ])
    metrics = fairness.overall_metrics(scored).withColumn(
        "metric", scalar.title_case(F.col("metric")))
    return head.unionByName(numbered(
        metrics, "metric", scalar.fixed(F.col("value"), 3), ["metric"], 5))


def explanation_report(df: DataFrame) -> DataFrame:
    """Model type, base value and ranked importances of the scorecard."""
    base = df.agg(F.lit(1).alias("_")).withColumn("_means", explain.mean_contributions(df))
    head = lines(base, [
        ("Type", F.lit("Additive scorecard")),
        ("Features", F.lit(len(policy.SCORE_TERMS))),
        ("Base Value", scalar.fixed(explain.base_value(), 3)),
    ])
    ranked = explain.global_importance(df)
    return head.unionByName(numbered(
        ranked, "feature", scalar.fixed(F.col("importance"), 4), ["rank"], 4))


def assessment_summaries(scored: DataFrame, id_column: str = "application_id") -> DataFrame:
    """The text summary of every application."""
    factors = [F.concat(F.lit(f"• {label}: "), scalar.percent(term))
               for label, term in scorecard.contributions()]
    advice = F.transform(scorecard.recommendations(F.col("risk_score")),
                         lambda r: F.concat(F.lit("• "), r))
    decision = scorecard.decision(F.col("risk_score"), policy.INDIVIDUAL_DECISIONS)
    return scored.select(id_column, F.concat_ws(
        "\n",
        F.lit("Credit Risk Analysis Summary"),
        F.concat(F.lit("Customer: "), F.col("employment_status"), F.lit(" | Age: "), F.col("age")),
        F.concat(F.lit("Risk Score: "), scalar.percent(F.col("risk_score")), F.lit(" ("),
                 F.col("risk_category"), F.lit(")")),
        F.concat(F.lit("Decision: "), decision),
        F.lit("Key Factors:"), *factors,
        F.lit("Recommendations:"), advice,
    ).alias("summary"))
