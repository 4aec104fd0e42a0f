"""Portfolio segments, monthly KPIs, alerts, daily and weekly series, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import policy
from riskloom.functions import scalar

KPIS = [name for name, *_ in policy.KPI_THRESHOLDS]


def _margin(amount: Column, default_rate: Column, yield_rate: Column) -> Column:
    return yield_rate * amount - default_rate * amount


def _segment_totals(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("segment", scalar.segment(F.col("credit_score"))) \
        .groupBy(*keys, "segment").agg(
            F.count("*").alias("loan_count"),
            F.sum(scalar.exact_money(F.col("loan_amount"))).alias("_amount"),
            F.avg("default_risk").alias("default_rate"),
            F.max(scalar.segment_yield(F.col("credit_score"))).alias("yield_rate"))


def portfolio_by_segment(df: DataFrame) -> DataFrame:
    """Loan count, total, average size, default rate, yield and margin per segment."""
    totals = _segment_totals(df).withColumn("total_amount", F.col("_amount").cast("double"))
    margin = _margin(F.col("total_amount"), F.col("default_rate"), F.col("yield_rate"))
    return totals.select(
        "segment", "loan_count", "total_amount",
        (F.col("total_amount") / F.col("loan_count")).alias("avg_loan_size"),
        "default_rate", "yield_rate",
        F.try_divide(margin, F.col("yield_rate") * F.col("total_amount")).alias("profit_margin"),
    )


def segment_display(portfolio: DataFrame) -> DataFrame:
    """Money and rates as text."""
    return portfolio.select(
        "segment", "loan_count",
        *[scalar.currency(F.col(c)).alias(c) for c in ("total_amount", "avg_loan_size")],
        *[scalar.percent(F.col(c)).alias(c)
          for c in ("default_rate", "yield_rate", "profit_margin")])


def segment_advice(portfolio: DataFrame) -> DataFrame:
    advice = policy.segments(portfolio.sparkSession).select("segment", "advice")
    return portfolio.join(F.broadcast(advice), "segment", "left")  # four rows


def monthly_kpis(df: DataFrame) -> DataFrame:
    """Approval rate, default rate, margin and growth per month; ``df`` must be scored.

    The growth window runs over one row per month.
    """
    approved = F.col("decision") == policy.DECISIONS[0]
    by_segment = df.withColumns({
        "month": F.trunc("application_ts", "month"),
        "segment": scalar.segment(F.col("credit_score")),
    }).groupBy("month", "segment").agg(
        F.count("*").alias("scored"),
        F.count_if(approved).alias("approved"),
        F.sum(F.when(approved, F.col("default_risk"))).alias("bad"),
        F.sum(F.when(approved, scalar.exact_money(F.col("loan_amount")))).alias("approved_amount"),
        F.sum(scalar.exact_money(F.col("loan_amount"))).alias("amount"),
        F.avg("default_risk").alias("segment_default"),
        F.max(scalar.segment_yield(F.col("credit_score"))).alias("segment_yield"))
    amount = F.col("amount").cast("double")
    months = by_segment.groupBy("month").agg(
        F.sum("scored").alias("scored"),
        F.sum("approved").alias("approved"),
        F.sum("bad").alias("bad"),
        F.sum("approved_amount").cast("double").alias("approved_amount"),
        F.sum(_margin(amount, F.col("segment_default"), F.col("segment_yield"))).alias("margin"),
        F.sum(F.col("segment_yield") * amount).alias("interest"))
    previous = F.lag("approved_amount").over(Window.orderBy("month"))
    return months.select(
        "month", "scored", "approved", "approved_amount",
        scalar.share(F.col("approved"), F.col("scored")).alias("approval_rate"),
        scalar.share(F.col("bad"), F.col("approved")).alias("default_rate"),
        scalar.share(F.col("margin"), F.col("interest")).alias("profit_margin"),
        (F.try_divide(F.col("approved_amount"), previous) - 1).alias("portfolio_growth"))


def with_thresholds(rows: DataFrame) -> DataFrame:
    """Thresholds onto (period, kpi, value) rows; four threshold rows."""
    return rows.join(F.broadcast(policy.kpi_thresholds(rows.sparkSession)), "kpi")


def kpi_rows(kpis: DataFrame, period: str = "month") -> DataFrame:
    """(period, kpi, value) with the thresholds of each KPI."""
    return with_thresholds(kpis.unpivot(period, KPIS, "kpi", "value"))


def alert_level(value: Column, direction: Column, warning: Column, critical: Column) -> Column:
    """error beyond critical, warning beyond warning, null otherwise (strict comparisons)."""
    def worse(limit):
        return F.when(direction == "low", value > limit).otherwise(value < limit)
    return F.when(worse(critical), "error").when(worse(warning), "warning")


def row_level() -> Column:
    return alert_level(F.col("value"), F.col("direction"), F.col("warning"), F.col("critical"))


def alerts_of(rows: DataFrame, period: str) -> DataFrame:
    """Alert rows with level and message from (period, kpi, value)."""
    prefix = F.when(F.col("level") == "error", "Critical").otherwise("Warning")
    message = F.concat(prefix, F.lit(": "), scalar.title_case(F.col("kpi")), F.lit(" at "),
                       scalar.percent(F.col("value")))
    return with_thresholds(rows).withColumn("level", row_level()) \
        .filter(F.col("level").isNotNull()) \
        .select(period, "kpi", "value", "level", message.alias("message"))


def kpi_alerts(kpis: DataFrame, period: str = "month") -> DataFrame:
    return alerts_of(kpis.unpivot(period, KPIS, "kpi", "value"), period)


def all_clear(kpis: DataFrame, period: str = "month") -> DataFrame:
    """Periods without any alert, with the all-clear text."""
    rows = kpi_rows(kpis, period).withColumn("level", row_level())
    return rows.groupBy(period).agg(F.count("level").alias("alerts")).select(
        period, "alerts", F.when(F.col("alerts") == 0, policy.ALL_CLEAR).alias("message"))


def kpi_gauges(kpis: DataFrame, period: str = "month") -> DataFrame:
    """Gauge colour, direction-aware status and gap to target."""
    rows = kpi_rows(kpis, period)
    on_target = F.when(F.col("direction") == "low", F.col("value") <= F.col("target")) \
        .otherwise(F.col("value") >= F.col("target"))
    return rows.select(
        period, "kpi", "value", "target",
        scalar.gauge_status(F.col("value"), F.col("target")).alias("gauge_status"),
        F.when(on_target, "on_target").otherwise(F.coalesce(row_level(), F.lit("below_target")))
        .alias("kpi_status"),
        (F.col("value") - F.col("target")).alias("gap"))


def daily_summary(df: DataFrame) -> DataFrame:
    """Per day: processed (approved and rejected), approved, pending, rejected."""
    approved, review, rejected = [F.count_if(F.col("decision") == d) for d in policy.DECISIONS]
    return df.groupBy(F.to_date("application_ts").alias("date")).agg(
        (approved + rejected).alias("processed"), approved.alias("approved"),
        review.alias("pending"), rejected.alias("rejected"))


def weekly_summary(df: DataFrame) -> DataFrame:
    """Applications and approvals per Monday-to-Sunday week, labelled by its Sunday."""
    week = F.date_add(F.to_date(F.date_trunc("week", "application_ts")), 6)
    return df.groupBy(week.alias("week")).agg(
        F.count("*").alias("applications"),
        F.count_if(F.col("decision") == policy.DECISIONS[0]).alias("approvals"))


def daily_amounts(df: DataFrame) -> DataFrame:
    """Daily loans and interest revenue as exact decimals."""
    amount = scalar.exact_money(F.col("loan_amount"))
    revenue = amount * scalar.segment_yield(F.col("credit_score")).cast("decimal(4,2)")
    losses = F.when(F.col("default_risk") == 1, amount).otherwise(F.lit(0).cast("decimal(18,4)"))
    return df.groupBy(F.to_date("application_ts").alias("date")).agg(
        F.sum(amount).alias("total_loans"), F.sum(revenue).alias("total_revenue"),
        F.sum(losses).alias("default_losses"))


def running_totals(daily: DataFrame, date: str, metrics: list[str]) -> DataFrame:
    """Running total per metric over a daily series.

    The unpartitioned window is bounded by the number of days, not of applications.
    """
    so_far = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(date, *[F.sum(m).over(so_far).cast("double").alias(m) for m in metrics])


def latest(series: DataFrame, date: str, metrics: list[str]) -> DataFrame:
    """The values of the last date in one row."""
    return series.agg(F.max(date).alias(date),
                      *[F.max_by(m, date).alias(m) for m in metrics])


def period_change(series: DataFrame, date: str, metric: str) -> DataFrame:
    """Difference and relative change against the previous period of a short series."""
    previous = F.lag(metric).over(Window.orderBy(date))
    return series.select(
        date, metric, (F.col(metric) - previous).alias("delta"),
        (F.try_divide(F.col(metric), previous) - 1).alias("relative_change"))
