"""Segments, KPIs, alerts, daily and weekly series, audit aggregates."""

from __future__ import annotations

from riskloom.operators import audit, evaluation, kpi
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_audit, on_portfolio, on_predictions, on_scored
from riskloom.plans.shared import applications, predictions, rounded, scored
from riskloom.sources import applications as views

AMOUNT_COLUMNS = ["application_ts", "loan_amount", "credit_score", "default_risk"]


def months(spark, sf_dir):
    return kpi.monthly_kpis(scored(spark, sf_dir, "application_ts", "default_risk"))


def portfolio(spark, sf_dir):
    return kpi.portfolio_by_segment(
        applications(spark, sf_dir, "credit_score", "loan_amount", "default_risk"))


@query("a16_daily_activity", on_audit("""
    SELECT CAST("timestamp" AS DATE) AS date, count(*) AS n FROM audit GROUP BY 1"""))
def daily_activity(spark, sf_dir):
    return audit.daily_activity(views.audit_trail(spark, sf_dir))


@query("a17_audit_summary", on_audit("""
    SELECT count(*) AS total_activities,
      count(CASE WHEN status = 'Success' THEN 1 END) / CAST(count(*) AS DOUBLE) AS success_rate,
      count(CASE WHEN risk_level = 'High' THEN 1 END) AS high_risk_activities FROM audit"""))
def audit_summary(spark, sf_dir):
    return audit.audit_summary(views.audit_trail(spark, sf_dir))


@query("a17_error_alerts", on_audit("""
    SELECT date, n, failed, failed / CAST(n AS DOUBLE) AS error_rate FROM (
      SELECT CAST("timestamp" AS DATE) AS date, count(*) AS n, count(CASE WHEN status = 'Failed' THEN 1 END) AS failed FROM audit GROUP BY 1)
    WHERE failed / CAST(n AS DOUBLE) > 0.01"""))
def error_alerts(spark, sf_dir):
    return audit.error_alerts(views.audit_trail(spark, sf_dir))


@query("a18_compliance_rate", on_audit("""
    SELECT count(CASE WHEN status = 'Success' THEN 1 END) AS good, count(*) AS total,
      count(CASE WHEN status = 'Success' THEN 1 END) * 100.0 / CAST(count(*) AS DOUBLE) AS rate_pct FROM audit"""))
def compliance_rate(spark, sf_dir):
    return audit.status_share(views.audit_trail(spark, sf_dir), "status", "Success")


@query("a19_positive_rate", on_applications(
    "SELECT sum(default_risk) / CAST(count(*) AS DOUBLE) AS positive_rate FROM applications"))
def positive_rate(spark, sf_dir):
    return evaluation.positive_rate(applications(spark, sf_dir, "default_risk"))


@query("a20_portfolio_by_segment", on_portfolio("""
    SELECT segment, loan_count, total_amount, round(total_amount / loan_count, 6) AS avg_loan_size,
      round(default_rate, 6) AS default_rate, yield_rate,
      round((yield_rate * total_amount - default_rate * total_amount) / (yield_rate * total_amount), 6) AS profit_margin
    FROM portfolio"""))
def portfolio_by_segment(spark, sf_dir):
    return rounded(portfolio(spark, sf_dir), "avg_loan_size", "default_rate", "profit_margin")


@query("k6_segment_display", on_portfolio("""
    SELECT segment, loan_count, format('${:,}', CAST(round_even(total_amount, 0) AS BIGINT)) AS total_amount,
      format('${:,}', CAST(round_even(total_amount / loan_count, 0) AS BIGINT)) AS avg_loan_size,
      printf('%.1f%%', default_rate * 100) AS default_rate, printf('%.1f%%', yield_rate * 100) AS yield_rate,
      printf('%.1f%%', (yield_rate * total_amount - default_rate * total_amount) / (yield_rate * total_amount) * 100) AS profit_margin
    FROM portfolio"""))
def segment_display(spark, sf_dir):
    return kpi.segment_display(portfolio(spark, sf_dir))


@query("a21_monthly_kpis", on_portfolio("""
    SELECT month, scored, approved, approved_amount, approval_rate, default_rate,
      round(profit_margin, 6) AS profit_margin, round(portfolio_growth, 6) AS portfolio_growth FROM kpis"""))
def monthly_kpis(spark, sf_dir):
    return rounded(months(spark, sf_dir), "profit_margin", "portfolio_growth")


@query("a22_daily_summary", on_scored("""
    SELECT CAST(application_ts AS DATE) AS date, count(CASE WHEN decision <> 'REVIEW' THEN 1 END) AS processed,
      count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS approved,
      count(CASE WHEN decision = 'REVIEW' THEN 1 END) AS pending,
      count(CASE WHEN decision = 'REJECTED' THEN 1 END) AS rejected FROM scored GROUP BY 1"""))
def daily_summary(spark, sf_dir):
    return kpi.daily_summary(scored(spark, sf_dir, "application_ts"))


@query("a22_weekly_summary", on_scored("""
    SELECT CAST(date_trunc('week', application_ts) AS DATE) + 6 AS week, count(*) AS applications,
      count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS approvals FROM scored GROUP BY 1"""))
def weekly_summary(spark, sf_dir):
    return kpi.weekly_summary(scored(spark, sf_dir, "application_ts"))


@query("k1_kpi_alerts", on_portfolio("""
    SELECT month, kpi, round(value, 6) AS value, level,
      CASE level WHEN 'error' THEN 'Critical: ' ELSE 'Warning: ' END || CASE kpi WHEN 'approval_rate' THEN 'Approval Rate'
        WHEN 'default_rate' THEN 'Default Rate' WHEN 'profit_margin' THEN 'Profit Margin' ELSE 'Portfolio Growth' END
        || ' at ' || printf('%.1f%%', value * 100) AS message
    FROM leveled WHERE level IS NOT NULL"""))
def kpi_alerts(spark, sf_dir):
    return rounded(kpi.kpi_alerts(months(spark, sf_dir)), "value")


@query("k2_all_clear", on_portfolio("""
    SELECT month, count(level) AS alerts, CASE WHEN count(level) = 0
      THEN 'All KPIs are performing within target ranges' END AS message FROM leveled GROUP BY month"""))
def all_clear(spark, sf_dir):
    return kpi.all_clear(months(spark, sf_dir))


@query("k3_kpi_gauges", on_portfolio("""
    SELECT month, kpi, round(value, 6) AS value, target, CASE WHEN value >= target THEN 'success'
        WHEN value >= target * 0.8 THEN 'warning' ELSE 'error' END AS gauge_status,
      CASE WHEN direction = 'low' AND value <= target OR direction = 'high' AND value >= target THEN 'on_target'
        ELSE coalesce(level, 'below_target') END AS kpi_status FROM leveled"""))
def kpi_gauges(spark, sf_dir):
    return rounded(kpi.kpi_gauges(months(spark, sf_dir)).drop("gap"), "value")


@query("k4_target_gap", on_portfolio("""
    SELECT month, kpi, round(value - target, 6) AS gap FROM leveled"""))
def target_gap(spark, sf_dir):
    return rounded(kpi.kpi_gauges(months(spark, sf_dir)).select("month", "kpi", "gap"), "gap")


@query("k5_accuracy_zone", on_predictions("""
    SELECT model, round(accuracy * 100, 6) AS accuracy_pct, CASE WHEN accuracy * 100 < 50 THEN 'error'
      WHEN accuracy * 100 < 80 THEN 'warning' ELSE 'success' END AS zone FROM model_metrics"""))
def accuracy_zone(spark, sf_dir):
    zones = evaluation.accuracy_zones(evaluation.confusion(predictions(spark, sf_dir)))
    return rounded(zones, "accuracy_pct")


_DAILY = """
    , daily AS (SELECT CAST(application_ts AS DATE) AS date, sum(CAST(loan_amount AS DECIMAL(18,4))) AS total_loans,
        sum(CAST(loan_amount AS DECIMAL(18,4)) * CAST(yield_rate AS DECIMAL(4,2))) AS total_revenue,
        sum(CASE WHEN default_risk = 1 THEN CAST(loan_amount AS DECIMAL(18,4)) ELSE 0 END) AS default_losses
      FROM segmented GROUP BY 1),
    running AS (SELECT date, CAST(sum(total_loans) OVER w AS DOUBLE) AS total_loans,
        CAST(sum(total_revenue) OVER w AS DOUBLE) AS total_revenue,
        CAST(sum(default_losses) OVER w AS DOUBLE) AS default_losses
      FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
METRICS = ["total_loans", "total_revenue", "default_losses"]


def running(spark, sf_dir):
    return kpi.running_totals(
        kpi.daily_amounts(applications(spark, sf_dir, *AMOUNT_COLUMNS)), "date", METRICS)


@query("w1_running_totals", on_portfolio(_DAILY.strip() + """
    SELECT date, total_loans, total_revenue,
           default_losses FROM running"""))
def running_totals(spark, sf_dir):
    return running(spark, sf_dir)


@query("w2_latest_totals", on_portfolio(_DAILY.strip() + """
    SELECT date, total_loans, total_revenue,
      default_losses FROM running ORDER BY date DESC LIMIT 1"""))
def latest_totals(spark, sf_dir):
    return kpi.latest(running(spark, sf_dir), "date", METRICS)


@query("w3_monthly_change", on_portfolio("""
    SELECT month, approved, CAST(approved - lag(approved) OVER (ORDER BY month) AS BIGINT) AS delta,
      round(approved / CAST(nullif(lag(approved) OVER (ORDER BY month), 0) AS DOUBLE) - 1, 6) AS relative_change FROM kpis"""))
def monthly_change(spark, sf_dir):
    change = kpi.period_change(months(spark, sf_dir).select("month", "approved"), "month", "approved")
    return rounded(change, "relative_change")


@query("w3_daily_change", on_scored("""
    , d AS (SELECT CAST(application_ts AS DATE) AS date, count(CASE WHEN decision <> 'REVIEW' THEN 1 END) AS processed
        FROM scored GROUP BY 1)
    SELECT date, processed, processed - lag(processed) OVER (ORDER BY date) AS delta,
      round(processed / CAST(nullif(lag(processed) OVER (ORDER BY date), 0) AS DOUBLE) - 1, 6) AS relative_change FROM d""".strip()))
def daily_change(spark, sf_dir):
    daily = kpi.daily_summary(scored(spark, sf_dir, "application_ts"))
    return rounded(kpi.period_change(daily, "date", "processed"), "relative_change")


@query("t1_top_activities", on_audit("""
    SELECT activity, count(*) AS n FROM audit GROUP BY activity ORDER BY n DESC, activity LIMIT 5"""))
def top_activities(spark, sf_dir):
    return audit.top_activities(views.audit_trail(spark, sf_dir), 5)


@query("t2_recent_entries", on_audit("""
    SELECT audit_id, activity, user_id, status, strftime("timestamp", '%Y-%m-%d %H:%M') AS at FROM audit
    ORDER BY "timestamp" DESC, audit_id LIMIT 10"""))
def recent_entries(spark, sf_dir):
    return audit.recent_entries(views.audit_trail(spark, sf_dir), 10)
