"""Streams drained to the end; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_audit, on_scored
from riskloom.plans.shared import prepared_scores, rounded
from riskloom.sources import applications as views
from riskloom.streaming import streams


@query("l1_score_stream", on_scored(
    "SELECT application_id, risk_score, risk_category, decision FROM scored"))
def score_stream(spark, sf_dir):
    applications = streams.application_stream(spark, sf_dir, views.SCORING_COLUMNS)
    results = streams.score_stream(applications).select(
        "application_id", "risk_score", "risk_category", "decision")
    return streams.drain_latest(results, "application_id", "scores")


@query("l2_activity_stream", on_audit("""
    SELECT date_trunc('day', "timestamp") AS window_start, activity, count(*) AS n FROM audit GROUP BY 1, 2"""))
def activity_stream(spark, sf_dir):
    counts = streams.activity_counts(streams.audit_stream(spark, sf_dir))
    return streams.drain_complete(counts, "activity")


@query("l3_kpi_alert_stream", on_scored("""
    , w AS (SELECT floor(epoch(application_ts) / 604800) AS k, count(CASE WHEN decision = 'APPROVED' THEN 1 END)
        / CAST(count(*) AS DOUBLE) AS value FROM scored GROUP BY 1)
    SELECT CAST(TIMESTAMP '1970-01-01' + CAST(k * 7 AS INTEGER) * INTERVAL 1 DAY AS DATE) AS week, 'approval_rate' AS kpi,
      round(value, 6) AS value, CASE WHEN value < 0.65 THEN 'error' ELSE 'warning' END AS level
    FROM w WHERE value < 0.70""".strip()))
def kpi_alert_stream(spark, sf_dir):
    """Closed windows from the stream of the decisions, the open ones so far from a batch."""
    decisions = prepared_scores(spark, sf_dir, "application_ts").select("application_ts", "decision")
    closed = streams.closed_alerts(decision_stream(spark, decisions), "alerts")
    return weekly(closed.unionByName(streams.open_alerts(decisions)))


@query("l3_closed_alerts", on_scored("""
    , w AS (SELECT floor(epoch(application_ts) / 604800) AS k, count(CASE WHEN decision = 'APPROVED' THEN 1 END)
        / CAST(count(*) AS DOUBLE) AS value FROM scored GROUP BY 1)
    SELECT CAST(TIMESTAMP '1970-01-01' + CAST(k * 7 AS INTEGER) * INTERVAL 1 DAY AS DATE) AS week, 'approval_rate' AS kpi,
      round(value, 6) AS value, CASE WHEN value < 0.65 THEN 'error' ELSE 'warning' END AS level
    FROM w WHERE value < 0.70 AND (k + 1) * 604800 <= (SELECT epoch(max(application_ts)) - 30 * 86400 FROM scored)""".strip()))
def closed_alerts(spark, sf_dir):
    """Alerts of closed windows only, each once."""
    decisions = prepared_scores(spark, sf_dir, "application_ts").select("application_ts", "decision")
    return weekly(streams.closed_alerts(decision_stream(spark, decisions), "closed-alerts"))


def decision_stream(spark, decisions):
    """The written decisions as a stream of their files."""
    path = decisions.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(decisions.schema).parquet(path)


def weekly(alerts):
    return rounded(alerts, "value").select(F.to_date("window_start").alias("week"), "kpi", "value", "level")


@query("l4_deduplicated_stream", on_audit("SELECT audit_id, activity, status FROM audit"))
def deduplicated_stream(spark, sf_dir):
    """Every event is submitted twice; one of each pair stays."""
    once = streams.audit_stream(spark, sf_dir)
    again = streams.audit_stream(spark, sf_dir)
    kept = streams.without_duplicates(once.union(again), ["audit_id"])
    return streams.drain_append(kept.select("audit_id", "activity", "status"), "submissions")
