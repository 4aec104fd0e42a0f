"""Fairness across protected groups, verdict, alerts, decision log."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import policy
from riskloom.functions import scorecard
from riskloom.operators import audit, fairness, rules
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_audit, on_fairness, on_scored
from riskloom.plans.shared import applications, prepared_scores, rounded, scored
from riskloom.sources import applications as views


PEOPLE = ["default_risk", *policy.PROTECTED_ATTRIBUTES]


def people(spark, sf_dir):
    return scored(spark, sf_dir, *PEOPLE)


def metrics(spark, sf_dir):
    return fairness.bias_metrics(fairness.group_counts(people(spark, sf_dir)))


@query("f1_demographic_parity", on_fairness(
    "SELECT attribute, round(demographic_parity, 6) AS demographic_parity FROM bias"))
def demographic_parity(spark, sf_dir):
    return rounded(metrics(spark, sf_dir).select("attribute", "demographic_parity"),
                   "demographic_parity")


@query("f2_equalized_odds", on_fairness(
    "SELECT attribute, round(equalized_odds, 6) AS equalized_odds FROM bias"))
def equalized_odds(spark, sf_dir):
    return rounded(metrics(spark, sf_dir).select("attribute", "equalized_odds"), "equalized_odds")


@query("f3_calibration", on_fairness(
    "SELECT attribute, round(calibration, 6) AS calibration FROM bias"))
def calibration(spark, sf_dir):
    return rounded(metrics(spark, sf_dir).select("attribute", "calibration"), "calibration")


@query("f3_group_rates", on_fairness("""
    SELECT attribute, member, n, round(approval_rate, 6) AS approval_rate,
      round(true_positive_rate, 6) AS true_positive_rate, round(false_positive_rate, 6) AS false_positive_rate,
      round(calibration_gap, 6) AS calibration_gap FROM rates"""))
def group_rates(spark, sf_dir):
    rates = fairness.group_rates(fairness.group_counts(people(spark, sf_dir)))
    return rounded(rates, "approval_rate", "true_positive_rate", "false_positive_rate",
                   "calibration_gap")


@query("f4_individual_fairness", on_fairness("""
    SELECT round(value, 6) AS individual_fairness FROM overall WHERE metric = 'individual_fairness'"""))
def individual_fairness(spark, sf_dir):
    return rounded(fairness.individual_fairness(scored(spark, sf_dir)), "individual_fairness")


@query("f5_counterfactual_fairness", on_applications("""
    SELECT 'sex' AS attribute, CAST(1 AS DOUBLE) AS counterfactual_fairness FROM applications HAVING count(*) > 0
    UNION ALL SELECT 'marital_status', CAST(1 AS DOUBLE) FROM applications HAVING count(*) > 0
    UNION ALL SELECT 'age', round(1 - count(CASE WHEN age NOT BETWEEN 18 AND 75 AND annual_income >= 25000
        AND loan_amount <= 1000000 AND credit_score BETWEEN 300 AND 850 AND debt_to_income <= CAST(0.5 AS DOUBLE)
        AND employment_length * 12 >= 6 AND inquiries_6mths <= 5 AND credit_history_months >= 12 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) FROM applications"""))
def counterfactual_fairness(spark, sf_dir):
    """Decisions with the attribute changed in the row: the scorecard ignores sex and marital
    status, the eligibility rules do look at age, which becomes the youngest allowed."""
    df = applications(spark, sf_dir, *views.SCORING_COLUMNS, "sex", "marital_status", "age", "inquiries_6mths",
                      "credit_history_months")
    decided = lambda: scorecard.decision(scorecard.risk_score())
    result = fairness.counterfactual_fairness(df, {
        "sex": (decided, F.concat(F.lit("not "), "sex")),
        "marital_status": (decided, F.concat(F.lit("not "), "marital_status")),
        "age": (rules.is_eligible, F.lit(policy.MINIMUM_AGE)),
    })
    return rounded(result, "counterfactual_fairness")


@query("f6_significance", on_fairness("""
    SELECT attribute, degrees_of_freedom, round(chi_square, 6) AS chi_square,
      chi_square > CASE degrees_of_freedom WHEN 1 THEN 3.841459 WHEN 2 THEN 5.991465 WHEN 3 THEN 7.814728
        WHEN 4 THEN 9.487729 WHEN 5 THEN 11.070498 WHEN 6 THEN 12.591587 WHEN 7 THEN 14.067140 END AS significant FROM chi"""))
def significance(spark, sf_dir):
    return rounded(fairness.chi_square(fairness.group_counts(people(spark, sf_dir))), "chi_square")


@query("f7_overall_metrics", on_fairness("""
    SELECT metric, round(value, 6) AS value, coalesce(value >= 0.9, false) AS passed FROM overall"""))
def overall_metrics(spark, sf_dir):
    return rounded(fairness.overall_metrics(prepared_scores(spark, sf_dir, *PEOPLE)), "value")


@query("f7_verdict", on_fairness("""
    SELECT CASE WHEN bool_and(coalesce(value >= 0.9, false)) THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS compliance_status
    FROM overall"""))
def verdict(spark, sf_dir):
    return fairness.verdict(fairness.overall_metrics(prepared_scores(spark, sf_dir, *PEOPLE)))


@query("f8_bias_alerts", on_fairness("""
    SELECT * FROM (SELECT attribute, 'demographic_parity' AS metric, round(1 - demographic_parity, 6) AS gap FROM bias
      UNION ALL SELECT attribute, 'equalized_odds', round(1 - equalized_odds, 6) FROM bias
      UNION ALL SELECT attribute, 'calibration', round(1 - calibration, 6) FROM bias) WHERE gap > 0.1"""))
def bias_alerts(spark, sf_dir):
    return rounded(fairness.bias_alerts(metrics(spark, sf_dir)), "gap")


@query("f9_decision_log", on_scored("""
    SELECT application_id AS audit_id, CAST(application_ts AS DATE) AS date, customer_id AS user_id,
      'Prediction Request' AS activity, 'Model_Scorecard' AS resource,
      CASE WHEN risk_score IS NULL THEN 'Failed' WHEN decision = 'REVIEW' THEN 'Warning' ELSE 'Success' END AS status,
      CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN 'High' WHEN risk_score > CAST(0.3 AS DOUBLE) THEN 'Medium'
        ELSE 'Low' END AS risk_level FROM scored"""))
def decision_log(spark, sf_dir):
    return audit.decision_log(scored(spark, sf_dir, "application_ts", "customer_id")) \
        .drop("timestamp")


@query("f10_status_counts", on_audit("""
    SELECT status, count(*) AS n, count(*) / CAST((SELECT count(*) FROM audit) AS DOUBLE) AS share
    FROM audit GROUP BY status"""))
def status_counts(spark, sf_dir):
    return audit.status_counts(views.audit_trail(spark, sf_dir), "status")
