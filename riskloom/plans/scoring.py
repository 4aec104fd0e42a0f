"""Scorecard, batch summary, filters and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import policy
from riskloom.functions import scalar, sql as sql_functions
from riskloom.operators import audit, rules, scoring
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_audit, on_phi, on_scored
from riskloom.plans.shared import applications, rounded, scored
from riskloom.sources import applications as views


@query("p1_risk_score", on_scored(
    "SELECT application_id, risk_score, risk_category, decision FROM scored"))
def risk_score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "application_id", "risk_score", "risk_category", "decision")


@query("u1_sql_functions", on_scored(
    "SELECT application_id, risk_score, risk_category, decision FROM scored"))
def risk_score_in_sql(spark, sf_dir):
    """The same scorecard through the registered SQL functions."""
    sql_functions.register(spark)
    return spark.sql("""
        SELECT application_id, risk_score, risk_category(risk_score) AS risk_category,
               risk_decision(risk_score) AS decision
        FROM (SELECT application_id, risk_score(credit_score, annual_income, debt_to_income,
                  employment_length, loan_amount, credit_utilization) AS risk_score
              FROM {rows})""", rows=applications(spark, sf_dir, *views.SCORING_COLUMNS))


@query("p2_contributions", on_scored("""
    SELECT application_id, 'Credit Score' AS feature, c1 AS contribution FROM scored
    UNION ALL SELECT application_id, 'Annual Income', c2 FROM scored
    UNION ALL SELECT application_id, 'Debt-to-Income', c3 FROM scored
    UNION ALL SELECT application_id, 'Employment Length', c4 FROM scored
    UNION ALL SELECT application_id, 'Loan Amount', c5 FROM scored
    UNION ALL SELECT application_id, 'Credit Utilization', c6 FROM scored"""))
def contributions(spark, sf_dir):
    return scoring.contributions_long(applications(spark, sf_dir, *views.SCORING_COLUMNS))


@query("p3_risk_category", on_scored("""
    SELECT risk_category, count(*) AS n, min(risk_score) AS lowest, max(risk_score) AS highest
    FROM scored GROUP BY risk_category"""))
def risk_category(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("risk_category").agg(
        F.count("*").alias("n"), F.min("risk_score").alias("lowest"),
        F.max("risk_score").alias("highest"))


@query("p4_batch_decision", on_scored("""
    SELECT decision, count(*) AS n, count(risk_score) AS with_score FROM scored GROUP BY decision"""))
def batch_decision(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("decision").agg(
        F.count("*").alias("n"), F.count("risk_score").alias("with_score"))


@query("p5_individual_decision", on_scored("""
    SELECT application_id, CASE WHEN risk_score <= CAST(0.3 AS DOUBLE) THEN 'APPROVED'
        WHEN risk_score <= CAST(0.6 AS DOUBLE) THEN 'REVIEW REQUIRED' ELSE 'HIGH RISK' END AS individual_decision
    FROM scored"""))
def individual_decision(spark, sf_dir):
    return scoring.individual_decisions(scored(spark, sf_dir)) \
        .select("application_id", "individual_decision")


def _recommendation_sql() -> str:
    return f"""
    SELECT application_id, coalesce(nullif(concat_ws('|',
        CASE WHEN credit_score < 650 THEN '{policy.RECOMMEND_SCORE}' END,
        CASE WHEN debt_to_income > CAST(0.4 AS DOUBLE) THEN '{policy.RECOMMEND_DEBT}' END,
        CASE WHEN credit_utilization > CAST(0.3 AS DOUBLE) THEN '{policy.RECOMMEND_UTILIZATION}' END,
        CASE WHEN employment_length < 2 THEN '{policy.RECOMMEND_EMPLOYMENT}' END,
        CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN '{policy.RECOMMEND_COSIGNER}' END,
        CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN '{policy.RECOMMEND_DOCUMENTS}' END), ''),
        '{policy.RECOMMEND_NONE}') AS recommendations
    FROM scored"""


@query("p6_recommendations", on_scored(_recommendation_sql()))
def recommendations(spark, sf_dir):
    return scoring.with_recommendations(scored(spark, sf_dir)).select(
        "application_id", F.concat_ws("|", "recommendations").alias("recommendations"))


@query("p7_risk_level", on_scored("""
    SELECT application_id, CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN 'High'
        WHEN risk_score > CAST(0.3 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS risk_level FROM scored"""))
def risk_level(spark, sf_dir):
    return scoring.individual_decisions(scored(spark, sf_dir)).select("application_id", "risk_level")


@query("p8_default_risk", on_applications("SELECT application_id, default_risk FROM applications"))
def default_risk(spark, sf_dir):
    return applications(spark, sf_dir, "application_id", "default_risk")


@query("p9_clip", on_applications("""
    SELECT application_id, least(greatest(annual_income, 30000), 100000) AS annual_income,
           CASE WHEN debt_to_income IS NOT NULL THEN least(greatest(debt_to_income, CAST(0.2 AS DOUBLE)),
             CAST(0.6 AS DOUBLE)) END AS debt_to_income FROM applications"""))
def clip(spark, sf_dir):
    return applications(spark, sf_dir, "application_id", "annual_income", "debt_to_income") \
        .withColumns({"annual_income": scalar.clip(F.col("annual_income"), 30000.0, 100000.0),
                      "debt_to_income": scalar.clip(F.col("debt_to_income"), 0.2, 0.6)})


@query("p11_formatting", on_scored("""
    SELECT application_id, format('${:,}', CAST(round_even(loan_amount, 0) AS BIGINT)) AS loan,
           printf('%.1f%%', debt_to_income * 100) AS debt FROM scored"""))
def formatting(spark, sf_dir):
    return applications(spark, sf_dir, "application_id", "loan_amount", "debt_to_income").select(
        "application_id", scalar.currency(F.col("loan_amount")).alias("loan"),
        F.when(F.col("debt_to_income").isNotNull(), scalar.percent(F.col("debt_to_income")))
        .alias("debt"))


@query("p12_title_case", on_applications("""
    SELECT loan_purpose, CASE loan_purpose WHEN 'medical' THEN 'Medical'
        WHEN 'debt_consolidation' THEN 'Debt Consolidation' WHEN 'home_improvement' THEN 'Home Improvement'
        WHEN 'other' THEN 'Other' WHEN 'car' THEN 'Car' END AS title, count(*) AS n
    FROM applications GROUP BY loan_purpose"""))
def title_case(spark, sf_dir):
    return applications(spark, sf_dir, "loan_purpose").groupBy("loan_purpose") \
        .agg(F.count("*").alias("n")).withColumn("title", scalar.title_case(F.col("loan_purpose")))


@query("p13_customer_code", """
    SELECT c_custkey, 'CUST_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0')
    AS code FROM customer""")
def customer_code(spark, sf_dir):
    return views.read_table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.customer_code(F.col("c_custkey")).alias("code"))


@query("p14_timestamp_format", on_audit("""
    SELECT audit_id, strftime("timestamp", '%Y-%m-%d %H:%M') AS at FROM audit"""))
def timestamp_format(spark, sf_dir):
    return views.audit_trail(spark, sf_dir).select(
        "audit_id", scalar.minute_stamp(F.col("timestamp")).alias("at"))


@query("p15_timestamp_date", on_audit("""
    SELECT audit_id, CAST("timestamp" AS DATE) AS date FROM audit"""))
def timestamp_date(spark, sf_dir):
    return views.audit_trail(spark, sf_dir).select("audit_id", F.to_date("timestamp").alias("date"))


@query("p16_review_dates", on_applications("""
    SELECT application_id, CAST(CAST(application_ts AS DATE) + INTERVAL 30 DAY AS DATE) AS business_review,
           CAST(CAST(application_ts AS DATE) + INTERVAL 90 DAY AS DATE) AS compliance_review FROM applications"""))
def review_dates(spark, sf_dir):
    day = F.to_date("application_ts")
    return applications(spark, sf_dir, "application_id", "application_ts").select(
        "application_id", scalar.review_date(day, 30).alias("business_review"),
        scalar.review_date(day, 90).alias("compliance_review"))


@query("p19_score_band", on_applications("""
    SELECT application_id, CASE WHEN credit_score BETWEEN 800 AND 850 THEN 'excellent'
        WHEN credit_score BETWEEN 740 AND 799 THEN 'very_good' WHEN credit_score BETWEEN 670 AND 739 THEN 'good'
        WHEN credit_score BETWEEN 580 AND 669 THEN 'fair' WHEN credit_score BETWEEN 300 AND 579 THEN 'poor'
    END AS score_band FROM applications"""))
def score_band(spark, sf_dir):
    return applications(spark, sf_dir, "application_id", "credit_score").select(
        "application_id", scalar.score_band(F.col("credit_score")).alias("score_band"))


@query("p20_policy_decision", on_scored("""
    SELECT application_id, CASE WHEN risk_score <= CAST(0.2 AS DOUBLE) THEN 'AUTO_APPROVE'
        WHEN risk_score <= CAST(0.7 AS DOUBLE) THEN 'MANUAL_REVIEW' WHEN risk_score >= CAST(0.9 AS DOUBLE)
        THEN 'AUTO_REJECT' WHEN risk_score IS NOT NULL THEN 'SENIOR_REVIEW' END AS policy_decision FROM scored"""))
def policy_decision(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "application_id", scalar.policy_decision(F.col("risk_score")).alias("policy_decision"))


@query("p21_five_factor_risk", on_applications("""
    SELECT application_id, coalesce(debt_to_income > CAST(0.4 AS DOUBLE), false) AS income_debt_ratio_breach,
      credit_history_months < 24 AS credit_history_length_breach,
      coalesce(1 - delinquencies_2yrs / CAST(nullif(line_count, 0) AS DOUBLE) < CAST(0.95 AS DOUBLE), false) AS payment_history_breach,
      coalesce(credit_utilization > CAST(0.3 AS DOUBLE), false) AS credit_utilization_breach,
      inquiries_6mths > 3 AS recent_inquiries_breach,
      round((CASE WHEN debt_to_income > CAST(0.4 AS DOUBLE) THEN 0.25 ELSE 0 END
       + CASE WHEN credit_history_months < 24 THEN 0.15 ELSE 0 END
       + CASE WHEN 1 - delinquencies_2yrs / CAST(nullif(line_count, 0) AS DOUBLE) < CAST(0.95 AS DOUBLE) THEN 0.35 ELSE 0 END
       + CASE WHEN credit_utilization > CAST(0.3 AS DOUBLE) THEN 0.15 ELSE 0 END
       + CASE WHEN inquiries_6mths > 3 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS factor_risk
    FROM applications"""))
def five_factor_risk(spark, sf_dir):
    df = applications(spark, sf_dir, "application_id", "debt_to_income", "credit_history_months",
                      "delinquencies_2yrs", "line_count", "credit_utilization", "inquiries_6mths")
    result = rules.five_factor_risk(df)
    return rounded(result.select(
        "application_id", *[f"{name}_breach" for name, _, _ in policy.RISK_FACTORS],
        "factor_risk"), "factor_risk")


@query("p26_pseudonymise", on_applications("""
    SELECT application_id, sha256('salt-1' || customer_id) AS customer_id,
           CAST(CAST(floor(age / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS age FROM applications"""))
def pseudonymise(spark, sf_dir):
    df = applications(spark, sf_dir, "application_id", "customer_id", "age")
    return rules.pseudonymise(df, "salt-1", age="age")


@query("p27_escalation", on_audit("""
    SELECT audit_id, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch("timestamp"))) / 60) AS BIGINT) AS minutes_open,
      CAST(least(3, greatest(0, floor(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch("timestamp"))) / 60) / 30))) AS INTEGER) AS escalation_level
    FROM audit WHERE status = 'Failed'"""))
def escalation(spark, sf_dir):
    """Open alerts are the failed audit entries."""
    open_alerts = views.audit_trail(spark, sf_dir).filter(F.col("status") == "Failed")
    return rules.escalation(open_alerts, "timestamp", "2024-01-31 00:00:00") \
        .select("audit_id", "minutes_open", "escalation_level")


@query("v11_result_filter", on_scored("""
    SELECT application_id, risk_score, decision FROM scored
    WHERE decision IN ('REVIEW', 'REJECTED') AND risk_score BETWEEN CAST(0.35 AS DOUBLE) AND CAST(0.65 AS DOUBLE)"""))
def result_filter(spark, sf_dir):
    return scoring.filter_results(scored(spark, sf_dir), ["REVIEW", "REJECTED"], 0.35, 0.65) \
        .select("application_id", "risk_score", "decision")


@query("a1_batch_summary", on_scored("""
    SELECT count(*) AS total_records, count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS approved,
      count(CASE WHEN decision = 'REVIEW' THEN 1 END) AS review,
      count(CASE WHEN decision = 'REJECTED' THEN 1 END) AS rejected,
      count(CASE WHEN decision = 'APPROVED' THEN 1 END) / CAST(count(*) AS DOUBLE) AS approved_share,
      count(CASE WHEN decision = 'REVIEW' THEN 1 END) / CAST(count(*) AS DOUBLE) AS review_share,
      count(CASE WHEN decision = 'REJECTED' THEN 1 END) / CAST(count(*) AS DOUBLE) AS rejected_share,
      round(avg(risk_score), 6) AS avg_risk_score FROM scored"""))
def batch_summary(spark, sf_dir):
    return rounded(scoring.batch_summary(scored(spark, sf_dir)), "avg_risk_score")


@query("a23_risk_distribution", on_scored("""
    SELECT risk_category, count(*) AS n, count(*) / CAST((SELECT count(*) FROM scored) AS DOUBLE) AS share
    FROM scored GROUP BY risk_category"""))
def risk_distribution(spark, sf_dir):
    return scoring.risk_distribution(scored(spark, sf_dir))


@query("s12_preview", on_scored("""
    SELECT application_id, credit_score, annual_income, risk_score, decision FROM scored
    ORDER BY application_id LIMIT 10"""))
def preview(spark, sf_dir):
    return scoring.preview(scored(spark, sf_dir), 10).select(
        "application_id", "credit_score", "annual_income", "risk_score", "decision")


@query("t4_recent_decisions", on_scored("""
    SELECT application_id, decision, strftime(application_ts, '%Y-%m-%d %H:%M') AS at,
           format('${:,}', CAST(round_even(loan_amount, 0) AS BIGINT)) AS amount
    FROM scored ORDER BY application_ts DESC, application_id DESC LIMIT 5"""))
def recent_decisions(spark, sf_dir):
    return audit.recent_decisions(scored(spark, sf_dir, "application_ts"), 5)


@query("x8_factor_breakdown", on_phi("""
    SELECT application_id, CASE greatest(c1, c2, c3, c4, c5, c6) WHEN c1 THEN 'Credit Score'
        WHEN c2 THEN 'Annual Income' WHEN c3 THEN 'Debt-to-Income' WHEN c4 THEN 'Employment Length'
        WHEN c5 THEN 'Loan Amount' ELSE 'Credit Utilization' END AS top_feature,
      greatest(c1, c2, c3, c4, c5, c6) AS top_contribution,
      round(c1 + c2 + c3, 12) AS leading_sum, round(c4 + c5 + c6, 12) AS remaining_sum
    FROM scored WHERE risk_score IS NOT NULL"""))
def factor_breakdown(spark, sf_dir):
    complete = applications(spark, sf_dir, *views.SCORING_COLUMNS).dropna(subset=policy.SCORE_INPUTS)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["contribution"])
    parts = scoring.factor_breakdown(complete)
    return rounded(parts.select(
        "application_id", "top_feature", "top_contribution",
        total("leading").alias("leading_sum"), total("remaining").alias("remaining_sum")),
        "leading_sum", "remaining_sum", digits=12)
