"""Sources and sinks: every query writes the whole result and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from riskloom import policy, session
from riskloom.operators import audit, explain, fairness, reports, scoring, sinks
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_fairness, on_phi, on_portfolio, on_scored
from riskloom.plans.shared import (
    AS_OF, CATEGORY_COLUMNS, EXPLORER_COLUMNS, PROFILE_COLUMNS, applications, prepared, prepared_scores, scored,
)
from riskloom.sources import applications as views
from riskloom.sources import readers

UPLOAD = ["customer_id", "age", "annual_income", "credit_score", "loan_amount", "employment_length",
          "debt_to_income", "credit_utilization", "loan_purpose", "home_ownership"]
_UPLOAD_SQL = on_applications(f"SELECT {', '.join(UPLOAD)} FROM applications")


def _round_trip(spark, sf_dir, fmt, write):
    path = session.scratch_path(spark, "upload") + f".{fmt}"
    write(applications(spark, sf_dir, *UPLOAD), path)
    return readers.read_applications(spark, path, schema=readers.schema_of(UPLOAD)).select(*UPLOAD)


@query("s1_csv_scan", _UPLOAD_SQL)
def csv_scan(spark, sf_dir):
    return _round_trip(spark, sf_dir, "csv", sinks.write_csv)


@query("s2_json_scan", _UPLOAD_SQL)
def json_scan(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json", sinks.write_json)


@query("s3_format_dispatch", _UPLOAD_SQL)
def format_dispatch(spark, sf_dir):
    return _round_trip(spark, sf_dir, "parquet", lambda df, path: df.write.parquet(path))


@query("s4_dataset_info")
def dataset_info(spark, sf_dir):
    return readers.dataset_info(views.read_table(spark, sf_dir, "lineitem"))


@query("s4_dataset_facts", "SELECT count(*) AS n_rows, 6 AS n_columns, TRUE AS has_files, TRUE AS has_bytes FROM orders")
def dataset_facts(spark, sf_dir):
    """Rows and columns of the stored orders, and that files and bytes were counted."""
    info = readers.dataset_info(views.read_table(spark, sf_dir, "orders"))
    return info.select("n_rows", "n_columns", (F.col("n_files") > 0).alias("has_files"), (F.col("n_bytes") > F.col("n_rows")).alias("has_bytes"))


@query("s6_csv_sink", on_scored("""
    SELECT application_id, credit_score, annual_income, debt_to_income, employment_length, loan_amount,
           credit_utilization, risk_score, risk_category, decision FROM scored WHERE decision = 'REJECTED'"""))
def csv_sink(spark, sf_dir):
    """Filtered results as csv."""
    rejected = scoring.evaluated_once(scored(spark, sf_dir), ["risk_score", "decision"]) \
        .filter(F.col("decision") == "REJECTED")
    path = sinks.write_csv(rejected, session.scratch_path(spark, "rejected"))
    return spark.read.schema(rejected.schema).option("header", True).csv(path)


@query("s7_results_and_summary", on_scored("""
    SELECT 'Total Records' AS metric, CAST(count(*) AS VARCHAR) AS value FROM scored
    UNION ALL SELECT 'Approved', CAST(count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS VARCHAR) FROM scored
    UNION ALL SELECT 'Review Required', CAST(count(CASE WHEN decision = 'REVIEW' THEN 1 END) AS VARCHAR) FROM scored
    UNION ALL SELECT 'Rejected', CAST(count(CASE WHEN decision = 'REJECTED' THEN 1 END) AS VARCHAR) FROM scored
    UNION ALL SELECT 'Average Risk Score', printf('%.1f%%', avg(risk_score) * 100) FROM scored"""))
def results_and_summary(spark, sf_dir):
    path = session.scratch_path(spark, "batch")
    _, summary = sinks.write_results_and_summary(scored(spark, sf_dir), path)
    return spark.read.parquet(summary)


@query("s8_assessment_documents", on_scored("""
    SELECT application_id, risk_score, risk_category, c1 AS credit_term, c6 AS utilization_term,
           '2.0.0' AS analysis_version FROM scored"""))
def assessment_documents(spark, sf_dir):
    """JSON assessments written as text, parsed back."""
    documents = scoring.assessment_documents(scored(spark, sf_dir), AS_OF)
    path = sinks.write_documents(documents, session.scratch_path(spark, "assessments"))
    schema = T.StructType([
        T.StructField("customer_data", T.StructType([T.StructField("application_id", T.LongType())])),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("risk_category", T.StringType()),
        T.StructField("feature_contributions", T.StructType(
            [T.StructField(label, T.DoubleType()) for label in policy.SCORE_LABELS])),
        T.StructField("analysis_version", T.StringType()),
    ])
    read = spark.read.schema(schema).json(path)
    terms = F.col("feature_contributions")
    return read.select(
        F.col("customer_data.application_id"), "risk_score", "risk_category",
        terms["Credit Score"].alias("credit_term"), terms["Credit Utilization"].alias("utilization_term"),
        "analysis_version")


@query("s9_explanation_documents", on_phi("""
    SELECT application_id, round(base, 6) AS expected_value, round(uncapped, 4) AS prediction,
           round(p3, 6) + 0 AS debt_phi, debt_to_income AS debt_value FROM phi"""))
def explanation_documents(spark, sf_dir):
    documents = explain.scorecard_documents(
        prepared(spark, sf_dir, *views.SCORING_COLUMNS), AS_OF)
    parsed = documents.select("application_id", F.from_json("document", """
        prediction double, expected_value double, feature_contributions map<string, double>,
        feature_values map<string, double>""").alias("d"))
    key = "Debt-to-Income"
    return parsed.select(
        "application_id", F.round("d.expected_value", 6).alias("expected_value"),
        F.round("d.prediction", 4).alias("prediction"),
        (F.round(F.col("d.feature_contributions")[key], 6) + 0.0).alias("debt_phi"),
        F.col("d.feature_values")[key].alias("debt_value"))


@query("s10_bias_report", on_fairness("""
    SELECT CASE WHEN bool_and(coalesce(value >= 0.9, false)) THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS compliance_status,
      round(max(CASE WHEN metric = 'calibration' THEN value END), 6) AS calibration,
      (SELECT round(demographic_parity, 6) FROM bias WHERE attribute = 'ethnicity') AS ethnicity_parity FROM overall"""))
def bias_report(spark, sf_dir):
    people = prepared_scores(spark, sf_dir, "default_risk", *policy.PROTECTED_ATTRIBUTES)
    documents = fairness.bias_report(people, AS_OF)
    path = sinks.write_documents(documents, session.scratch_path(spark, "bias"))
    report = spark.read.schema("""compliance_status string, overall_metrics map<string, double>,
        group_analysis map<string, struct<demographic_parity: double>>""").json(path)
    return report.select(
        "compliance_status",
        F.round(F.col("overall_metrics")["calibration"], 6).alias("calibration"),
        F.round(F.col("group_analysis")["ethnicity"]["demographic_parity"], 6)
        .alias("ethnicity_parity"))


@query("s11_batch_report", on_scored("""
    , b AS (SELECT count(*) AS n, count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS a,
        count(CASE WHEN decision = 'REVIEW' THEN 1 END) AS v, count(CASE WHEN decision = 'REJECTED' THEN 1 END) AS r,
        avg(risk_score) AS m FROM scored)
    SELECT 1 AS line_no, 'Total Records Processed' AS metric, format('{:,}', n) AS value FROM b
    UNION ALL SELECT 2, 'Approved Applications', format('{:,}', a) || printf(' (%.1f%%)', a * 100.0 / CAST(n AS DOUBLE)) FROM b
    UNION ALL SELECT 3, 'Applications Requiring Review', format('{:,}', v) || printf(' (%.1f%%)', v * 100.0 / CAST(n AS DOUBLE)) FROM b
    UNION ALL SELECT 4, 'Rejected Applications', format('{:,}', r) || printf(' (%.1f%%)', r * 100.0 / CAST(n AS DOUBLE)) FROM b
    UNION ALL SELECT 5, 'Average Risk Score', printf('%.1f%%', m * 100) FROM b
    UNION ALL SELECT 6, 'Model Version', '2.0.0'
    UNION ALL SELECT CAST(6 + row_number() OVER (ORDER BY c DESC, risk_category) AS INTEGER), risk_category, CAST(c AS VARCHAR)
      FROM (SELECT risk_category, count(*) AS c FROM scored GROUP BY 1)""".strip()))
def batch_report(spark, sf_dir):
    return reports.batch_report(prepared_scores(spark, sf_dir))


@query("s11_exploration_report", on_applications(f"""
    , e AS (SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in EXPLORER_COLUMNS)} AS m,
        (SELECT CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM applications
          GROUP BY {', '.join(EXPLORER_COLUMNS)})) AS d FROM applications),
    st AS ({' UNION ALL '.join(f"""
        SELECT '{c} count' AS metric, CAST(count({c}) AS DOUBLE) AS value FROM applications
        UNION ALL SELECT '{c} mean', avg({c}) FROM applications UNION ALL SELECT '{c} std', stddev_samp({c}) FROM applications
        UNION ALL SELECT '{c} min', min({c}) FROM applications UNION ALL SELECT '{c} max', max({c}) FROM applications
        UNION ALL SELECT '{c} 25%', quantile_cont(CAST({c} AS DOUBLE), 0.25) FROM applications
        UNION ALL SELECT '{c} 50%', quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM applications
        UNION ALL SELECT '{c} 75%', quantile_cont(CAST({c} AS DOUBLE), 0.75) FROM applications""" for c in PROFILE_COLUMNS)})
    SELECT 1 AS line_no, 'Total Records' AS metric, format('{{:,}}', n) AS value FROM e
    UNION ALL SELECT 2, 'Total Features', '{len(EXPLORER_COLUMNS)}'
    UNION ALL SELECT 3, 'Numeric Features', '{len(PROFILE_COLUMNS)}'
    UNION ALL SELECT 4, 'Categorical Features', '{1 + len(CATEGORY_COLUMNS)}'
    UNION ALL SELECT 5, 'Missing Values', format('{{:,}}', m) || printf(' (%.1f%%)', m * 100.0 / CAST(n * {len(EXPLORER_COLUMNS)} AS DOUBLE)) FROM e
    UNION ALL SELECT 6, 'Duplicate Records', format('{{:,}}', d) || printf(' (%.1f%%)', d * 100.0 / CAST(n AS DOUBLE)) FROM e
    UNION ALL SELECT CAST(6 + row_number() OVER (ORDER BY metric) AS INTEGER), metric, printf('%.2f', round(value, 2)) FROM st""".strip()))
def exploration_report(spark, sf_dir):
    return reports.exploration_report(
        prepared(spark, sf_dir, *EXPLORER_COLUMNS), PROFILE_COLUMNS, EXPLORER_COLUMNS)


@query("s11_business_report", on_portfolio("""
    , now AS (SELECT * FROM kpis ORDER BY month DESC LIMIT 1)
    SELECT 1 AS line_no, 'Approval Rate' AS metric, printf('%.1f%%', approval_rate * 100) AS value FROM now
    UNION ALL SELECT 2, 'Default Rate', printf('%.1f%%', default_rate * 100) FROM now
    UNION ALL SELECT 3, 'Profit Margin', printf('%.1f%%', profit_margin * 100) FROM now
    UNION ALL SELECT 4, 'Portfolio Growth', printf('%.1f%%', portfolio_growth * 100) FROM now
    UNION ALL SELECT 5, 'Profit Margin To Target', printf('%.1f%%', (profit_margin - 0.15) * 100) FROM now
    UNION ALL SELECT 6, 'Next Review', '2001-08-31'
    UNION ALL SELECT CAST(6 + row_number() OVER (ORDER BY segment) AS INTEGER), segment,
      loan_count || ' | ' || format('${:,}', CAST(round_even(total_amount, 0) AS BIGINT)) || ' | '
      || format('${:,}', CAST(round_even(total_amount / loan_count, 0) AS BIGINT)) || ' | ' || printf('%.1f%%', default_rate * 100)
      || ' | ' || printf('%.1f%%', yield_rate * 100) || ' | '
      || printf('%.1f%%', (yield_rate * total_amount - default_rate * total_amount) / (yield_rate * total_amount) * 100) FROM portfolio""".strip()))
def business_report(spark, sf_dir):
    return reports.business_report(prepared_scores(spark, sf_dir, "application_ts", "default_risk"), AS_OF)


@query("s11_compliance_report", on_fairness("""
    , a AS (SELECT count(*) AS n, count(CASE WHEN event_type <> 'error' THEN 1 END) / CAST(count(*) AS DOUBLE) AS ok,
        count(CASE WHEN value >= 115 THEN 1 END) AS high FROM events)
    SELECT 1 AS line_no, 'Total Activities' AS metric, CAST(n AS VARCHAR) AS value FROM a
    UNION ALL SELECT 2, 'Success Rate', printf('%.1f%%', ok * 100) FROM a
    UNION ALL SELECT 3, 'High Risk Activities', CAST(high AS VARCHAR) FROM a
    UNION ALL SELECT 4, 'Next Review Date', '2001-10-30'
    UNION ALL SELECT CAST(4 + row_number() OVER (ORDER BY metric) AS INTEGER), CASE metric
      WHEN 'calibration' THEN 'Calibration' WHEN 'demographic_parity' THEN 'Demographic Parity'
      WHEN 'equalized_odds' THEN 'Equalized Odds' ELSE 'Individual Fairness' END, printf('%.3f', value) FROM overall""".strip()))
def compliance_report(spark, sf_dir):
    people = prepared_scores(spark, sf_dir, "default_risk", *policy.PROTECTED_ATTRIBUTES)
    return reports.compliance_report(people, views.audit_trail(spark, sf_dir), AS_OF)


@query("s11_explanation_report", on_phi("""
    SELECT 1 AS line_no, 'Type' AS metric, 'Additive scorecard' AS value
    UNION ALL SELECT 2, 'Features', '6'
    UNION ALL SELECT 3, 'Base Value', printf('%.3f', m1 + m2 + m3 + m4 + m5 + m6) FROM means
    UNION ALL SELECT CAST(3 + rank AS INTEGER), feature, printf('%.4f', importance) FROM importance"""))
def explanation_report(spark, sf_dir):
    """Written as text lines and read back as rows."""
    return reports.explanation_report(prepared(spark, sf_dir, *views.SCORING_COLUMNS))


@query("s11_report_text")
def report_text(spark, sf_dir):
    """The batch report as the text file a user downloads."""
    report = reports.batch_report(prepared_scores(spark, sf_dir))
    return spark.read.text(sinks.write_report(report, session.scratch_path(spark, "report")))


@query("s11_assessment_summaries")
def assessment_summaries(spark, sf_dir):
    return reports.assessment_summaries(
        scored(spark, sf_dir, "employment_status", "age"))


@query("s6_decision_log_sink", on_scored("""
    SELECT CAST(application_ts AS DATE) AS date, count(*) AS n FROM scored
    WHERE CAST(application_ts AS DATE) >= DATE '2001-01-01' GROUP BY 1"""))
def decision_log_sink(spark, sf_dir):
    """The log is written by month; the read prunes to the folders asked for."""
    log = audit.decision_log(scored(spark, sf_dir, "application_ts", "customer_id"))
    path = sinks.write_decision_log(log, session.scratch_path(spark, "decisions"))
    recent = (F.col("month") >= "2001-01") & (F.col("date") >= F.lit("2001-01-01").cast("date"))
    return spark.read.parquet(path).filter(recent).groupBy("date").agg(F.count("*").alias("n"))
