"""Validation, domains, quality verdict, eligibility, purpose limits, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import policy
from riskloom.operators import profiling, rules, validation
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_audit, sql
from riskloom.plans.shared import (
    CATEGORY_COLUMNS, EXPLORER_COLUMNS, PROFILE_COLUMNS, applications, prepared, rounded,
)
from riskloom.sources import applications as views


def raw_customers(spark, sf_dir):
    """Customers as an unchecked upload: balances may be negative, most scoring columns are absent."""
    return views.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("application_id"), F.col("c_acctbal").alias("annual_income"),
        (250 + F.col("c_custkey") * 37 % 700).cast("int").alias("credit_score"))


RAW = """
raw AS (SELECT c_custkey AS application_id, c_acctbal AS annual_income,
               CAST(250 + c_custkey * 37 % 700 AS INTEGER) AS credit_score FROM customer)"""


@query("v1_missing_columns", sql("""
    SELECT count(*) AS n, 'loan_amount, employment_length, debt_to_income, credit_utilization' AS missing
    FROM raw""", RAW))
def missing_columns(spark, sf_dir):
    df = raw_customers(spark, sf_dir)
    return df.agg(F.count("*").alias("n")).withColumn("missing", F.lit(", ".join(validation.missing_columns(df))))


@query("v2_invalid_credit_scores", sql("""
    SELECT count(*) AS invalid_scores FROM raw WHERE credit_score < 300 OR credit_score > 850""", RAW))
def invalid_scores(spark, sf_dir):
    return validation.validation_report(raw_customers(spark, sf_dir)).select("invalid_scores")


@query("v3_invalid_income", sql(
    "SELECT count(*) AS invalid_income FROM raw WHERE annual_income <= 0", RAW))
def invalid_income(spark, sf_dir):
    return validation.validation_report(raw_customers(spark, sf_dir)).select("invalid_income")


@query("v4_valid_gate", on_applications("""
    SELECT 'applications' AS source, 0 AS missing_columns,
      count(CASE WHEN credit_score < 300 OR credit_score > 850 THEN 1 END) AS invalid_scores,
      count(CASE WHEN annual_income <= 0 THEN 1 END) AS invalid_income, '' AS errors,
      count(CASE WHEN credit_score < 300 OR credit_score > 850 OR annual_income <= 0 THEN 1 END) = 0 AS is_valid
    FROM applications
    UNION ALL SELECT 'customers', 4, s, i,
      'Missing required columns: loan_amount, employment_length, debt_to_income, credit_utilization|Invalid credit scores found in '
        || s || ' rows|Invalid income values found in ' || i || ' rows', false
    FROM (SELECT count(CASE WHEN credit_score < 300 OR credit_score > 850 THEN 1 END) AS s,
                 count(CASE WHEN annual_income <= 0 THEN 1 END) AS i FROM raw)""", RAW))
def valid_gate(spark, sf_dir):
    """The derived applications pass; raw customers are refused with all three messages."""
    def report(name, df):
        return validation.validation_report(df).select(
            F.lit(name).alias("source"), "missing_columns", "invalid_scores", "invalid_income",
            F.concat_ws("|", "errors").alias("errors"), "is_valid")
    return report("applications", applications(spark, sf_dir, *policy.SCORE_INPUTS)) \
        .unionByName(report("customers", raw_customers(spark, sf_dir)))


@query("v4_quarantine", sql("""
    SELECT application_id, credit_score < 300 OR credit_score > 850 OR annual_income <= 0 AS quarantined FROM raw""", RAW))
def quarantine(spark, sf_dir):
    valid, bad = validation.split_valid(raw_customers(spark, sf_dir))
    tag = lambda df, flag: df.select("application_id", F.lit(flag).alias("quarantined"))
    return tag(valid, False).unionByName(tag(bad, True))


@query("v5_field_constraints", on_applications("""
    SELECT 'age' AS field, count(CASE WHEN age NOT BETWEEN 18 AND 100 THEN 1 END) AS violations FROM applications
    UNION ALL SELECT 'annual_income', count(CASE WHEN annual_income NOT BETWEEN 0 AND 10000000 THEN 1 END) FROM applications
    UNION ALL SELECT 'credit_score', count(CASE WHEN credit_score NOT BETWEEN 300 AND 850 THEN 1 END) FROM applications
    UNION ALL SELECT 'loan_amount', count(CASE WHEN loan_amount NOT BETWEEN 1000 AND 1000000 THEN 1 END) FROM applications
    UNION ALL SELECT 'debt_to_income', count(CASE WHEN debt_to_income NOT BETWEEN 0 AND 1 THEN 1 END) FROM applications
    UNION ALL SELECT 'employment_length', count(CASE WHEN employment_length NOT BETWEEN 0 AND 50 THEN 1 END) FROM applications"""))
def field_constraints(spark, sf_dir):
    return validation.field_violations(applications(spark, sf_dir, *policy.FIELD_RANGES))


@query("v6_category_domains", on_applications("""
    SELECT 'loan_purpose' AS field, count(CASE WHEN loan_purpose NOT IN ('debt_consolidation', 'home_improvement',
      'major_purchase', 'medical', 'car', 'vacation', 'wedding', 'moving', 'other') THEN 1 END) AS violations FROM applications
    UNION ALL SELECT 'home_ownership', count(CASE WHEN home_ownership NOT IN ('RENT', 'OWN', 'MORTGAGE', 'OTHER') THEN 1 END) FROM applications
    UNION ALL SELECT 'employment_status', count(CASE WHEN employment_status NOT IN ('EMPLOYED', 'SELF_EMPLOYED', 'UNEMPLOYED', 'RETIRED') THEN 1 END) FROM applications"""))
def category_domains(spark, sf_dir):
    return validation.domain_violations(applications(spark, sf_dir, *CATEGORY_COLUMNS))


@query("v7_completeness", on_applications("""
    SELECT 'loan_amount' AS field, count(*) - count(loan_amount) AS missing FROM applications
    UNION ALL SELECT 'annual_income', count(*) - count(annual_income) FROM applications
    UNION ALL SELECT 'credit_score', count(*) - count(credit_score) FROM applications
    UNION ALL SELECT 'employment_length', count(*) - count(employment_length) FROM applications
    UNION ALL SELECT 'loan_purpose', count(*) - count(loan_purpose) FROM applications
    UNION ALL SELECT 'home_ownership', count(*) - count(home_ownership) FROM applications
    UNION ALL SELECT 'debt_to_income', count(*) - count(debt_to_income) FROM applications"""))
def completeness(spark, sf_dir):
    return validation.completeness(applications(spark, sf_dir, *policy.REQUIRED_FIELDS))


def _outlier_sql(column: str) -> str:
    return (f"count(CASE WHEN abs({column} - (SELECT avg({column}) FROM applications)) > "
            f"3 * (SELECT stddev_samp({column}) FROM applications) THEN 1 END)")


@query("v8_quality_verdict", on_applications(f"""
    , copies AS (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM applications
        GROUP BY {', '.join(EXPLORER_COLUMNS)})),
    r AS (SELECT ({' + '.join(f'(count(*) - count({c}))' for c in EXPLORER_COLUMNS)})
            / CAST(count(*) * {len(EXPLORER_COLUMNS)} AS DOUBLE) AS missing,
        (SELECT d FROM copies) / CAST(count(*) AS DOUBLE) AS duplicate,
        ({' + '.join(_outlier_sql(c) for c in PROFILE_COLUMNS)}) / CAST(count(*) * {len(PROFILE_COLUMNS)} AS DOUBLE) AS outlier,
        count(CASE WHEN age BETWEEN 18 AND 100 AND annual_income BETWEEN 0 AND 10000000
          AND credit_score BETWEEN 300 AND 850 AND loan_amount BETWEEN 1000 AND 1000000
          AND (debt_to_income IS NULL OR debt_to_income BETWEEN 0 AND 1)
          AND employment_length BETWEEN 0 AND 50 THEN 1 END) / CAST(count(*) AS DOUBLE) AS consistency
      FROM applications)
    SELECT 'missing' AS "check", round(missing, 6) AS ratio, CAST(0.1 AS DOUBLE) AS "limit", missing <= 0.1 AS passed FROM r
    UNION ALL SELECT 'duplicate', round(duplicate, 6), 0.05, duplicate <= 0.05 FROM r
    UNION ALL SELECT 'outlier', round(outlier, 6), 0.05, outlier <= 0.05 FROM r
    UNION ALL SELECT 'consistency', round(consistency, 6), 0.95, consistency >= 0.95 FROM r""".strip()))
def quality_verdict(spark, sf_dir):
    df = prepared(spark, sf_dir, *EXPLORER_COLUMNS)
    return rounded(validation.quality_verdict(df, PROFILE_COLUMNS, EXPLORER_COLUMNS), "ratio")


@query("v9_eligibility", on_applications("""
    SELECT application_id, concat_ws(',', CASE WHEN age NOT BETWEEN 18 AND 75 THEN 'age' END,
      CASE WHEN annual_income < 25000 THEN 'income' END, CASE WHEN loan_amount > 1000000 THEN 'loan_amount' END,
      CASE WHEN credit_score NOT BETWEEN 300 AND 850 THEN 'credit_score' END,
      CASE WHEN debt_to_income IS NULL OR debt_to_income > CAST(0.5 AS DOUBLE) THEN 'debt_to_income' END,
      CASE WHEN employment_length * 12 < 6 THEN 'employment_history' END, CASE WHEN inquiries_6mths > 5 THEN 'inquiries' END,
      CASE WHEN credit_history_months < 12 THEN 'credit_history' END) AS reasons,
      age BETWEEN 18 AND 75 AND annual_income >= 25000 AND loan_amount <= 1000000
        AND credit_score BETWEEN 300 AND 850 AND coalesce(debt_to_income <= CAST(0.5 AS DOUBLE), false)
        AND employment_length * 12 >= 6 AND inquiries_6mths <= 5 AND credit_history_months >= 12 AS eligible
    FROM applications"""))
def eligibility(spark, sf_dir):
    df = applications(spark, sf_dir, "application_id", "age", "annual_income", "loan_amount",
                      "credit_score", "debt_to_income", "employment_length", "inquiries_6mths", "credit_history_months")
    return rules.eligibility(df).select(
        "application_id", F.concat_ws(",", "reasons").alias("reasons"), "eligible")


@query("v10_purpose_limits", on_applications("""
    SELECT application_id, product, CAST(max_amount AS DOUBLE) AS max_amount,
           coalesce(loan_amount <= max_amount, true) AS within_limit
    FROM (SELECT application_id, loan_amount, CASE loan_purpose WHEN 'car' THEN 'auto'
            WHEN 'home_improvement' THEN 'refinance' ELSE 'personal' END AS product,
          CASE WHEN loan_purpose NOT IN ('car', 'home_improvement') THEN 100000 END AS max_amount FROM applications)"""))
def purpose_limits(spark, sf_dir):
    df = applications(spark, sf_dir, "application_id", "loan_amount", "loan_purpose")
    return rules.purpose_limit_check(df).select(
        "application_id", "product", "max_amount", "within_limit")


@query("v12_generic_filters", on_applications("""
    SELECT count(*) AS original_records, count(CASE WHEN keep THEN 1 END) AS filtered_records,
           round((count(*) - count(CASE WHEN keep THEN 1 END)) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS reduction_pct
    FROM (SELECT age BETWEEN 25 AND 60 AND debt_to_income BETWEEN CAST(0.3 AS DOUBLE) AND CAST(0.7 AS DOUBLE)
            AND (home_ownership IN ('RENT', 'OWN') OR home_ownership IS NULL)
            AND employment_status IN ('EMPLOYED', 'RETIRED') AS keep FROM applications)"""))
def generic_filters(spark, sf_dir):
    df = applications(spark, sf_dir, "age", "debt_to_income", "home_ownership", "employment_status")
    result = profiling.filter_reduction(df, [
        profiling.NumericRange("age", 25, 60),
        profiling.NumericRange("debt_to_income", 0.3, 0.7),
        profiling.CategorySet("home_ownership", ("RENT", "OWN", None)),
        profiling.CategorySet("employment_status", ("EMPLOYED", "RETIRED")),
    ])
    return rounded(result, "reduction_pct")


@query("v13_retention", on_audit("""
    SELECT o_orderkey AS application_id FROM orders
    WHERE o_orderdate >= DATE '2003-06-01' - INTERVAL 2555 DAY"""))
def retention(spark, sf_dir):
    """Filters the raw timestamp column, so the cut reaches the parquet scan."""
    orders = views.read_table(spark, sf_dir, "orders")
    return rules.within_retention(orders, "o_orderdate", "2003-06-01") \
        .select(F.col("o_orderkey").alias("application_id"))
