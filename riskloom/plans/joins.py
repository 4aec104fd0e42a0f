"""The application view and its joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import policy
from riskloom.operators import explain, kpi, validation
from riskloom.plans.catalog import query
from riskloom.plans.oracle import LINES, on_applications, on_portfolio, on_scored, sql
from riskloom.plans.shared import applications, prepared, rounded
from riskloom.sources import applications as views


@query("j1_orders_customer_nation_region", """
    SELECT r_name, n_name, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def orders_by_nation(spark, sf_dir):
    """Inner joins down to the region; orders are summed per customer before any join."""
    read = lambda name: views.read_table(spark, sf_dir, name)
    per_customer = read("orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("price"))
    return per_customer.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .groupBy("r_name", "n_name").agg(
            F.sum("n").alias("n_orders"), F.sum("price").cast("double").alias("total_price"))


@query("j2_line_ratios", sql("""
    SELECT o_orderkey AS application_id, debt_to_income, credit_utilization, line_count, returned
    FROM orders LEFT JOIN line_ratios ON o_orderkey = l_orderkey""", LINES))
def line_ratios(spark, sf_dir):
    """Left join to the per-order line aggregate; orders without lines keep nulls."""
    orders = views.read_table(spark, sf_dir, "orders").select("o_orderkey")
    lines = views.line_ratios(views.read_table(spark, sf_dir, "lineitem"))
    return orders.join(lines, "o_orderkey", "left").withColumnRenamed("o_orderkey", "application_id")


@query("j3_trailing_inquiries", """
    SELECT a.o_orderkey AS application_id,
           CAST(count(*) - 1 AS INTEGER) AS inquiries_6mths
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
     AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE)
     AND CAST(b.o_orderdate AS DATE) > CAST(a.o_orderdate AS DATE) - INTERVAL 180 DAY
    JOIN customer ON c_custkey = a.o_custkey
    GROUP BY a.o_orderkey""")
def trailing_inquiries(spark, sf_dir):
    """The interval self join as a range window over per-day counts."""
    return applications(spark, sf_dir, "application_id", "inquiries_6mths")


@query("j4_distance_from_mean", on_applications("""
    SELECT application_id, round(loan_amount - (SELECT avg(loan_amount) FROM applications), 6) AS loan_gap,
           round(credit_score - (SELECT avg(credit_score) FROM applications), 6) AS score_gap
    FROM applications"""))
def distance_from_mean(spark, sf_dir):
    """Every row against one-row statistics, by scalar subquery instead of a cross join."""
    df = prepared(spark, sf_dir, "application_id", "loan_amount", "credit_score")
    means = df.agg(F.struct(F.avg("loan_amount").alias("loan"),
                            F.avg("credit_score").alias("score"))).scalar()
    gaps = df.withColumn("m", means).select(
        "application_id", (F.col("loan_amount") - F.col("m.loan")).alias("loan_gap"),
        (F.col("credit_score") - F.col("m.score")).alias("score_gap"))
    return rounded(gaps, "loan_gap", "score_gap")


@query("j5_segment_advice", on_portfolio("""
    SELECT segment, loan_count, CASE segment
        WHEN 'Prime' THEN 'Maintain current pricing strategy, focus on volume growth'
        WHEN 'Near-Prime' THEN 'Increase marketing spend, optimize approval criteria'
        WHEN 'Subprime' THEN 'Implement enhanced monitoring, consider rate adjustments'
        ELSE 'Review risk appetite, strengthen collection processes' END AS advice
    FROM portfolio"""))
def segment_advice(spark, sf_dir):
    df = applications(spark, sf_dir, "credit_score", "loan_amount", "default_risk")
    return kpi.segment_advice(kpi.portfolio_by_segment(df)) \
        .select("segment", "loan_count", "advice")


@query("j6_purposes_without_product", on_applications("""
    SELECT loan_purpose, count(*) AS n FROM applications
    WHERE loan_purpose NOT IN ('home_purchase', 'refinance', 'personal', 'auto', 'business')
    GROUP BY loan_purpose"""))
def purposes_without_product(spark, sf_dir):
    """Anti join against the product table (five rows)."""
    df = applications(spark, sf_dir, "loan_purpose")
    products = F.broadcast(policy.purpose_limits(spark))
    return validation.outside_domain(df, "loan_purpose", products, "product") \
        .groupBy("loan_purpose").agg(F.count("*").alias("n"))


@query("w7_account_history", on_applications("""
    SELECT application_id, inquiries_6mths, open_accounts, total_accounts, credit_history_months
    FROM applications"""))
def account_history(spark, sf_dir):
    return applications(spark, sf_dir, "application_id", "inquiries_6mths", "open_accounts",
                        "total_accounts", "credit_history_months")


@query("applications_view", on_applications("""
    SELECT application_id, customer_id, CAST(application_ts AS DATE) AS application_date, age,
           annual_income, credit_score, loan_amount, employment_length, debt_to_income,
           credit_utilization, delinquencies_2yrs, inquiries_6mths, open_accounts, total_accounts,
           loan_purpose, home_ownership, employment_status, default_risk, sex, age_group,
           ethnicity, marital_status FROM applications"""))
def applications_view(spark, sf_dir):
    return applications(spark, sf_dir).withColumn(
        "application_ts", F.to_date("application_ts")) \
        .withColumnRenamed("application_ts", "application_date")


@query("p18_what_if", on_scored("""
    , m AS (SELECT avg(credit_score) AS cs, avg(annual_income) AS ai, avg(debt_to_income) AS dti,
              avg(employment_length) AS el, avg(loan_amount) AS la, avg(credit_utilization) AS cu
            FROM applications),
    s AS (SELECT * FROM (VALUES (1, 720, 75000, NULL, 5), (2, 580, 40000, 0.55, NULL), (3, NULL, NULL, NULL, NULL))
            t(scenario_id, cs0, ai0, dti0, el0)),
    filled AS (SELECT scenario_id, coalesce(CAST(cs0 AS DOUBLE), cs) AS cs, coalesce(CAST(ai0 AS DOUBLE), ai) AS ai,
        coalesce(CAST(dti0 AS DOUBLE), dti) AS dti, coalesce(CAST(el0 AS DOUBLE), el) AS el, la, cu FROM s, m),
    r AS (SELECT *, least((1 - least(cs / 850, 1)) * 0.25 + greatest(0, (100000 - ai) / 100000) * 0.2 + dti * 0.2
        + greatest(0, (10 - el) / 10) * 0.15 + least(la / 100000, 1) * 0.1 + cu * 0.1, 1) AS risk_score FROM filled)
    SELECT CAST(scenario_id AS INTEGER) AS scenario_id, round(cs, 6) AS credit_score,
      round(ai, 6) AS annual_income, round(dti, 6) AS debt_to_income, round(risk_score, 6) AS risk_score,
      CASE WHEN risk_score <= 0.3 THEN 'APPROVED' WHEN risk_score <= 0.6 THEN 'REVIEW' ELSE 'REJECTED' END AS decision
    FROM r""".strip()))
def what_if(spark, sf_dir):
    """Scenarios scored with the column means of the table for what they leave open."""
    scenarios = spark.createDataFrame(
        [(1, 720.0, 75000.0, None, 5.0), (2, 580.0, 40000.0, 0.55, None), (3, None, None, None, None)],
        "scenario_id int, credit_score double, annual_income double, debt_to_income double, "
        "employment_length double")
    result = explain.what_if(prepared(spark, sf_dir, *policy.SCORE_INPUTS), scenarios)
    return rounded(
        result.select("scenario_id", "credit_score", "annual_income", "debt_to_income",
                      "risk_score", "decision"),
        "credit_score", "annual_income", "debt_to_income", "risk_score")
