"""Weights, cut points, labels, texts and limits the results depend on.

Everything here is data. Values that have no published counterpart and were chosen
for this project are marked "own choice".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Scorecard terms in evaluation order: (column, label, weight).
SCORE_TERMS = [
    ("credit_score", "Credit Score", 0.25),
    ("annual_income", "Annual Income", 0.20),
    ("debt_to_income", "Debt-to-Income", 0.20),
    ("employment_length", "Employment Length", 0.15),
    ("loan_amount", "Loan Amount", 0.10),
    ("credit_utilization", "Credit Utilization", 0.10),
]
SCORE_INPUTS = [column for column, _, _ in SCORE_TERMS]
SCORE_LABELS = [label for _, label, _ in SCORE_TERMS]
MAX_CREDIT_SCORE = 850
INCOME_REFERENCE = 100000
LOAN_REFERENCE = 100000
EMPLOYMENT_REFERENCE = 10

# Risk bands, both ends inclusive, first match wins.
RISK_BANDS = [
    (0.0, 0.1, "Very Low Risk"),
    (0.1, 0.3, "Low Risk"),
    (0.3, 0.6, "Medium Risk"),
    (0.6, 0.8, "High Risk"),
    (0.8, 1.0, "Very High Risk"),
]
FALLBACK_BAND = "Medium Risk"

# Decision cut points.
APPROVE_UP_TO = 0.3
REVIEW_UP_TO = 0.6
DECISIONS = ["APPROVED", "REVIEW", "REJECTED"]
INDIVIDUAL_DECISIONS = ["APPROVED", "REVIEW REQUIRED", "HIGH RISK"]
ANALYSIS_VERSION = "2.0.0"

# Recommendation texts in rule order.
RECOMMEND_SCORE = "🔧 Improve credit score by paying bills on time and reducing credit utilization"
RECOMMEND_DEBT = "💰 Reduce debt-to-income ratio by paying down existing debts"
RECOMMEND_UTILIZATION = "💳 Lower credit utilization below 30% for better risk profile"
RECOMMEND_EMPLOYMENT = "👔 Longer employment history would improve creditworthiness"
RECOMMEND_COSIGNER = "⚠️ Consider a co-signer or collateral to reduce risk"
RECOMMEND_DOCUMENTS = "📋 Provide additional documentation to support application"
RECOMMEND_NONE = "✅ Excellent credit profile! You qualify for our best rates"

# Default-risk proxy label: weights in order and the cut.
PROXY_WEIGHTS = (0.3, 0.25, 0.2, 0.15, 0.1)
PROXY_DELINQUENCY_SCALE = 10
PROXY_INQUIRY_SCALE = 15
PROXY_CUT = 0.5

# Columns a batch must have, in the order they are reported missing.
REQUIRED_COLUMNS = [
    "annual_income", "credit_score", "loan_amount", "employment_length", "debt_to_income",
    "credit_utilization",
]

# Range validation.
CREDIT_SCORE_RANGE = (300, 850)
FIELD_RANGES = {
    "age": (18, 100),
    "annual_income": (0, 10000000),
    "credit_score": (300, 850),
    "loan_amount": (1000, 1000000),
    "debt_to_income": (0, 1),
    "employment_length": (0, 50),
}
REQUIRED_FIELDS = [
    "loan_amount", "annual_income", "credit_score", "employment_length",
    "loan_purpose", "home_ownership", "debt_to_income",
]
DOMAINS = {
    "loan_purpose": [
        "debt_consolidation", "home_improvement", "major_purchase", "medical", "car",
        "vacation", "wedding", "moving", "other",
    ],
    "home_ownership": ["RENT", "OWN", "MORTGAGE", "OTHER"],
    "employment_status": ["EMPLOYED", "SELF_EMPLOYED", "UNEMPLOYED", "RETIRED"],
}
QUALITY_LIMITS = {"missing": 0.1, "duplicate": 0.05, "outlier": 0.05, "consistency": 0.95}
MISSING_RATINGS = [(1, "Excellent"), (5, "Good"), (10, "Warning")]
DUPLICATE_RATINGS = [(1, "Excellent"), (3, "Good"), (5, "Warning")]
WORST_RATING = "Poor"

# Eligibility rules.
MINIMUM_AGE = 18
MAXIMUM_AGE = 75
MINIMUM_INCOME = 25000
MAXIMUM_LOAN = 1000000
MAXIMUM_DEBT_RATIO = 0.5
MAXIMUM_INQUIRIES = 5
MINIMUM_EMPLOYMENT_MONTHS = 6
MINIMUM_CREDIT_HISTORY_MONTHS = 12
SYSTEM_ERROR_LIMIT = 0.01
RETENTION_DAYS = 2555

# Loan-purpose products: (purpose, max_amount, max_ltv, max_term_months).
PURPOSE_LIMITS = [
    ("home_purchase", None, 0.95, None),
    ("refinance", None, 0.90, None),
    ("personal", 100000.0, None, 84),
    ("auto", None, 1.0, 72),
    ("business", 500000.0, None, None),
]
# Own choice: which product an application's purpose falls under; the rest is personal.
PURPOSE_PRODUCT = {"car": "auto", "home_improvement": "refinance"}
DEFAULT_PRODUCT = "personal"

# Credit-score bands.
SCORE_BANDS = [
    (800, 850, "excellent"),
    (740, 799, "very_good"),
    (670, 739, "good"),
    (580, 669, "fair"),
    (300, 579, "poor"),
]

# Automatic decision thresholds; the label between review and reject is an own choice.
AUTO_APPROVE = 0.2
MANUAL_REVIEW = 0.7
AUTO_REJECT = 0.9

# Five-factor risk: (factor, weight, threshold).
RISK_FACTORS = [
    ("income_debt_ratio", 0.25, 0.4),
    ("credit_history_length", 0.15, 24),
    ("payment_history", 0.35, 0.95),
    ("credit_utilization", 0.15, 0.3),
    ("recent_inquiries", 0.10, 3),
]

# Outliers.
Z_LIMIT = 3.0
IQR_FENCE = 1.5  # own choice

# KPI thresholds: (kpi, direction, target, warning, critical).
KPI_THRESHOLDS = [
    ("approval_rate", "high", 0.75, 0.70, 0.65),
    ("default_rate", "low", 0.05, 0.08, 0.12),
    ("profit_margin", "high", 0.15, 0.12, 0.08),
    ("portfolio_growth", "high", 0.10, 0.05, 0.00),
]
ALL_CLEAR = "All KPIs are performing within target ranges"
GAUGE_WARNING_SHARE = 0.8
ACCURACY_ZONES = [(50, "error"), (80, "warning"), (100, "success")]

# Portfolio segments: (segment, lowest credit score, yield, advice); lowest scores are an own choice.
SEGMENTS = [
    ("Prime", 660, 0.08, "Maintain current pricing strategy, focus on volume growth"),
    ("Near-Prime", 620, 0.12, "Increase marketing spend, optimize approval criteria"),
    ("Subprime", 580, 0.18, "Implement enhanced monitoring, consider rate adjustments"),
    ("Deep Subprime", None, 0.28, "Review risk appetite, strengthen collection processes"),
]

# Alerts.
ALERT_PRIORITIES = [("info", 1), ("warning", 2), ("error", 3), ("critical", 4)]
ESCALATE_AFTER_MINUTES = 30
MAX_ESCALATIONS = 3

# Fairness and monitoring.
FAIRNESS_PASS = 0.90
BIAS_LIMIT = 0.1
DRIFT_LIMIT = 0.1
DEGRADATION_LIMIT = 0.05
PERFORMANCE_LIMIT = 0.75
RETRAIN_AFTER_DAYS = 30
IMPORTANCE_LIMIT = 0.01
PROTECTED_ATTRIBUTES = ["sex", "age_group", "ethnicity", "marital_status"]

SIGNIFICANCE = 0.05

# Model features in order.
MODEL_FEATURES = [
    "credit_score", "annual_income", "debt_to_income", "employment_length",
    "loan_amount", "credit_utilization", "delinquencies_2yrs", "inquiries_6mths",
]

# Upload template: one row per application.
TEMPLATE_COLUMNS = [
    "customer_id", "annual_income", "credit_score", "loan_amount", "employment_length",
    "debt_to_income", "credit_utilization", "loan_purpose", "home_ownership",
]
TEMPLATE_ROWS = [
    ("CUST_0001", 45000.0, 720, 25000.0, 5.0, 0.25, 0.20, "debt_consolidation", "RENT"),
    ("CUST_0002", 75000.0, 680, 45000.0, 3.5, 0.35, 0.45, "home_improvement", "MORTGAGE"),
    ("CUST_0003", 120000.0, 780, 80000.0, 8.0, 0.20, 0.15, "major_purchase", "OWN"),
    ("CUST_0004", 35000.0, 620, 15000.0, 1.5, 0.45, 0.60, "car", "RENT"),
    ("CUST_0005", 95000.0, 750, 60000.0, 6.0, 0.30, 0.25, "medical", "MORTGAGE"),
    ("CUST_0006", 60000.0, 690, 30000.0, 4.0, 0.40, 0.35, "vacation", "RENT"),
    ("CUST_0007", 85000.0, 740, 50000.0, 7.5, 0.25, 0.20, "other", "OWN"),
    ("CUST_0008", 55000.0, 650, 20000.0, 2.0, 0.50, 0.50, "debt_consolidation", "RENT"),
    ("CUST_0009", 110000.0, 800, 75000.0, 10.0, 0.15, 0.10, "home_improvement", "OWN"),
    ("CUST_0010", 40000.0, 580, 12000.0, 0.5, 0.55, 0.70, "car", "RENT"),
]


def table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A constant list as a DataFrame; its size is fixed by this module."""
    return spark.createDataFrame(rows, schema)


def kpi_thresholds(spark: SparkSession) -> DataFrame:
    return table(spark, KPI_THRESHOLDS,
                 "kpi string, direction string, target double, warning double, critical double")


def purpose_limits(spark: SparkSession) -> DataFrame:
    return table(spark, PURPOSE_LIMITS,
                 "product string, max_amount double, max_ltv double, max_term_months int")


def segments(spark: SparkSession) -> DataFrame:
    return table(spark, SEGMENTS,
                 "segment string, lowest_score int, yield_rate double, advice string")


def alert_priorities(spark: SparkSession) -> DataFrame:
    return table(spark, ALERT_PRIORITIES, "level string, priority int")


def sample_template(spark: SparkSession) -> DataFrame:
    """The ten-row upload template."""
    return table(spark, TEMPLATE_ROWS,
                 "customer_id string, annual_income double, credit_score int, loan_amount double, "
                 "employment_length double, debt_to_income double, credit_utilization double, "
                 "loan_purpose string, home_ownership string")
