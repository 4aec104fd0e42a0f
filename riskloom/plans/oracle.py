"""Common table expressions that state the views in plain SQL, for checking."""

from __future__ import annotations

LINES = """
line_ratios AS (
  SELECT l_orderkey, count(*) AS line_count,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / (CAST(10 AS DOUBLE) * count(*)) AS debt_to_income,
         sum(CAST(l_quantity AS BIGINT)) / (CAST(50 AS DOUBLE) * count(*)) AS credit_utilization,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned
  FROM lineitem GROUP BY l_orderkey)"""

HISTORY = """
dated_orders AS (
  SELECT *, CAST(o_orderdate AS DATE) AS o_day,
         datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS o_dayno FROM orders),
history AS (
  SELECT o_orderkey AS h_orderkey,
         count(*) OVER (PARTITION BY o_custkey ORDER BY o_dayno
                        RANGE BETWEEN 179 PRECEDING AND CURRENT ROW) - 1 AS inquiries_6mths,
         count(CASE WHEN o_orderstatus = 'O' THEN 1 END) OVER (PARTITION BY o_custkey) AS open_accounts,
         count(*) OVER (PARTITION BY o_custkey) AS total_accounts,
         min(o_day) OVER (PARTITION BY o_custkey) AS first_day
  FROM dated_orders)"""

VIEW = """
joined AS (
  SELECT o_orderkey AS application_id,
         'CUST_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS customer_id,
         CAST(o_orderdate AS TIMESTAMP) AS application_ts,
         CAST(18 + c_custkey % 63 AS INTEGER) AS age,
         25000 + greatest(c_acctbal, 0) * 12 AS annual_income,
         CAST(300 + (o_orderkey * 7919 + c_custkey * 104729) % 551 AS INTEGER) AS credit_score,
         o_totalprice / 4 AS loan_amount,
         (c_custkey % 41) / CAST(2 AS DOUBLE) AS employment_length,
         debt_to_income, credit_utilization,
         CAST(coalesce(returned, 0) AS INTEGER) AS delinquencies_2yrs,
         CAST(coalesce(line_count, 0) AS INTEGER) AS line_count,
         CAST(inquiries_6mths AS INTEGER) AS inquiries_6mths,
         CAST(open_accounts AS INTEGER) AS open_accounts,
         CAST(total_accounts AS INTEGER) AS total_accounts,
         CAST((year(o_orderdate) * 12 + month(o_orderdate))
              - (year(first_day) * 12 + month(first_day)) AS INTEGER) AS credit_history_months,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'medical' WHEN '2' THEN 'debt_consolidation'
              WHEN '3' THEN 'home_improvement' WHEN '4' THEN 'other' WHEN '5' THEN 'car' END AS loan_purpose,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'BUILDING' THEN 'MORTGAGE'
              WHEN 'FURNITURE' THEN 'OWN' WHEN 'HOUSEHOLD' THEN 'OTHER'
              WHEN 'MACHINERY' THEN 'RENT' END AS home_ownership,
         CASE WHEN c_custkey % 20 < 14 THEN 'EMPLOYED' WHEN c_custkey % 20 < 17 THEN 'SELF_EMPLOYED'
              WHEN c_custkey % 20 < 19 THEN 'UNEMPLOYED' ELSE 'RETIRED' END AS employment_status,
         CAST(c_custkey % 2 AS VARCHAR) AS sex,
         CAST(CAST(floor((18 + c_custkey % 63) / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS age_group,
         r_name AS ethnicity,
         CAST(c_nationkey % 3 AS VARCHAR) AS marital_status
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN line_ratios ON o_orderkey = l_orderkey
  JOIN history ON o_orderkey = h_orderkey),
applications AS (
  SELECT *, CASE WHEN (1 - credit_score / CAST(850 AS DOUBLE)) * CAST(0.3 AS DOUBLE)
                    + debt_to_income * CAST(0.25 AS DOUBLE) + credit_utilization * CAST(0.2 AS DOUBLE)
                    + delinquencies_2yrs / CAST(10 AS DOUBLE) * CAST(0.15 AS DOUBLE)
                    + inquiries_6mths / CAST(15 AS DOUBLE) * CAST(0.1 AS DOUBLE) > CAST(0.5 AS DOUBLE)
                 THEN 1 ELSE 0 END AS default_risk
  FROM joined)"""

SCORED = """
terms AS (
  SELECT *,
    CASE WHEN credit_score IS NOT NULL
         THEN (1 - least(credit_score / CAST(850 AS DOUBLE), CAST(1 AS DOUBLE))) * CAST(0.25 AS DOUBLE) END AS c1,
    CASE WHEN annual_income IS NOT NULL
         THEN greatest(CAST(0 AS DOUBLE), (100000 - annual_income) / 100000) * CAST(0.2 AS DOUBLE) END AS c2,
    debt_to_income * CAST(0.2 AS DOUBLE) AS c3,
    CASE WHEN employment_length IS NOT NULL
         THEN greatest(CAST(0 AS DOUBLE), (10 - employment_length) / 10) * CAST(0.15 AS DOUBLE) END AS c4,
    CASE WHEN loan_amount IS NOT NULL
         THEN least(loan_amount / 100000, CAST(1 AS DOUBLE)) * CAST(0.1 AS DOUBLE) END AS c5,
    credit_utilization * CAST(0.1 AS DOUBLE) AS c6
  FROM applications),
sums AS (
  SELECT *, c1 + c2 + c3 + c4 + c5 + c6 AS uncapped FROM terms),
capped AS (
  SELECT *, CASE WHEN uncapped IS NOT NULL THEN least(uncapped, CAST(1 AS DOUBLE)) END AS risk_score
  FROM sums),
scored AS (
  SELECT *,
    CASE WHEN risk_score BETWEEN 0 AND CAST(0.1 AS DOUBLE) THEN 'Very Low Risk'
         WHEN risk_score BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.3 AS DOUBLE) THEN 'Low Risk'
         WHEN risk_score BETWEEN CAST(0.3 AS DOUBLE) AND CAST(0.6 AS DOUBLE) THEN 'Medium Risk'
         WHEN risk_score BETWEEN CAST(0.6 AS DOUBLE) AND CAST(0.8 AS DOUBLE) THEN 'High Risk'
         WHEN risk_score BETWEEN CAST(0.8 AS DOUBLE) AND 1 THEN 'Very High Risk'
         ELSE 'Medium Risk' END AS risk_category,
    CASE WHEN risk_score <= CAST(0.3 AS DOUBLE) THEN 'APPROVED'
         WHEN risk_score <= CAST(0.6 AS DOUBLE) THEN 'REVIEW' ELSE 'REJECTED' END AS decision
  FROM capped)"""

AUDIT = """
audit AS (
  SELECT event_id AS audit_id, CAST(ts AS TIMESTAMP) AS "timestamp", user_id, event_type AS activity,
         CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status,
         CASE WHEN value < 60 THEN 'Low' WHEN value < 115 THEN 'Medium' ELSE 'High' END AS risk_level,
         value
  FROM events)"""

# Mean of each term over the applications with a score, and each attribution.
PHI = """
means AS (
  SELECT avg(c1) AS m1, avg(c2) AS m2, avg(c3) AS m3, avg(c4) AS m4, avg(c5) AS m5, avg(c6) AS m6
  FROM scored WHERE risk_score IS NOT NULL),
phi AS (
  SELECT scored.*, m1 + m2 + m3 + m4 + m5 + m6 AS base, c1 - m1 AS p1, c2 - m2 AS p2, c3 - m3 AS p3,
         c4 - m4 AS p4, c5 - m5 AS p5, c6 - m6 AS p6
  FROM scored, means WHERE risk_score IS NOT NULL),
phi_long AS (
  SELECT application_id, base, 'Credit Score' AS feature, CAST(credit_score AS DOUBLE) AS feature_value, p1 AS phi FROM phi
  UNION ALL SELECT application_id, base, 'Annual Income', annual_income, p2 FROM phi
  UNION ALL SELECT application_id, base, 'Debt-to-Income', debt_to_income, p3 FROM phi
  UNION ALL SELECT application_id, base, 'Employment Length', employment_length, p4 FROM phi
  UNION ALL SELECT application_id, base, 'Loan Amount', loan_amount, p5 FROM phi
  UNION ALL SELECT application_id, base, 'Credit Utilization', credit_utilization, p6 FROM phi),
importance AS (
  SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank
  FROM (SELECT feature, avg(abs(phi)) AS importance FROM phi_long GROUP BY feature))"""

# Portfolio segment and its yield.
SEGMENTED = """
segmented AS (
  SELECT *, CASE WHEN credit_score >= 660 THEN 'Prime' WHEN credit_score >= 620 THEN 'Near-Prime'
                 WHEN credit_score >= 580 THEN 'Subprime' ELSE 'Deep Subprime' END AS segment,
         CAST(CASE WHEN credit_score >= 660 THEN 0.08 WHEN credit_score >= 620 THEN 0.12
              WHEN credit_score >= 580 THEN 0.18 ELSE 0.28 END AS DOUBLE) AS yield_rate
  FROM scored),
portfolio AS (
  SELECT segment, count(*) AS loan_count,
         CAST(sum(CAST(loan_amount AS DECIMAL(18,4))) AS DOUBLE) AS total_amount,
         avg(default_risk) AS default_rate, max(yield_rate) AS yield_rate
  FROM segmented GROUP BY segment),
month_segments AS (
  SELECT CAST(date_trunc('month', application_ts) AS DATE) AS month, segment, count(*) AS scored,
         count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS approved,
         sum(CASE WHEN decision = 'APPROVED' THEN default_risk END) AS bad,
         sum(CASE WHEN decision = 'APPROVED' THEN CAST(loan_amount AS DECIMAL(18,4)) END) AS approved_amount,
         CAST(sum(CAST(loan_amount AS DECIMAL(18,4))) AS DOUBLE) AS amount,
         avg(default_risk) AS segment_default, max(yield_rate) AS segment_yield
  FROM segmented GROUP BY 1, 2),
month_sums AS (
  SELECT month, sum(scored) AS scored, sum(approved) AS approved, sum(bad) AS bad,
         CAST(sum(approved_amount) AS DOUBLE) AS approved_amount,
         sum(segment_yield * amount - segment_default * amount) AS margin,
         sum(segment_yield * amount) AS interest
  FROM month_segments GROUP BY month),
kpis AS (
  SELECT month, CAST(scored AS BIGINT) AS scored, CAST(approved AS BIGINT) AS approved, approved_amount,
         approved / CAST(nullif(scored, 0) AS DOUBLE) AS approval_rate,
         bad / CAST(nullif(approved, 0) AS DOUBLE) AS default_rate,
         margin / nullif(interest, 0) AS profit_margin,
         approved_amount / nullif(lag(approved_amount) OVER (ORDER BY month), 0) - 1 AS portfolio_growth
  FROM month_sums),
thresholds AS (
  SELECT * FROM (VALUES ('approval_rate', 'high', CAST(0.75 AS DOUBLE), CAST(0.70 AS DOUBLE), CAST(0.65 AS DOUBLE)),
    ('default_rate', 'low', 0.05, 0.08, 0.12), ('profit_margin', 'high', 0.15, 0.12, 0.08),
    ('portfolio_growth', 'high', 0.10, 0.05, 0.00)) t(kpi, direction, target, warning, critical)),
kpi_values AS (
  SELECT month, 'approval_rate' AS kpi, approval_rate AS value FROM kpis
  UNION ALL SELECT month, 'default_rate', default_rate FROM kpis
  UNION ALL SELECT month, 'profit_margin', profit_margin FROM kpis
  UNION ALL SELECT month, 'portfolio_growth', portfolio_growth FROM kpis),
leveled AS (
  SELECT v.*, target, warning, critical, direction,
    CASE WHEN direction = 'low' AND value > critical OR direction = 'high' AND value < critical THEN 'error'
         WHEN direction = 'low' AND value > warning OR direction = 'high' AND value < warning THEN 'warning'
    END AS level
  FROM kpi_values v JOIN thresholds USING (kpi))"""

# Counts per protected attribute and member.
FAIRNESS = """
members AS (
  SELECT 'sex' AS attribute, sex AS member, * FROM scored
  UNION ALL SELECT 'age_group', age_group, * FROM scored
  UNION ALL SELECT 'ethnicity', ethnicity, * FROM scored
  UNION ALL SELECT 'marital_status', marital_status, * FROM scored),
groups AS (
  SELECT attribute, member, count(*) AS n,
         count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS approved,
         count(CASE WHEN default_risk = 1 THEN 1 END) AS bad,
         count(CASE WHEN default_risk = 1 AND risk_score > 0.5 THEN 1 END) AS bad_flagged,
         count(CASE WHEN default_risk = 0 AND risk_score > 0.5 THEN 1 END) AS good_flagged,
         avg(risk_score) AS mean_score, avg(default_risk) AS bad_rate
  FROM members WHERE member IS NOT NULL GROUP BY attribute, member),
rates AS (
  SELECT attribute, member, n, approved / CAST(n AS DOUBLE) AS approval_rate,
         bad_flagged / CAST(nullif(bad, 0) AS DOUBLE) AS true_positive_rate,
         good_flagged / CAST(nullif(n - bad, 0) AS DOUBLE) AS false_positive_rate,
         abs(mean_score - bad_rate) AS calibration_gap
  FROM groups),
bias AS (
  SELECT attribute, min(approval_rate) / max(approval_rate) AS demographic_parity,
         1 - greatest(max(true_positive_rate) - min(true_positive_rate),
                      max(false_positive_rate) - min(false_positive_rate)) AS equalized_odds,
         1 - max(calibration_gap) AS calibration
  FROM rates GROUP BY attribute),
totals AS (
  SELECT attribute, sum(n) AS tn, sum(approved) AS ta, count(*) - 1 AS degrees_of_freedom
  FROM groups GROUP BY attribute),
chi AS (
  SELECT attribute, max(degrees_of_freedom) AS degrees_of_freedom,
         sum((approved - n * ta / tn) * (approved - n * ta / tn) / (n * ta / tn)
           + (approved - n * ta / tn) * (approved - n * ta / tn) / (n - n * ta / tn)) AS chi_square
  FROM groups JOIN totals USING (attribute) GROUP BY attribute),
cells AS (
  SELECT count(*) AS n, count(CASE WHEN decision = 'APPROVED' THEN 1 END) AS approved FROM scored
  GROUP BY floor(credit_score / 50), floor(annual_income / 25000), floor(debt_to_income * 10),
           floor(loan_amount / 25000)),
overall AS (
  SELECT 'demographic_parity' AS metric, min(demographic_parity) AS value FROM bias
  UNION ALL SELECT 'equalized_odds', min(equalized_odds) FROM bias
  UNION ALL SELECT 'calibration', min(calibration) FROM bias
  UNION ALL SELECT 'individual_fairness',
    1 - sum(2 * n * (approved / CAST(n AS DOUBLE)) * (1 - approved / CAST(n AS DOUBLE))) / sum(n) FROM cells)"""

# Long (model, label, score, prediction) rows of three score columns.
PREDICTIONS = """
predictions AS (
  SELECT model, label, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM (
    SELECT 'scorecard' AS model, default_risk AS label, risk_score AS score FROM scored
    UNION ALL SELECT 'debt', default_risk, debt_to_income FROM scored
    UNION ALL SELECT 'utilization', default_risk, credit_utilization FROM scored)
  WHERE score IS NOT NULL),
confusion AS (
  SELECT model, count(CASE WHEN label = 0 AND prediction = 0 THEN 1 END) AS tn,
         count(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp,
         count(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS fn,
         count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp
  FROM predictions GROUP BY model),
score_counts AS (
  SELECT model, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM predictions GROUP BY model, score),
ranked AS (
  SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp_so_far,
         sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp_so_far,
         sum(pos) OVER (PARTITION BY model) AS pos_total, sum(neg) OVER (PARTITION BY model) AS neg_total
  FROM score_counts),
auc AS (
  SELECT model, sum(pos * (CAST(neg_total - fp_so_far AS DOUBLE) + neg / CAST(2 AS DOUBLE)))
                / (max(pos_total) * CAST(max(neg_total) AS DOUBLE)) AS roc_auc
  FROM ranked GROUP BY model),
model_metrics AS (
  SELECT model, coalesce((tp + tn) / CAST(nullif(tn + fp + fn + tp, 0) AS DOUBLE), 0) AS accuracy,
         coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS "precision",
         coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
         coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1_score, roc_auc
  FROM confusion JOIN auc USING (model))"""

VIEW_CTES = [LINES, HISTORY, VIEW]
SCORED_CTES = [*VIEW_CTES, SCORED]


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body.strip()


def on_applications(body: str, *more: str) -> str:
    return sql(body, *VIEW_CTES, *more)


def on_scored(body: str, *more: str) -> str:
    return sql(body, *SCORED_CTES, *more)


def on_phi(body: str, *more: str) -> str:
    return on_scored(body, PHI, *more)


def on_portfolio(body: str, *more: str) -> str:
    return on_scored(body, SEGMENTED, *more)


def on_fairness(body: str, *more: str) -> str:
    return on_scored(body, FAIRNESS, *more)


def on_predictions(body: str, *more: str) -> str:
    return on_scored(body, PREDICTIONS, *more)


def on_audit(body: str, *more: str) -> str:
    return sql(body, AUDIT, *more)
