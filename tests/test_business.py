import datetime

import pytest
from pyspark.sql import functions as F

from riskloom import policy
from riskloom.operators import audit, fairness, kpi, reports, rules, scoring, sinks
from riskloom import session


@pytest.mark.parametrize("name, value, level", [
    ("approval_rate", 0.70, None), ("approval_rate", 0.699, "warning"), ("approval_rate", 0.65, "warning"),
    ("approval_rate", 0.649, "error"), ("default_rate", 0.08, None), ("default_rate", 0.081, "warning"),
    ("default_rate", 0.12, "warning"), ("default_rate", 0.121, "error"), ("portfolio_growth", 0.0, "warning"),
    ("portfolio_growth", -0.01, "error"), ("profit_margin", None, None)])
def test_alert_levels(spark, name, value, level):
    rows = spark.createDataFrame([("p", name, value)], "period string, kpi string, value double")
    found = kpi.alerts_of(rows, "period").collect()
    assert [r.level for r in found] == ([level] if level else [])
    if level == "error" and name == "default_rate":
        assert found[0].message == "Critical: Default Rate at 12.1%"


def test_all_clear_and_gauges(spark):
    kpis = spark.createDataFrame([("m", 0.78, 0.045, 0.16, 0.12)],
                                 "month string, approval_rate double, default_rate double, "
                                 "profit_margin double, portfolio_growth double")
    assert kpi.all_clear(kpis).first().message == policy.ALL_CLEAR
    gauges = {r.kpi: r for r in kpi.kpi_gauges(kpis).collect()}
    assert gauges["default_rate"].gauge_status == "warning"
    assert gauges["default_rate"].kpi_status == "on_target"
    assert gauges["profit_margin"].gap == pytest.approx(0.01)


def test_series(spark):
    days = spark.createDataFrame([(f"2024-01-0{i}", i) for i in range(1, 6)], "date string, v int")
    totals = [r.v for r in kpi.running_totals(days, "date", ["v"]).orderBy("date").collect()]
    assert totals == [1, 3, 6, 10, 15]
    assert kpi.latest(days, "date", ["v"]).first().v == 5
    deltas = [r.delta for r in kpi.period_change(days, "date", "v").orderBy("date").collect()]
    assert deltas == [None, 1, 1, 1, 1]


def test_week_ends_on_sunday(spark):
    rows = spark.createDataFrame([("2024-01-01", "APPROVED"), ("2024-01-07", "REVIEW"), ("2024-01-08", "REVIEW")],
                                 "application_ts string, decision string") \
        .withColumn("application_ts", F.to_timestamp("application_ts"))
    got = {r.week: (r.applications, r.approvals) for r in kpi.weekly_summary(rows).collect()}
    assert got == {datetime.date(2024, 1, 7): (2, 1), datetime.date(2024, 1, 14): (1, 0)}


def test_eligibility(spark):
    df = spark.createDataFrame([(76, 24999.0, 1000001.0, 299, 0.51, 0.45, 6, 11), (75, 25000.0, 1000000.0, 300, 0.5, 0.5, 5, 12),
                                (30, 30000.0, 1000.0, 700, None, 1.0, 0, None)],
                               "age int, annual_income double, loan_amount double, credit_score int, "
                               "debt_to_income double, employment_length double, inquiries_6mths int, credit_history_months int")
    rows = rules.eligibility(df).collect()
    assert rows[0].reasons == ["age", "income", "loan_amount", "credit_score", "debt_to_income", "employment_history", "inquiries",
                               "credit_history"]
    assert rows[1].eligible and rows[2].reasons == ["debt_to_income", "credit_history"]


def test_error_alerts(spark):
    rows = [("2024-01-01 10:00:00", "Failed")] + [("2024-01-01 11:00:00", "Success")] * 99 + \
        [("2024-01-02 10:00:00", "Failed")] * 2 + [("2024-01-02 11:00:00", "Success")] * 98 + [("2024-01-03 00:00:00", None)]
    df = spark.createDataFrame(rows, "timestamp string, status string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    found = audit.error_alerts(df).collect()
    assert [(str(r.date), r.n, r.failed, r.error_rate) for r in found] == [("2024-01-02", 100, 2, 0.02)]


def test_pseudonymise(spark):
    df = spark.createDataFrame([("C1", 37, "192.168.4.5")], "customer_id string, age int, ip string")
    row = rules.pseudonymise(df, "s", age="age", ip="ip").first()
    assert len(row.customer_id) == 64 and (row.age, row.ip) == ("30s", "192.168.0.0")


def person(sex, approved, bad, score):
    return (sex, "APPROVED" if approved else "REVIEW", bad, score)


@pytest.fixture
def groups(spark):
    rows = [person("f", i < 45, int(i < 10), 0.7 if i < 8 else 0.2) for i in range(50)] \
        + [person("m", i < 30, int(i < 10), 0.7 if i < 4 else 0.2) for i in range(50)] + [person(None, True, 0, 0.1)]
    df = spark.createDataFrame(rows, "sex string, decision string, default_risk int, risk_score double")
    return fairness.group_counts(df, ["sex"])


def test_fairness_formulas(groups):
    row = fairness.bias_metrics(groups).first()
    assert row.demographic_parity == pytest.approx(0.6 / 0.9)
    assert row.equalized_odds == pytest.approx(1 - 0.4)
    assert row.calibration == pytest.approx(1 - 0.08)
    assert row.degrees_of_freedom == 1 and row.chi_square == pytest.approx(12.0) and row.significant
    alerts = {r.metric for r in fairness.bias_alerts(fairness.bias_metrics(groups)).collect()}
    assert alerts == {"demographic_parity", "equalized_odds"}


def test_chi_square_tail(spark):
    known = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (24.995790, 15, 0.05), (124.342113, 100, 0.05),
             (10.827566, 1, 0.001), (0.0, 3, 1.0), (1e9, 2, 0.0), (0.102587, 2, 0.95), (1074.679, 1000, 0.05), (5.0, 0, None)]
    df = spark.createDataFrame(known, "x double, k int, p double").withColumn("q", fairness.chi_square_tail(F.col("x"), F.col("k")))
    for r in df.collect():
        assert r.q == (None if r.p is None else pytest.approx(r.p, rel=1e-4, abs=1e-12)), r


def test_consistency_equals_the_row_form(spark):
    rows = [(700, 50000.0, 0.25, 10000.0, "APPROVED" if i % 4 else "REVIEW") for i in range(20)] \
        + [(500, 50000.0, 0.25, 10000.0, "REVIEW")] * 5
    df = spark.createDataFrame(rows, "credit_score int, annual_income double, debt_to_income double, "
                                     "loan_amount double, decision string")
    expected = 1 - (15 * 0.25 + 5 * 0.75) / 25
    assert fairness.individual_fairness(df).first().individual_fairness == pytest.approx(expected)


def test_counterfactual(spark):
    """Only the outcome that reads the flipped attribute changes; other attributes keep their values."""
    df = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "a", None)], "id int, kind string, ok boolean")
    rows = fairness.counterfactual_fairness(df, {
        "ok": (lambda: F.col("ok") & (F.col("kind") != "c"), F.lit(True)),
        "kind": (lambda: F.col("id") > 1, F.lit("c")),
        "id": (lambda: F.col("id") + F.length("kind"), F.when(F.col("kind") == "a", F.col("id")).otherwise(0)),
    }).collect()
    assert {r.attribute: round(r.counterfactual_fairness, 6) for r in rows} == {"ok": 0.333333, "kind": 1.0, "id": 0.666667}


def test_verdict(spark):
    schema = "metric string, value double, passed boolean"
    good = spark.createDataFrame([("a", 0.95, True)], schema)
    bad = spark.createDataFrame([("a", 0.95, True), ("b", 0.89, False)], schema)
    assert fairness.verdict(good).first()[0] == "PASS"
    assert fairness.verdict(bad).first()[0] == "REVIEW_REQUIRED"


def test_report_text(spark, scoring_rows):
    scored = scoring.score(scoring_rows([(1, 720, 75000.0, 0.30, 5.0, 25000.0, 0.25)]))
    path = sinks.write_report(reports.batch_report(scored), session.scratch_path(spark, "report"))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["- Total Records Processed: 1", "- Approved Applications: 1 (100.0%)",
                     "- Applications Requiring Review: 0 (0.0%)", "- Rejected Applications: 0 (0.0%)",
                     "- Average Risk Score: 27.3%", "- Model Version: 2.0.0", "- Low Risk: 1"]


def test_status_share(spark):
    df = spark.createDataFrame([("Compliant",)] * 4 + [("Review Required",)], "status string")
    row = audit.status_share(df, "status", "Compliant").first()
    assert tuple(row) == (4, 5, 80.0)
    assert [r.n for r in audit.status_counts(df, "status").collect()] == [4, 1]
