import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom import policy
from riskloom.functions import scalar, scorecard
from riskloom.operators import scoring


def plain_score(cs, income, dti, emp, loan, util):
    """The scorecard by hand, for complete rows."""
    return min((1 - min(cs / 850, 1.0)) * 0.25 + max(0, (100000 - income) / 100000) * 0.20 + dti * 0.20
               + max(0, (10 - emp) / 10) * 0.15 + min(loan / 100000, 1.0) * 0.10 + util * 0.10, 1.0)


def test_form_defaults(scoring_rows):
    row = scoring.with_recommendations(
        scoring.score(scoring_rows([(1, 720, 75000.0, 0.30, 5.0, 25000.0, 0.25)]))).first()
    assert row.risk_score == pytest.approx(0.2732353, abs=1e-7)
    assert (row.risk_category, row.decision) == ("Low Risk", "APPROVED")
    assert row.recommendations == [policy.RECOMMEND_NONE]


def test_template_scores(spark):
    rows = scoring.score(policy.sample_template(spark)).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.risk_score == plain_score(
            r.credit_score, r.annual_income, r.debt_to_income, r.employment_length, r.loan_amount,
            r.credit_utilization)
    assert max(rows, key=lambda r: r.risk_score).customer_id == "CUST_0010"


@pytest.mark.parametrize("score, band, decided, individual, level", [
    (0.0, "Very Low Risk", "APPROVED", "APPROVED", "Low"),
    (0.1, "Very Low Risk", "APPROVED", "APPROVED", "Low"),
    (0.3, "Low Risk", "APPROVED", "APPROVED", "Low"),
    (0.6, "Medium Risk", "REVIEW", "REVIEW REQUIRED", "Medium"),
    (0.8, "High Risk", "REJECTED", "HIGH RISK", "High"),
    (1.0, "Very High Risk", "REJECTED", "HIGH RISK", "High"),
    (-0.1, "Medium Risk", "APPROVED", "APPROVED", "Low"),
    (1.2, "Medium Risk", "REJECTED", "HIGH RISK", "High"),
    (None, "Medium Risk", "REJECTED", "HIGH RISK", "Low"),
])
def test_cut_points(spark, score, band, decided, individual, level):
    s = F.col("s")
    row = spark.createDataFrame([(score,)], "s double").select(
        scorecard.risk_category(s).alias("band"), scorecard.decision(s).alias("decided"),
        scorecard.decision(s, policy.INDIVIDUAL_DECISIONS).alias("individual"),
        scorecard.risk_level(s).alias("level")).first()
    assert tuple(row) == (band, decided, individual, level)


@pytest.mark.parametrize("position", range(1, 7))
def test_missing_input_gives_missing_score(scoring_rows, position):
    values = [1, 700, 50000.0, 0.3, 5.0, 20000.0, 0.3]
    values[position] = None
    row = scoring.score(scoring_rows([tuple(values)])).first()
    assert (row.risk_score, row.risk_category, row.decision) == (None, "Medium Risk", "REJECTED")


def test_cap_and_negative(scoring_rows):
    rows = scoring.score(scoring_rows([
        (1, 300, 0.0, 1.5, 0.0, 200000.0, 1.5), (2, 850, 200000.0, -0.1, 20.0, 0.0, -0.1)])) \
        .orderBy("application_id").collect()
    assert rows[0].risk_score == 1.0 and rows[0].risk_category == "Very High Risk"
    assert rows[1].risk_score == pytest.approx(-0.03) and rows[1].risk_category == "Medium Risk"


def test_all_recommendations_in_order(scoring_rows):
    row = scoring.with_recommendations(
        scoring.score(scoring_rows([(1, 400, 0.0, 0.9, 1.0, 99000.0, 0.9)]))).first()
    assert row.recommendations == [
        policy.RECOMMEND_SCORE, policy.RECOMMEND_DEBT, policy.RECOMMEND_UTILIZATION,
        policy.RECOMMEND_EMPLOYMENT, policy.RECOMMEND_COSIGNER, policy.RECOMMEND_DOCUMENTS]


money = st.floats(0, 300000, allow_nan=False)
ratio = st.floats(-0.5, 2, allow_nan=False)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(250, 900), money, ratio, st.floats(0, 50), money, ratio),
                min_size=1, max_size=50))
def test_matches_plain_arithmetic(scoring_rows, cases):
    df = scoring_rows([(i, *c) for i, c in enumerate(cases)])
    got = {r.application_id: r.risk_score for r in scoring.score(df).collect()}
    for i, (cs, income, dti, emp, loan, util) in enumerate(cases):
        assert got[i] == plain_score(cs, income, dti, emp, loan, util)
    sums = scoring.contributions_long(df).groupBy("application_id").agg(F.sum("contribution").alias("s"))
    for r in sums.collect():
        assert min(r.s, 1.0) == pytest.approx(got[r.application_id])


def test_batch_summary_of_nothing(scoring_rows):
    row = scoring.batch_summary(scoring.score(scoring_rows([]))).first()
    assert row.total_records == 0 and row.approved_share is None and row.avg_risk_score is None


def test_breakdown_breaks_ties_by_order(scoring_rows):
    row = scoring.factor_breakdown(scoring_rows([(1, 850, 200000.0, 0.5, 20.0, 0.0, 1.0)])).first()
    assert row.top_feature == "Debt-to-Income"
    assert [x.feature for x in row.leading] == policy.SCORE_LABELS[:3]
    assert [x.feature for x in row.remaining] == policy.SCORE_LABELS[3:]


@pytest.mark.parametrize("share, text", [
    (0.4125, "41.2%"), (0.4175, "41.8%"), (0.0, "0.0%"), (12.345, "1234.5%"), (None, None)])
def test_percent_rounds_ties_to_even(spark, share, text):
    assert spark.createDataFrame([(share,)], "x double").select(
        scalar.percent(F.col("x")).alias("p")).first().p == text


def test_scalar_rules(spark):
    row = spark.range(1).select(
        scalar.currency(F.lit(1234567.5)), scalar.title_case(F.lit("default_rate")),
        scalar.customer_code(F.lit(42)), scalar.customer_code(F.lit(1234567)),
        scalar.clip(F.lit(None).cast("double"), 0.0, 1.0), scalar.clip(F.lit(7.0), 0.0, 1.0),
        scalar.escalation_level(F.lit(29)), scalar.escalation_level(F.lit(400)),
        scalar.gauge_status(F.lit(0.045), F.lit(0.05)), scalar.score_band(F.lit(739)),
        scalar.policy_decision(F.lit(0.8))).first()
    assert tuple(row) == ("$1,234,568", "Default Rate", "CUST_00042", "CUST_1234567", None, 1.0, 0, 3,
                          "warning", "good", "SENIOR_REVIEW")


def test_policy_tables_are_consistent():
    assert policy.AUTO_APPROVE < policy.MANUAL_REVIEW < policy.AUTO_REJECT
    assert sum(w for _, _, w in policy.SCORE_TERMS) == pytest.approx(1)
    assert sum(w for _, w, _ in policy.RISK_FACTORS) == pytest.approx(1)
    assert all(a[1] == b[0] for a, b in zip(policy.RISK_BANDS, policy.RISK_BANDS[1:]))
    assert set(policy.REQUIRED_COLUMNS) == set(policy.SCORE_INPUTS)
