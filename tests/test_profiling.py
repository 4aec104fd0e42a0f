import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.operators import features, profiling, ranking, validation


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({
        "a": rng.normal(10, 3, n), "b": rng.exponential(2, n), "flat": np.full(n, 7.3),
        "group": rng.choice(["x", "y", "z"], n, p=[0.8, 0.1, 0.1]),
    })
    pdf["c"] = pdf["a"] * 2 + rng.normal(0, 1, n)
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::11, "group"] = None
    pdf["none"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
            for r in frame.itertuples(index=False)]
    return spark.createDataFrame(
        rows, "a double, b double, flat double, `group` string, c double, none double")


def close(got, expected):
    if expected is None or pd.isna(expected):
        return got is None
    return got == pytest.approx(expected, abs=1e-9)


def test_describe_matches_pandas(table, frame):
    got = {(r.column, r.stat): r.value for r in profiling.describe(table, digits=12).collect()}
    expected = frame[["a", "b", "flat", "c", "none"]].describe()
    for column in expected.columns:
        for stat in expected.index:
            assert close(got[column, stat], expected.loc[stat, column]), (column, stat)


def test_correlation_matches_pandas(table, frame):
    columns = ["a", "b", "flat", "c", "none"]
    got = {(r.feature_1, r.feature_2): r.r
           for r in profiling.correlation_matrix(table, columns).collect()}
    expected = frame[columns].corr()
    assert len(got) == 25
    for x in columns:
        for y in columns:
            assert close(got[x, y], expected.loc[x, y]), (x, y)
    strong = profiling.strong_correlations(table, columns).collect()
    assert [(r.feature_1, r.feature_2) for r in strong] == [("a", "c")]


def test_correlation_of_far_from_zero_values(spark):
    pdf = pd.DataFrame({"x": 1e9 + np.arange(100.0), "y": 1e9 + np.arange(100.0) ** 2})
    rows = profiling.correlation_matrix(spark.createDataFrame(pdf), ["x", "y"]).collect()
    assert {r.feature_1 + r.feature_2: r.r for r in rows}["xy"] == pytest.approx(pdf.corr().loc["x", "y"])


def test_quality_metrics(spark):
    df = spark.createDataFrame(
        [("u", 1, None), ("u", 1, None), (None, 1, 2.0), (None, 1, 2.0), (None, 1, 2.0), ("v", 2, 3.0)],
        "name string, k int, v double")
    row = profiling.quality_metrics(df).first()
    assert tuple(row) == (6, 3, 5, 3, 2, 1)
    missing = {r.column: r.missing_pct for r in profiling.missing_by_column(df).collect()}
    assert missing == {"name": 50.0, "v": 33.33}
    ratings = profiling.quality_ratings(profiling.quality_metrics(df)).first()
    assert (ratings.missing_rating, ratings.duplicate_rating) == ("Poor", "Poor")


def test_duplicates_with_shifted_nulls(spark):
    """Rows that hash alike because of nulls are not copies of each other."""
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    assert profiling.duplicate_count(df).first().duplicate_records == 1


def test_categorical_summary(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "x string, y string")
    rows = {r.column: tuple(r)[1:] for r in profiling.categorical_summary(df).collect()}
    assert rows == {"x": (2, "a", 1), "y": (0, "N/A", 0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double, s string")
    assert profiling.quality_metrics(df).first().total_records == 0
    assert {r.value for r in profiling.describe(df).collect() if r.stat != "count"} == {None}
    assert [r.r for r in profiling.correlation_matrix(df).collect()] == [None] * 4
    assert sum(r.n for r in profiling.histogram(df, "a", 5).collect()) == 0
    assert profiling.filter_reduction(df, []).first().reduction_pct is None


def test_histogram_counts_every_row(table, frame):
    rows = sorted(profiling.histogram(table, "b", 20).collect(), key=lambda r: r.bin)
    counts, _ = np.histogram(frame["b"].dropna(), 20)
    assert [r.n for r in rows] == list(counts)
    flat = profiling.histogram(table, "flat", 4).collect()
    assert sum(r.n for r in flat) == len(frame)


def test_box_statistics(table, frame):
    rows = {r["group"]: r for r in profiling.box_statistics(table, "b", "group").collect()}
    for name, part in frame.dropna(subset=["b", "group"]).groupby("group")["b"]:
        q1, q2, q3 = part.quantile([0.25, 0.5, 0.75])
        inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
        r = rows[name]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, q2, q3))
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert (r.outliers, r.n) == (len(part) - len(inside), len(part))


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, None), (None, "x"), (3.0, "y")], "v double, s string")
    kept = profiling.apply_filters(df, [profiling.NumericRange("v", 1, 2)]).count()
    assert kept == 2
    assert profiling.apply_filters(df, [profiling.CategorySet("s", ("x",))]).count() == 2
    assert profiling.apply_filters(df, [profiling.CategorySet("s", ("x", None))]).count() == 3
    row = profiling.filter_reduction(df, [profiling.CategorySet("s", (None,))]).first()
    assert (row.filtered_records, row.reduction_pct) == (1, 75.0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 1.5, 2.0, 99.0, -4.25]) | st.floats(-1e6, 1e6), min_size=1, max_size=80))
def test_quantiles_match_numpy(spark, values):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranking.column_quantiles(df, ["v"], probabilities).first().q
    assert got == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12, abs=1e-9)


def test_running_totals_with_a_hot_value(spark):
    """One value holds a third of all rows and there are more distinct values than buckets."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 500.0).otherwise((F.col("id") * 7919 % 6001).cast("double")).alias("v"))
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: (r.n, r.n_before, r.n_total)
           for r in ranking.cumulative(counts, [], "v", ["n"]).collect()}
    before = 0
    for v, n in sorted((r.v, r.n) for r in counts.collect()):
        assert got[v] == (n, before, 9000)
        before += n


def test_buckets_are_balanced(spark):
    skewed = spark.range(50000).select((F.col("id") * F.col("id") * F.col("id")).cast("double").alias("v"))
    sizes = [r["count"] for r in ranking.bucketed(skewed, [], "v").groupBy("bucket").count().collect()]
    assert len(sizes) == ranking.BUCKETS and max(sizes) < 3 * 50000 / ranking.BUCKETS


def test_scaling_and_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    for method, centre, width in [("standard", 22.0, np.std([1, 2, 3, 4, 100], ddof=1)),
                                  ("minmax", 1.0, 99.0), ("robust", 3.0, 2.0)]:
        got = [r.v for r in features.scale(df, ["v"], method).collect()]
        expected = [(v - centre) / width for v in [1, 2, 3, 4, 100]]
        assert sorted(x for x in got if x is not None) == pytest.approx(expected)
        assert got.count(None) == 1
    flags = {r.v: r.v_outlier for r in features.flag_outliers(df, ["v"]).collect()}
    assert flags == {1.0: False, 2.0: False, 3.0: False, 4.0: False, 100.0: True, None: False}
    capped = [r.v for r in features.handle_outliers(df, ["v"]).collect()]
    assert max(v for v in capped if v is not None) == 7.0 and None in capped
    assert features.handle_outliers(df, ["v"], handling="remove").count() == 5
    constant = features.scale(spark.createDataFrame([(2.0,), (2.0,)], "v double"), ["v"])
    assert [r.v for r in constant.collect()] == [None, None]


def test_validation(spark):
    df = spark.createDataFrame([(299, 10.0), (300, 0.0), (850, -1.0), (851, None), (None, 5.0)],
                               "credit_score int, annual_income double")
    row = validation.validation_report(df).first()
    assert (row.missing_columns, row.invalid_scores, row.invalid_income, row.is_valid) == (4, 2, 2, False)
    assert row.errors == [
        "Missing required columns: loan_amount, employment_length, debt_to_income, credit_utilization",
        "Invalid credit scores found in 2 rows", "Invalid income values found in 2 rows"]
    valid, bad = validation.split_valid(df)
    assert (valid.count(), bad.count()) == (1, 4)


def test_domain_and_ranges(spark):
    df = spark.createDataFrame([("RENT", 17), ("CASTLE", 18), (None, None)], "home_ownership string, age int")
    assert validation.domain_violations(df, {"home_ownership": ["RENT"]}).first().violations == 1
    assert validation.field_violations(df, {"age": (18, 100)}).first().violations == 1
    flags = df.select(validation.violated_rules({"age": (18, 100)}).alias("v")).collect()
    assert [r.v for r in flags] == [["age"], [], []]


def test_correlation_of_more_columns_than_bits_of_a_long(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(60, 70))
    values[rng.random(values.shape) < 0.02] = np.nan
    names = [f"c{i}" for i in range(70)]
    frame = pd.DataFrame(values, columns=names)
    df = spark.createDataFrame(frame).select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in names])
    found = {(r.feature_1, r.feature_2): r.r for r in profiling.correlation_matrix(df).collect()}
    expected = frame.corr()
    assert len(found) == 70 * 70
    assert all(found[a, b] == pytest.approx(expected.loc[a, b], abs=1e-9) for a in names for b in names)


def test_correlation_of_300_columns_with_random_gaps(spark):
    """No key by missing pattern: what the tasks send does not depend on where values are missing."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 300))
    base[:, 1::2] += base[:, ::2]
    base[rng.random(base.shape) < 0.3] = np.nan
    pdf = pd.DataFrame(base, columns=[f"c{i}" for i in range(300)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns)).repartition(4)
    found = profiling.correlation_matrix(df)
    got = found.toPandas().pivot(index="feature_1", columns="feature_2", values="r").loc[pdf.columns, pdf.columns]
    np.testing.assert_allclose(got.to_numpy(dtype=float), pdf.corr().to_numpy(), atol=1e-9)
    sent = [len(b) for b in profiling._co_moments(iter([pa.RecordBatch.from_pandas(pdf)]))]
    assert sent == [300 * 301 // 2]
