import json
import random

import pytest
from pyspark.sql import functions as F

from riskloom import policy
from riskloom.operators import explain, models, scoring


@pytest.fixture
def cases(scoring_rows):
    rng = random.Random(5)
    return scoring_rows([
        (i, rng.randint(300, 850), rng.uniform(2e4, 2e5), rng.random(), rng.uniform(0, 20),
         rng.uniform(1e3, 2e5), rng.random()) for i in range(60)
    ] + [(99, None, 5e4, 0.2, 3.0, 1e4, 0.2)])


def test_attributions_add_up(cases):
    rows = explain.scorecard_attribution(cases)
    sums = rows.groupBy("application_id").agg((F.max("base") + F.sum("phi")).alias("total"))
    scores = {r.application_id: r.risk_score for r in scoring.score(cases).collect()}
    got = {r.application_id: r.total for r in sums.collect()}
    assert 99 not in got and len(got) == 60
    for key, total in got.items():
        assert min(total, 1.0) == pytest.approx(scores[key], abs=1e-9)
    means = rows.groupBy("feature").agg(F.avg("phi").alias("m")).collect()
    assert all(r.m == pytest.approx(0, abs=1e-12) for r in means)


def test_waterfall_ends_at_the_score(cases):
    last = explain.waterfall(cases).filter("step = 7").collect()
    scores = {r.application_id: r.risk_score for r in scoring.score(cases).collect()}
    assert all(min(r.running, 1.0) == pytest.approx(scores[r.application_id]) for r in last)


def test_importance_matches_long_form(cases):
    wide = {r.feature: (r.importance, r.rank) for r in explain.global_importance(cases).collect()}
    long = {r.feature: (r.importance, r.rank)
            for r in explain.importance_of(explain.scorecard_attribution(cases)).collect()}
    assert set(wide) == set(long) == set(policy.SCORE_LABELS)
    for feature in wide:
        assert wide[feature][0] == pytest.approx(long[feature][0]) and wide[feature][1] == long[feature][1]


def test_partial_dependence_against_rescoring(cases):
    rows = sorted(explain.partial_dependence(cases, "loan_amount", 5).collect(), key=lambda r: r.point)
    complete = cases.dropna()
    for r in rows:
        fixed = complete.withColumn("loan_amount", F.lit(r.feature_value))
        expected = scoring.score(fixed).agg(F.avg("risk_score").alias("m")).first().m
        assert r.mean_score == pytest.approx(expected)


def test_what_if_takes_means(cases, spark):
    scenario = spark.createDataFrame([(1, 700.0)], "scenario_id int, credit_score double")
    row = explain.what_if(cases, scenario).first()
    assert row.credit_score == 700.0
    assert row.annual_income == pytest.approx(cases.agg(F.avg("annual_income")).first()[0])


def test_documents(cases):
    document = json.loads(explain.scorecard_documents(cases, "2001-01-01").first().document)
    total = document["expected_value"] + sum(document["feature_contributions"].values())
    assert document["prediction"] == pytest.approx(total)
    attributions = explain.scorecard_attribution(cases)
    long = json.loads(explain.explanation_documents(
        attributions, explain.summed_prediction(), "2001-01-01").first().document)
    assert set(long) == set(document)


def test_sample_is_repeatable(cases):
    first = {r.application_id for r in explain.summary_points(cases, sample=10).collect()}
    again = {r.application_id for r in explain.summary_points(cases.repartition(5), sample=10).collect()}
    assert first == again and len(first) == 10


def test_dependence_of_a_model(spark):
    """Grid means equal scoring the whole table with the feature set by hand."""
    rng = random.Random(3)
    features = ["a", "b"]
    df = spark.createDataFrame([(rng.random(), rng.random()) for _ in range(100)] + [(None, 0.5)], "a double, b double") \
        .withColumn("y", (F.col("a") > 0.5).cast("int"))
    forest = models.random_forest(5, 3).fit(models.training_matrix(df, features, "y"))
    found = explain.model_dependence(forest, df, features, "a", points=5).orderBy("point").collect()
    low, high = df.agg(F.min("a"), F.max("a")).first()
    assert [r.feature_value for r in found] == pytest.approx([low + (high - low) / 4 * i for i in range(5)])
    for r in found:
        fixed = models.training_matrix(df.dropna().withColumn("a", F.lit(r.feature_value)), features, "y")
        mean = models.scored_rows("m", forest, fixed).agg(F.avg("score")).first()[0]
        assert r.mean_score == pytest.approx(mean)
    assert explain.model_dependence(forest, df.limit(0), features, "a").count() == 0


def test_sampled_attribution_of_a_forest(spark):
    """Base plus attributions equals the forest's probability for every row."""
    rng = random.Random(2)
    features = ["a", "b", "c"]
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double") \
        .withColumn("y", (F.col("a") + F.col("b") > 1).cast("int"))
    matrix = models.training_matrix(df, features, "y")
    forest = models.random_forest(8, 4).fit(matrix)
    phi = explain.sampled_shapley(forest, df, df, features, "id", permutations=3, n_background=5)
    totals = {r.id: r.total for r in phi.groupBy("id").agg(
        (F.max("base") + F.sum("phi")).alias("total")).collect()}
    predicted = {r.id: r.score for r in models.scored_rows("f", forest, matrix, ["id"]).collect()}
    assert len(totals) == 120
    assert all(totals[i] == pytest.approx(predicted[i], abs=1e-9) for i in totals)
    importance = {r.feature: r.importance for r in explain.importance_of(phi).collect()}
    assert importance["c"] < min(importance["a"], importance["b"])
