"""Boosted trees grown from sums: against MLlib's on the same bins, and independent of partitions."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import attribution, boosting, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(20) / 4, rng.randrange(25) / 8, rng.randrange(3)) for i in range(700)]
    rows = [(*r, int(r[1] + r[2] * r[3] + rng.gauss(0, 1.5) > 4.3)) for r in rows]
    table = spark.createDataFrame(rows, "id long, a double, b double, c int, y int")
    return session.materialize(models.training_matrix(table, FEATURES, "y"), "boosting")


def scores(model, rows):
    return {r.id: r.score for r in models.scored_rows("m", model, rows, ["id"]).collect()}


def nodes(model):
    return [(t.feature, t.cut, t.left, t.value) for t in attribution.ensemble(model, len(FEATURES)).trees]


def test_scores_are_those_of_mllib_where_all_rows_and_features_are_drawn(matrix):
    found = boosting.BoostedTrees(6, 3, seed=1, share=1.0, subset=1.0).fit(matrix)
    known = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.1, seed=1).fit(matrix)
    assert scores(found, matrix) == pytest.approx(scores(known, matrix), abs=1e-5)
    assert found.featureImportances.toArray() == pytest.approx(known.featureImportances.toArray(), abs=1e-4)
    assert found.treeWeights == pytest.approx(known.treeWeights) and found.numFeatures == 3


def test_trees_do_not_depend_on_partitions_nor_on_where_sums_are_added(matrix, monkeypatch):
    one = models.boosted_trees(6, 3).fit(matrix.repartition(1, F.rand(1)))
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    monkeypatch.setattr(boosting, "COLLECTED", 0)  # sums are added in Spark
    other = models.boosted_trees(6, 3).fit(matrix.repartition(7, F.rand(7)))
    assert nodes(one) == nodes(other) and one.featureImportances == other.featureImportances
    assert not matrix.sparkSession.sparkContext._jsc.getPersistentRDDs()  # what rounds keep is let go


def test_rows_are_drawn_anew_for_each_tree(matrix):
    model = boosting.BoostedTrees(4, 2, seed=3, share=0.5).fit(matrix)
    path = session.scratch_path(matrix.sparkSession, "test")
    model.write().save(path)
    roots = matrix.sparkSession.read.parquet(f"{path}/data").where("nodeData.id = 0").select("nodeData.impurityStats", "nodeData.rawCount").collect()
    drawn = [r.impurityStats[0] for r in roots]
    assert len(roots) == 4 and all(280 < n < 420 for n in drawn) and len(set(drawn)) > 1
    assert [r.rawCount for r in roots] == drawn


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(matrix, label):
    rows = matrix.withColumn("label", F.lit(float(label)))
    found = models.boosted_trees(3, 2).fit(rows).transform(rows).select("prediction", vector_to_array("probability")[1].alias("p")).distinct().collect()
    assert len(found) == 1 and found[0].prediction == label and abs(found[0].p - label) < 0.2


def test_no_rows_and_three_classes(matrix):
    with pytest.raises(ValueError):
        models.boosted_trees(2, 2).fit(matrix.limit(0))
    with pytest.raises(ValueError):
        models.boosted_trees(2, 2).fit(matrix.withColumn("label", F.col("id") % 3))
