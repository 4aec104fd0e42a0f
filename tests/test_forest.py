"""The forest grown from counts: draws, splits and stored form."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import attribution, explain, forest, models

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.gauss(0, 1), rng.randrange(4), rng.choice([0.5, 0.25, rng.random()])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c int, d double")
    return df.withColumn("y", ((F.col("a") + F.col("c") / 4 > 0.9) & (F.col("b") < 1)).cast("int"))


def nodes(model):
    return [(t.feature, t.left, t.value) for t in attribution.ensemble(model, len(FEATURES)).trees]


def test_trees_do_not_depend_on_partitions(table):
    matrix = models.training_matrix(table, FEATURES, "y")
    one, other = (models.random_forest(6, 5).fit(matrix.repartition(n, F.rand(n))) for n in (1, 7))
    assert nodes(one) == nodes(other)
    scores = lambda m: {r.id: r.score for r in models.scored_rows("m", m, matrix, ["id"]).collect()}
    assert scores(one) == pytest.approx(scores(other)) and one.featureImportances == other.featureImportances


def test_splits_are_the_best_of_the_bootstrap(table):
    """The root of a tree of one bootstrap, which has all features, against all cuts."""
    matrix = models.training_matrix(table, FEATURES, "y")
    model = models.random_forest(1, 1).fit(matrix)
    x = vector_to_array("features")
    rows = matrix.select(x.alias("x"), "label", F.xxhash64(*[c for c in matrix.columns if c != "features"], x).alias("key")).collect()
    keys = np.array([r.key for r in rows], np.int64).view(np.uint64)
    times = forest._poisson()[forest._mixed(forest._mixed(keys + np.uint64(models.SEED))).view(np.uint16)[::4]]
    assert 0.85 < times.mean() < 1.15 and 0.3 < (times == 0).mean() < 0.45
    values, label = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    gini = lambda kept: 0.0 if not times[kept].sum() else 1 - sum((times[kept & (label == k)].sum() / times[kept].sum()) ** 2 for k in (0, 1))
    gains = []
    for j, cuts in enumerate(forest.thresholds(matrix.select(x.alias("x")), 4)):
        for cut in cuts:
            left = values[:, j] <= cut
            share = times[left].sum() / times.sum()
            gains.append((gini(label >= 0) - share * gini(left) - (1 - share) * gini(~left), j, cut))
    best, j, cut = max(gains)
    root = attribution.ensemble(model, 4)
    assert root.trees[0].feature[0] == j and root.thresholds[j].tolist() == [cut]
    again = model.transform(matrix).select(vector_to_array("probability")[1]).distinct().count()
    assert again == 2 and best > 0


def test_equal_rows_are_drawn_each_for_itself(spark):
    df = spark.createDataFrame([(1.0, 1)] * 3000 + [(0.0, 0)] * 3000, "a double, y int").coalesce(1)
    model = models.random_forest(4, 2).fit(models.training_matrix(df, ["a"], "y"))
    path = attribution.session.scratch_path(spark, "test")
    model.write().save(path)
    roots = [sum(r.s) for r in spark.read.parquet(f"{path}/data").where("nodeData.id = 0").select(F.col("nodeData.impurityStats").alias("s")).collect()]
    assert all(5600 < n < 6400 for n in roots) and len(set(roots)) > 1


@pytest.mark.parametrize("labels", [[0, 0, 0, 0], [1, 1, 1, 1], [0, 1, 2, 2]])
def test_one_class_and_three(spark, labels):
    df = spark.createDataFrame([(float(i % 4), labels[i % 4]) for i in range(80)], "a double, y int")
    model = models.random_forest(5, 3).fit(models.training_matrix(df, ["a"], "y"))
    found = model.transform(models.training_matrix(df, ["a"], "y")).select("y", "prediction").distinct().collect()
    assert all(r.y == r.prediction for r in found)


def test_no_rows(table):
    with pytest.raises(ValueError):
        models.random_forest(2, 2).fit(models.training_matrix(table.limit(0), FEATURES, "y"))


def test_bundles_have_the_codes_of_all_leaves(table):
    trees = attribution.ensemble(models.random_forest(5, 8).fit(models.training_matrix(table, FEATURES, "y")), 4)
    values = np.array([tuple(r) for r in table.select(*[F.col(c).cast("double") for c in FEATURES]).collect()])
    above = trees.above(values)
    for tree in trees.trees:
        leaves = list(tree.leaves())
        bundles = list(tree.bundles(above))
        assert [leaf for node, path, _ in bundles for leaf in ((n, p) for n, p, _ in tree.bundled(node, path))] == leaves
        assert len(bundles) < len(leaves)
        inside = sum((outside[code] == 0).astype(int) for node, path, code in bundles for _, _, outside in tree.bundled(node, path))
        assert (inside == 1).all()  # a row is in the box of one leaf


@pytest.mark.parametrize("cells", [1, 12, 1 << 11])
def test_codes_tell_the_features_in_which_a_leaf_is_left(table, monkeypatch, cells):
    """Many leaves are looked up at once; their boxes are those of the splits on their paths."""
    monkeypatch.setattr(attribution, "CELLS", cells)
    trees = attribution.ensemble(models.random_forest(5, 9).fit(models.training_matrix(table, FEATURES, "y")), 4)
    values = np.array([tuple(r) for r in table.select(*[F.col(c).cast("double") for c in FEATURES]).collect()])
    above = trees.above(values)

    def splits(tree, node, taken=()):
        if tree.feature[node] < 0:
            yield node, taken
        else:
            yield from splits(tree, tree.left[node], (*taken, (tree.feature[node], tree.cut[node], 0)))
            yield from splits(tree, tree.right[node], (*taken, (tree.feature[node], tree.cut[node], 1)))

    many = 0
    for tree in trees.trees:
        paths, bundles = dict(splits(tree, 0)), list(tree.bundles(above))
        many += len(paths) > 5 * len(bundles)
        for node, path, code in bundles:
            assert code.max() < tree.cells(node) <= max(cells, 1 << len(path))
            for leaf, features, outside in tree.bundled(node, path):
                left = np.zeros(len(values), int)
                for feature, cut, side in paths[leaf]:
                    left |= (above[feature][cut] != side).astype(int) << features.index(feature)
                assert (outside[code] == left).all()
    assert cells < 1 << 11 or many == len(trees.trees)


def test_dependence_counts_rows_and_scores_none(table, monkeypatch):
    """The forest's means come from counts; scoring every row at every point gives the same."""
    model = models.random_forest(6, 6).fit(models.training_matrix(table, FEATURES, "y"))
    with monkeypatch.context() as m:
        m.setattr(type(model), "transform", lambda *_: pytest.fail("rows were scored"))
        found = explain.model_dependence(model, table, FEATURES, "a", 9).orderBy("point").collect()
    for r in found:
        fixed = models.training_matrix(table.withColumn("a", F.lit(r.feature_value)), FEATURES, "y")
        assert r.mean_score == pytest.approx(models.scored_rows("m", model, fixed).agg(F.avg("score")).first()[0])
