import math
import random
import time
from multiprocessing.pool import ThreadPool
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import encoding, evaluation, models, registry
from riskloom.plans import models as plans

FEATURES = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def planted(spark):
    """Eight normal features, a linear signal in the first four."""
    rng = random.Random(42)
    rows = []
    for i in range(800):
        x = [rng.gauss(0, 1) for _ in range(8)]
        signal = 0.3 * x[0] + 0.2 * x[1] - 0.25 * x[2] + 0.15 * x[3] + rng.gauss(0, 0.1)
        rows.append((i, *x, int(signal > 0)))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", y int")
    folded = models.assign_folds(models.assign_split(df, "id"), "y", "id")
    return models.training_matrix(session.materialize(folded, "planted"), FEATURES, "y")


@pytest.mark.parametrize("name, estimator, floor", [
    ("forest", lambda: models.random_forest(20, 6), 0.9),
    ("linear", lambda: models.logistic_regression(640), 0.95),
    ("boosted", lambda: models.boosted_trees(10, 3), 0.85),
    ("kernel", lambda: models.KernelMachine(FEATURES, components=96, iterations=20), 0.85),
])
def test_holdout_auc(planted, name, estimator, floor):
    model = estimator().fit(planted.filter("split <> 'test'"))
    row = models.holdout_evaluation({name: model}, planted.filter("split = 'test'")).first()
    assert row.model == name and row.roc_auc > floor


def test_kernel_machine_learns_a_circle(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(600)]
    df = spark.createDataFrame([(a, b, int(a * a + b * b < 0.5)) for a, b in rows], "a double, b double, y int")
    matrix = models.training_matrix(df, ["a", "b"], "y")
    auc = lambda m: evaluation.roc_auc(models.scored_rows("m", m, matrix)).first().roc_auc
    machine = models.KernelMachine(["a", "b"]).fit(matrix)
    assert machine.report["converged"] and machine.report["gradient_norm"] <= machine.report["limit"]
    assert auc(machine) >= 0.99
    assert not models.KernelMachine(["a", "b"], iterations=2).fit(matrix).report["converged"]
    assert auc(models.logistic_regression(600).fit(matrix)) < 0.7


def test_stored_models_score_alike(planted, spark):
    train, holdout = planted.filter("split <> 'test'"), planted.filter("split = 'test'")
    fitted = {"forest": models.random_forest(5, 3).fit(train), "kernel": models.KernelMachine(FEATURES, 16, 5).fit(train)}
    stored = {name: models.save(m, session.scratch_path(spark, "model")) for name, m in fitted.items()}
    metrics = models.holdout_evaluation(fitted, holdout)
    records = models.registry_records(metrics, "v1", "2001-01-01", "Production", stored)
    loaded = models.load_current(models.register(records, session.scratch_path(spark, "registry")))
    again = models.holdout_evaluation(loaded, holdout)
    key = lambda df: sorted((r.model, *[round(r[m], 12) for m in evaluation.METRICS]) for r in df.collect())
    assert key(again) == key(metrics) and set(loaded) == set(fitted)


def test_fits_do_not_share_state(planted):
    machine = models.KernelMachine(FEATURES, 8, 3)
    one, two = machine.fit(planted.filter("x0 > 0")), machine.fit(planted.filter("x0 <= 0"))
    assert one is not two and one.moments[0][0] > 0 > two.moments[0][0]


def test_evaluation_in_one_pass(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.9, 1), ("a", 0, 0.9, 1), ("a", 0, 0.1, 0), ("a", None, 0.5, 1), ("a", 1, 0.2, None), ("b", None, 0.5, 1)],
        "model string, label int, score double, prediction int")
    separate = evaluation.classification_metrics(evaluation.confusion(rows)).join(evaluation.roc_auc(rows), "model", "left")
    assert sorted(evaluation.evaluate(rows).collect()) == sorted(separate.select(evaluation.evaluate(rows).columns).collect())


def test_importance_ranks_the_signal(planted, spark):
    linear = models.logistic_regression(800).fit(planted)
    rows = models.feature_importance("linear", linear, spark, FEATURES).orderBy("rank").collect()
    assert {r.feature for r in rows[:4]} == set(FEATURES[:4])
    assert models.feature_importance("kernel", object(), spark, FEATURES).count() == 0
    kept = models.select_features(spark.createDataFrame([("a", 0.5), ("b", 0.001)], "feature string, importance double"))
    assert [r.feature for r in kept.collect()] == ["a"]


def test_cross_validation(planted):
    scores = models.cross_validate({"linear": models.logistic_regression(640)}, planted)
    assert scores.count() == 5
    row = models.cross_validation_summary(scores).first()
    assert row.mean_auc > 0.95 and 0 <= row.std_auc < 0.05 and len(row.scores) == 5


def test_fits_side_by_side_ship_once(monkeypatch):
    """Fits of a cross-validation start at once; adding the package's file twice at once is an error."""
    monkeypatch.setattr(session, "_shipped", {})
    added = []

    def add(path):
        time.sleep(0.2)
        added.append(path)

    context = SimpleNamespace(applicationId="side-by-side", addPyFile=add)
    with ThreadPool(4) as pool:
        pool.map(session.ship, [SimpleNamespace(sparkContext=context)] * 4)
    assert len(added) == 1


def test_registry(spark):
    metrics = spark.createDataFrame([("m", 0.9, 0.8, 0.7, 0.6, 0.5)], "model string, " + ", ".join(
        f"{m} double" for m in evaluation.METRICS))
    path = session.scratch_path(spark, "registry")
    models.register(models.registry_records(metrics, "v1", "2001-01-01", "Production"), path)
    models.register(models.registry_records(metrics, "v2", "2001-03-01", "Production"), path)
    listing = models.register(models.registry_records(metrics, "v3", "2001-02-01", "Staging"), path)
    assert listing.count() == 3
    current = {r.status: r.version for r in models.current_models(listing).collect()}
    assert current == {"Production": "v2", "Staging": "v3"}


def test_kernel_fit_is_the_minimum(planted):
    """The weights solve the problem that a plain Newton loop over the same features solves."""
    machine = models.KernelMachine(FEATURES, components=12).fit(planted)
    table = np.array([[*[r[f] for f in FEATURES], r.label] for r in planted.select(*FEATURES, "label").collect()])
    x, y = table[:, :-1], 2 * table[:, -1] - 1
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    frequencies, phases = machine._directions()
    z = np.column_stack([np.cos(x @ frequencies.T + phases) * np.sqrt(2 / 12), np.ones(len(x))])
    ridge = np.diag([machine.penalty] * 12 + [0.0])
    loss = lambda w: (np.maximum(0, 1 - y * (z @ w)) ** 2).mean() + 0.5 * w @ ridge @ w
    best = loss(np.array(machine.weights))
    assert abs(best - machine.report["loss"]) < 1e-9
    rng = np.random.default_rng(3)
    assert all(loss(np.array(machine.weights) + d) >= best - 1e-9 for d in rng.normal(0, 0.01, (200, 13)))


def _records(spark, version, status="Production", name="m"):
    metrics = spark.createDataFrame([(name, 0.9, 0.8, 0.7, 0.6, 0.5)], "model string, " + ", ".join(f"{m} double" for m in evaluation.METRICS))
    return models.registry_records(metrics, version, "2001-01-01", status)


def test_writers_at_the_same_time(spark):
    path = session.scratch_path(spark, "registry")
    with ThreadPool(6) as pool:
        pool.map(lambda i: registry.register(_records(spark, f"v{i}", "Staging"), path), range(6))
    found = registry.read(spark, path)
    assert sorted(r.version for r in found.collect()) == [f"v{i}" for i in range(6)]
    assert sorted(r.number for r in registry.history(spark, path).collect()) == [1, 2, 3, 4, 5, 6]

    def same(_):
        try:
            registry.register(_records(spark, "v9"), path)
            return 1
        except ValueError:
            return 0
    with ThreadPool(4) as pool:
        assert sum(pool.map(same, range(4))) == 1
    assert registry.read(spark, path).where("version = 'v9'").count() == 1


def test_status_moves(spark):
    path = session.scratch_path(spark, "registry")
    with pytest.raises(ValueError):
        registry.read(spark, path)
    registry.register(_records(spark, "v1"), path)
    registry.register(_records(spark, "v2", "Staging"), path)
    assert registry.promote(spark, path, "m", "v2", "2001-02-01", expected="Staging") == 3
    assert {r.version: r.status for r in registry.read(spark, path).collect()} == {"v1": "Archived", "v2": "Production"}
    with pytest.raises(ValueError):
        registry.promote(spark, path, "m", "v1", "2001-02-02", expected="Staging")
    with pytest.raises(ValueError):
        registry.move(spark, path, "m", "v7", "Archived", "2001-02-02")
    registry.move(spark, path, "m", "v1", "Retired", "2001-03-01")
    assert [(r.number, r.version, r.status) for r in registry.history(spark, path).orderBy("number", "version").collect()] == [
        (1, "v1", "Production"), (2, "v2", "Staging"), (3, "v1", "Archived"), (3, "v2", "Production"), (4, "v1", "Retired")]


def test_fitted_encoders(spark):
    df = spark.createDataFrame([("b", 1), ("a", 0), ("b", 0)], "c string, y int")
    for method in ("label", "onehot", "target"):
        out = models.encoder(["c"], method, "y").fit(df).transform(df)
        assert out.count() == 3
    labels = {r.c: r.c_label for r in models.encoder(["c"], "label").fit(df).transform(df).collect()}
    assert labels == {"a": 0.0, "b": 1.0}
    for method in ("standard", "minmax", "robust"):
        matrix = models.training_matrix(df.withColumn("v", F.monotonically_increasing_id().cast("double")), ["v"], "y")
        assert models.scaler(method).fit(matrix).transform(matrix).count() == 3


def test_dictionary_of_an_open_set(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), (F.col("id") % 3001).cast("string")).alias("c")) \
        .unionByName(spark.createDataFrame([(None,), ("",), ("k0",)], "c string"))
    known = encoding.dictionary(df, "c")
    order = sorted({"", *[f"k{i}" for i in range(3001)]})
    assert {r["value"]: r.code for r in known.collect()} == {v: i for i, v in enumerate(order)}
    rows = spark.createDataFrame([("k5",), (None,), ("unseen",)], "c string")
    assert {r.c: r.c_label for r in encoding.label_encode(rows, "c", known).collect()} == {
        "k5": order.index("k5"), None: 3002, "unseen": 3002}
    empty = encoding.dictionary(df.limit(0), "c")
    assert empty.count() == 0 and [r.c_label for r in encoding.label_encode(rows, "c", empty).collect()] == [0, 0, 0]


@pytest.mark.parametrize("smoothing", [0.0, 2.5])
def test_out_of_fold_target(spark, smoothing):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None, f"once{i}"]), rng.choice([0, 1, None]), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, y int, fold int")
    found = {r.id: r.c_target for r in encoding.out_of_fold_target(df, "c", "y", "fold", smoothing).collect()}
    for i, c, _, fold in rows:
        rest = [r for r in rows if r[3] != fold and r[2] is not None]
        prior = sum(r[2] for r in rest) / len(rest)
        own = [r[2] for r in rest if r[1] == c]
        expected = (sum(own) + smoothing * prior) / (len(own) + smoothing) if own else prior
        assert found[i] == pytest.approx(expected, abs=1e-12)
    assert len(found) == 200
    single = spark.createDataFrame([(1, "a", 1, 0)], "id long, c string, y int, fold int")
    assert encoding.out_of_fold_target(single, "c", "y", "fold").first().c_target is None


def test_kernel_margins_are_computed_in_batches(planted):
    """The machine scores a batch at once; the formula, row by row, gives the same."""
    machine = models.KernelMachine(FEATURES, components=8, iterations=4).fit(planted)
    frequencies, phases = machine._directions()
    for r in machine._margin(planted).limit(20).collect():
        x = [(r[c] - m) / s for c, (m, s) in zip(FEATURES, machine.moments)]
        z = [math.sqrt(2 / 8) * math.cos(sum(a * b for a, b in zip(x, row)) + p) for row, p in zip(frequencies, phases)]
        assert r._margin == pytest.approx(sum(a * b for a, b in zip(z, machine.weights)) + machine.weights[-1])
    plan = machine.transform(planted)._jdf.queryExecution().optimizedPlan().toString()
    assert "COS(" not in plan.upper()


def test_both_versions_of_the_registry_train_on_one_written_table(spark, monkeypatch):
    """Training rows are joined and written once; both versions and the hold-out rows are read from them."""
    rng = random.Random(3)
    names = plans.FEATURES
    rows = spark.createDataFrame([(i, *[rng.random() for _ in names], i % 2) for i in range(200)],
                                 "application_id long, " + ", ".join(f"{n} double" for n in names) + ", default_risk int")
    calls = []
    monkeypatch.setattr(plans, "matrix", lambda *_: calls.append(1) or rows)
    monkeypatch.setattr(models, "random_forest", lambda: models.RandomForest(2, 2, least=2, seed=1))
    registry, holdout = plans._registry(spark, "unused")
    found = {(r.model_name, r.version, r.status) for r in registry.collect()}
    assert found == {(n, *v) for n in ("Random Forest", "Logistic Regression") for v in (("v1", "Archived"), ("v2", "Production"))}
    assert len(calls) == 1 and 0 < holdout.count() < 100


@pytest.mark.parametrize("name", ["_explained", "model_dependence"])
def test_explained_rows_are_the_written_training_table(spark, monkeypatch, name):
    rng, written = random.Random(6), []
    rows = spark.createDataFrame(
        [(i, *[rng.random() for _ in plans.FEATURES], rng.randrange(2)) for i in range(300)],
        "application_id long, " + ", ".join(f"{f} double" for f in plans.FEATURES) + ", default_risk int")
    monkeypatch.setattr(plans, "matrix", lambda *_: written.append(1) or session.materialize(rows, "training"))
    monkeypatch.setattr(models, "random_forest", lambda: models.RandomForest(3, 3, least=2, seed=1))
    getattr(plans, name)(spark, "")
    assert len(written) == 1


def test_steps_of_a_waterfall_are_not_shuffled(spark, monkeypatch):
    wide = spark.createDataFrame([(i, *[float(i)] * 8, 0.25, [0.5, -0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 0.125]) for i in (1, 2, 3, 3)],
                                 "application_id long, " + ", ".join(f"{f} double" for f in plans.FEATURES) + ", base double, phi array<double>")
    scores = spark.createDataFrame([(1, 0.625), (2, 0.5), (3, 0.625), (None, 0.625)], "application_id long, score double")
    monkeypatch.setattr(plans, "_explained", lambda *_: (wide, scores))
    found = plans.model_waterfall(spark, "")
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [i for i, line in enumerate(lines) if "Generate inline" in line][0]
    last = [i for i, line in enumerate(lines) if "HashAggregate" in line or "SortAggregate" in line]
    assert last and not any("Exchange" in line for line in lines[last[0]:below])
    rows = [tuple(r) for r in found.orderBy("application_id").collect()]
    assert rows == [(1, 10, True, True, True), (2, 10, True, True, False), *[(3, 20, True, False, True)] * 2]


_WIDE = "application_id long, " + ", ".join(f"{f} double" for f in plans.FEATURES) + ", score double, base double, phi array<double>"


def _scored_wide(spark):
    """Ids 1 and 2 once, 3 twice with unlike rows, two rows without an id."""
    row = lambda i, first, score: (i, *[float(first)] * 8, score, 0.5, [first / 10, -0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    return spark.createDataFrame([row(1, 1, 0.35), row(2, 2, 0.9), row(3, 3, 0.55), row(3, 4, 0.65), row(None, 1, 0.35), row(None, 2, 0.2)], _WIDE)



def test_attribution_facts_pair_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(plans, "_explained_scored", lambda *_: session.materialize(_scored_wide(spark), "attributions"))
    found = plans.attribution_facts(spark, "")
    assert sorted((r.application_id, r.credit_score, r.adds_up) for r in found.collect()) == [
        (1, 1.0, True), (2, 2.0, False), (3, 3.0, False), (3, 3.0, True), (3, 4.0, False), (3, 4.0, True)]
    # Mean of all six scores, also of rows without an id: 0.5.
    assert {r.base_is_mean for r in found.collect()} == {True}


def test_explanation_facts_pair_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(plans, "_explained_scored", lambda *_: session.materialize(_scored_wide(spark), "attributions"))
    rows = plans.model_explanation_facts(spark, "").collect()
    assert sorted((r.application_id, r.is_probability, r.impacts_fit) for r in rows if r.application_id < 3) == [(1, True, True), (2, False, True)]
    # Explanation, score and attributions of each of two rows: eight combinations.
    assert sorted((r.is_probability, r.impacts_fit) for r in rows if r.application_id == 3) == [(a, b) for a in (False, True) for b in (False, True) for _ in range(2)]
    assert all(r.level_fits and r.impacts == 8 for r in rows) and len(rows) == 10


@pytest.mark.parametrize("name", ["attribution_facts", "model_explanation_facts"])
def test_facts_score_rows_once_and_move_ids_alone(spark, monkeypatch, name):
    rng, scored = random.Random(8), []
    rows = spark.createDataFrame(
        [(i, *[rng.random() for _ in plans.FEATURES], rng.randrange(2)) for i in range(300)],
        "application_id long, " + ", ".join(f"{f} double" for f in plans.FEATURES) + ", default_risk int")
    real = models.scored_rows
    monkeypatch.setattr(models, "scored_rows", lambda *a: scored.append(a[3:]) or real(*a))
    monkeypatch.setattr(plans, "matrix", lambda *_: session.materialize(rows, "training"))
    monkeypatch.setattr(models, "random_forest", lambda: models.RandomForest(3, 3, least=2, seed=1))
    found = getattr(plans, name)(spark, "")
    assert len([1 for kept in scored if kept]) == 1  # the hold-out rows keep no column
    held = found.collect()
    assert len(held) == 300 and all(v for r in held for k, v in r.asDict().items() if isinstance(v, bool))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange hashpartitioning(application_id" not in plan and "SortMergeJoin" not in plan and "RandomForest" not in plan
