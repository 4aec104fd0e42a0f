"""Model training, importance, cross-validation, attributions of the stored forest, registry."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import attribution, drift, evaluation, explain, models, registry as model_store
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications
from riskloom.plans.shared import applications

FEATURES = models.FEATURES
TRAINED_AT = "2001-06-15 00:00:00"


def matrix(spark, sf_dir):
    """The training rows as a written table: fits read it many times."""
    return session.materialize(
        applications(spark, sf_dir, "application_id", *FEATURES, "default_risk"), "training")


def split_matrix(spark, sf_dir, rows=None):
    """(train, hold-out) of ``rows``, if they are written already: validation rows train too, as no tuning happens here."""
    df = models.training_matrix(models.assign_split(matrix(spark, sf_dir) if rows is None else rows))
    return df.filter("split <> 'test'"), df.filter("split = 'test'")


def _evaluated(name, estimator, spark, sf_dir):
    train, holdout = split_matrix(spark, sf_dir)
    return models.holdout_evaluation({name: estimator(train).fit(train)}, holdout)


@query("m1_random_forest")
def random_forest(spark, sf_dir):
    return _evaluated("Random Forest", lambda _: models.random_forest(), spark, sf_dir)


@query("m2_logistic_regression")
def logistic_regression(spark, sf_dir):
    return _evaluated("Logistic Regression", lambda train: models.standardized(
        models.logistic_regression(train.count())), spark, sf_dir)


@query("m3_kernel_machine")
def kernel_machine(spark, sf_dir):
    return _evaluated("SVM", lambda _: models.KernelMachine(FEATURES), spark, sf_dir)


@query("m4_boosted_trees")
def boosted_trees(spark, sf_dir):
    return _evaluated("Boosted Trees", lambda _: models.boosted_trees(), spark, sf_dir)


_HOLDOUT = f"""
    SELECT count(*) AS holdout_rows, CAST(sum(default_risk) AS BIGINT) AS positives, TRUE AS above_chance FROM applications
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*FEATURES, 'default_risk'])}
      AND CAST('0x' || substr(md5(CAST(application_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20"""


@query("m4_boosted_facts", on_applications(_HOLDOUT))
def boosted_facts(spark, sf_dir):
    """Hold-out rows and positives that the boosted trees were judged on, and that they beat chance."""
    train, holdout = split_matrix(spark, sf_dir)
    rows = session.materialize(models.scored_rows("Boosted Trees", models.boosted_trees().fit(train), holdout), "scored")
    cells = evaluation.confusion(rows).join(evaluation.roc_auc(rows), "model")
    return cells.select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("holdout_rows"),
                        (F.col("fn") + F.col("tp")).alias("positives"), (F.col("roc_auc") > 0.5).alias("above_chance"))


@query("m3_kernel_facts", on_applications(_HOLDOUT.replace("TRUE AS above_chance", "TRUE AS above_chance, TRUE AS converged")))
def kernel_facts(spark, sf_dir):
    """Hold-out rows and positives of the kernel machine, that it beats chance and that its fit met its stop condition."""
    train, holdout = split_matrix(spark, sf_dir)
    machine = models.KernelMachine(FEATURES).fit(train)
    rows = session.materialize(models.scored_rows("SVM", machine, holdout), "scored")
    cells = evaluation.confusion(rows).join(evaluation.roc_auc(rows), "model")
    return cells.select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("holdout_rows"), (F.col("fn") + F.col("tp")).alias("positives"),
                        (F.col("roc_auc") > 0.5).alias("above_chance"), F.lit(machine.report["converged"]).alias("converged"))


def _estimators(rows):
    """The three models that are compared, with their declared settings."""
    return {
        "Random Forest": models.random_forest(),
        "Logistic Regression": models.standardized(models.logistic_regression(rows)),
        "SVM": models.KernelMachine(FEATURES),
    }


def _registered(spark, sf_dir, *names, version="v1", trained_at=TRAINED_AT, status="Production", path=None, only_train=False, split=None):
    """Registry of the named models, trained, evaluated on the hold-out rows and stored; and those rows.

    ``path`` names a registry to append to; ``only_train`` leaves the validation rows out; ``split`` has
    training and hold-out rows that are written already.
    """
    train, holdout = split or split_matrix(spark, sf_dir)
    train = train.filter("split = 'train'") if only_train else train
    fitted = {name: e.fit(train) for name, e in _estimators(train.count()).items() if name in names}
    stored = {name: models.save(m, session.scratch_path(spark, "model")) for name, m in fitted.items()}
    metrics = models.holdout_evaluation(fitted, holdout)
    records = models.registry_records(metrics, version, trained_at, status, stored)
    return models.register(records, path or session.scratch_path(spark, "registry")), holdout


def _scored_by_stored(spark, sf_dir):
    """Hold-out scores of the current models, trained, stored, registered and loaded again."""
    registry, holdout = _registered(spark, sf_dir, "Random Forest", "Logistic Regression", "SVM")
    rows = None
    for name, model in sorted(models.load_current(registry).items()):
        scored = models.scored_rows(name, model, holdout)
        rows = scored if rows is None else rows.unionByName(scored)
    return session.materialize(rows, "scored")


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, "default_risk"])


@query("m10_trained_models", on_applications(f"""
    SELECT model, count(*) AS holdout_rows, CAST(sum(default_risk) AS BIGINT) AS positives, TRUE AS above_chance
    FROM applications, (VALUES ('Random Forest'), ('Logistic Regression'), ('SVM')) AS m(model)
    WHERE {_COMPLETE} AND CAST('0x' || substr(md5(CAST(application_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20
    GROUP BY model"""))
def trained_models(spark, sf_dir):
    """The stored models side by side on the hold-out rows: facts of their evaluation."""
    rows = _scored_by_stored(spark, sf_dir)
    cells = evaluation.confusion(rows).join(evaluation.roc_auc(rows), "model")
    return cells.select(
        "model", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("holdout_rows"),
        (F.col("fn") + F.col("tp")).alias("positives"), (F.col("roc_auc") > 0.5).alias("above_chance"))


@query("m8_trained_models")
def trained_models_curve(spark, sf_dir):
    """ROC points of the stored models on the hold-out rows."""
    return evaluation.roc_curve(_scored_by_stored(spark, sf_dir))


def _importances(spark, sf_dir):
    train, _ = split_matrix(spark, sf_dir)
    forest = models.random_forest().fit(train)
    linear = models.standardized(models.logistic_regression(train.count())).fit(train)
    return models.feature_importance("Random Forest", forest, spark).unionByName(
        models.feature_importance("Logistic Regression", linear, spark))


@query("m11_feature_importance")
def feature_importance(spark, sf_dir):
    return _importances(spark, sf_dir)


@query("m11_importance_facts", on_applications("""
    SELECT model, 8 AS features, TRUE AS ranked_by_size, model = 'Random Forest' AS shares
    FROM (VALUES ('Random Forest'), ('Logistic Regression')) AS m(model) WHERE (SELECT count(*) FROM applications) > 0"""))
def importance_facts(spark, sf_dir):
    """Ranks 1 to 8 follow falling importance; a forest's importances are shares of one."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "importance")))
    found = _importances(spark, sf_dir).groupBy("model").agg(
        F.count("*").cast("int").alias("features"), ranked.alias("r"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("shares"))
    falling = F.col("r.importance") == F.reverse(F.array_sort("r.importance"))
    in_order = F.col("r.rank") == F.transform(F.sequence(F.lit(1), F.col("features")), lambda i: i.cast("int"))
    return found.select("model", "features", (falling & in_order).alias("ranked_by_size"), "shares")


@query("m15_feature_selection")
def feature_selection(spark, sf_dir):
    return models.select_features(_importances(spark, sf_dir))


@query("m12_cross_validation")
def cross_validation(spark, sf_dir):
    """Five-fold AUC of the three models that are compared."""
    columns = ["application_id", *FEATURES, "default_risk"]
    folded = models.assign_folds(applications(spark, sf_dir, *columns), "default_risk")
    table = models.training_matrix(session.materialize(folded, "folds"))
    scores = models.cross_validate(_estimators(table.count()), table)
    return models.cross_validation_summary(scores).drop("scores")


def _registry(spark, sf_dir):
    """Two versions of stored models: an archived one of the training rows, one that saw the validation rows, too; and the hold-out rows."""
    path, split = session.scratch_path(spark, "registry"), split_matrix(spark, sf_dir)
    _registered(spark, sf_dir, "Random Forest", "Logistic Regression", version="v1", trained_at="2001-05-01 00:00:00",
                status="Archived", path=path, only_train=True, split=split)
    return _registered(spark, sf_dir, "Random Forest", "Logistic Regression", version="v2", path=path, split=split)


@query("m13_model_registry")
def model_registry(spark, sf_dir):
    return _registry(spark, sf_dir)[0].drop("model_path")


_VERSIONS = """(VALUES ('Random Forest', 'v1', 'Archived', TIMESTAMP '2001-05-01 00:00:00'), ('Random Forest', 'v2', 'Production', TIMESTAMP '2001-06-15 00:00:00'),
    ('Logistic Regression', 'v1', 'Archived', TIMESTAMP '2001-05-01 00:00:00'), ('Logistic Regression', 'v2', 'Production', TIMESTAMP '2001-06-15 00:00:00'))
    AS v(model_name, version, status, trained_at)"""


@query("m13_registry_facts", on_applications(f"""
    SELECT model_name, version, status, CAST(trained_at AS DATE) AS trained_on, TRUE AS above_chance, TRUE AS loads_and_scores_alike
    FROM {_VERSIONS} WHERE (SELECT count(*) FROM applications) > 0"""))
def registry_facts(spark, sf_dir):
    """Every registered version is stored: loaded again it has the AUC that is written beside it."""
    registry, holdout = _registry(spark, sf_dir)
    rows = None
    for r in registry.select("model_name", "version", "model_kind", "model_path").collect():
        scored = models.scored_rows(f"{r.model_name}#{r.version}", models.load(r.model_kind, r.model_path), holdout)
        rows = scored if rows is None else rows.unionByName(scored)
    again = evaluation.roc_auc(session.materialize(rows, "scored")).withColumnsRenamed({"model": "key", "roc_auc": "again"})
    joined = registry.join(again, F.concat_ws("#", "model_name", "version") == F.col("key"))
    return joined.select("model_name", "version", "status", F.to_date("trained_at").alias("trained_on"), (F.col("roc_auc") > 0.5).alias("above_chance"),
                         (F.abs(F.col("roc_auc") - F.col("again")) < 1e-9).alias("loads_and_scores_alike"))


@query("m13_registry_moves", on_applications("""
    SELECT CAST(number AS BIGINT) AS number, model_name, version, status, moved_at, TRUE AS above_chance
    FROM (VALUES (1, 'Logistic Regression', 'v1', 'Production', '2001-05-01 00:00:00'), (2, 'Logistic Regression', 'v2', 'Staging', '2001-06-15 00:00:00'),
      (3, 'Logistic Regression', 'v1', 'Archived', '2001-06-20 00:00:00'), (3, 'Logistic Regression', 'v2', 'Production', '2001-06-20 00:00:00'))
      AS v(number, model_name, version, status, moved_at) WHERE (SELECT count(*) FROM applications) > 0"""))
def registry_moves(spark, sf_dir):
    """What becomes of two stored versions: the second is staged, then takes the place of the first in one commit."""
    path, name = session.scratch_path(spark, "registry"), "Logistic Regression"
    _registered(spark, sf_dir, name, version="v1", trained_at="2001-05-01 00:00:00", path=path, only_train=True)
    _registered(spark, sf_dir, name, version="v2", status="Staging", path=path)
    model_store.promote(spark, path, name, "v2", "2001-06-20 00:00:00", expected="Staging")
    chance = model_store.read(spark, path).select("model_name", "version", (F.col("roc_auc") > 0.5).alias("above_chance"))
    return model_store.history(spark, path).withColumnRenamed("at", "moved_at").join(chance, ["model_name", "version"])


@query("m14_current_models")
def current_models(spark, sf_dir):
    registry = _registry(spark, sf_dir)[0].drop("model_path")
    return drift.retrain_due(models.current_models(registry), "2001-08-01")


@query("m14_current_facts", on_applications(f"""
    SELECT model_name, version, status, date_diff('day', CAST(trained_at AS DATE), DATE '2001-08-01') AS age_days,
      date_diff('day', CAST(trained_at AS DATE), DATE '2001-08-01') > 30 AS retrain_due FROM {_VERSIONS}"""))
def current_facts(spark, sf_dir):
    """Version, age and whether training is due of the newest model of each name and status."""
    return current_models(spark, sf_dir).select(
        "model_name", "version", "status", F.col("age_days").cast("bigint").alias("age_days"), "retrain_due")


def _forest(spark, sf_dir):
    """Every application and the current stored forest."""
    rows = matrix(spark, sf_dir)
    registry, _ = _registered(spark, sf_dir, "Random Forest", split=split_matrix(spark, sf_dir, rows))
    return rows, models.load_current(registry)["Random Forest"]


def _explained(spark, sf_dir):
    """Attributions of every complete application by the current stored forest, and the forest's own scores."""
    rows, forest = _forest(spark, sf_dir)
    wide = attribution.tree_shapley(forest, rows, rows, FEATURES, "application_id")
    scores = models.scored_rows("Random Forest", forest, models.training_matrix(rows), ["application_id"])
    return session.materialize(wide, "attributions"), scores


def _explained_scored(spark, sf_dir):
    """The attributions with the forest's own score of each row, in one written table: rows are scored once, as they are attributed."""
    rows, forest = _forest(spark, sf_dir)
    wide = attribution.tree_shapley(forest, rows, rows, FEATURES, "application_id", ["default_risk"])
    scored = models.scored_rows("Random Forest", forest, models.training_matrix(wide), ["application_id", *FEATURES, "base", "phi"])
    return session.materialize(scored, "attributions")


def _beside(wide, *sides):
    """The columns of each of ``sides`` beside each other: what joins of them by id give.

    A row has its own columns beside each other already, so only the rows that share an id are joined, each
    with each. All others stay where they are; the ids alone are shuffled to tell which are which.
    """
    known = wide.filter("application_id IS NOT NULL")
    repeated = session.measured(known.groupBy("application_id").agg(F.count("*").alias("n")).filter("n > 1").select("application_id"), "repeated")
    once = known.join(repeated, "application_id", "left_anti").select("application_id", *itertools.chain(*sides))
    several = known.join(repeated, "application_id", "left_semi")
    joined = several.select("application_id", *sides[0])
    for side in sides[1:]:
        joined = joined.join(several.select("application_id", *side), "application_id")
    return once.unionByName(joined)


@query("x2_model_attribution")
def model_attribution(spark, sf_dir):
    """Exact attributions of the stored forest for every application, against all of them."""
    wide, _ = _explained(spark, sf_dir)
    return attribution.long_form(wide, FEATURES, "application_id")


_EXPLAINED = f"FROM applications WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*FEATURES, 'default_risk'])}"


@query("x2_attribution_facts", on_applications(f"""
    SELECT application_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)}, TRUE AS adds_up, TRUE AS base_is_mean {_EXPLAINED}"""))
def attribution_facts(spark, sf_dir):
    """Whether base plus attributions is the forest's own probability, and the base its mean."""
    wide = _explained_scored(spark, sf_dir).withColumn("total", attribution.prediction(FEATURES))
    mean = wide.agg(F.avg("score")).scalar()
    return _beside(wide, [*FEATURES, "base", "total"], ["score"]).select(
        "application_id", *FEATURES, (F.abs(F.col("total") - F.col("score")) < 1e-9).alias("adds_up"),
        (F.abs(F.col("base") - mean) < 1e-9).alias("base_is_mean"))


@query("x2_model_importance")
def model_importance(spark, sf_dir):
    """Mean absolute attribution of the stored forest's features."""
    return attribution.importance(_explained(spark, sf_dir)[0], FEATURES)


@query("x3_model_waterfall", on_applications(f"""
    SELECT application_id, 10 AS steps, TRUE AS starts_at_base, TRUE AS accumulates, TRUE AS ends_at_probability {_EXPLAINED}"""))
def model_waterfall(spark, sf_dir):
    """Waterfalls of the stored forest: their steps add up from the base to the probability."""
    wide, scores = _explained(spark, sf_dir)
    wide = wide.repartition("application_id")  # a row moves once, not each of its steps
    steps = attribution.waterfall(wide, FEATURES, "application_id").groupBy("application_id").agg(
        F.count("*").cast("int").alias("steps"), F.max(F.when(F.col("step") == 0, F.col("running"))).alias("first"),
        F.max(F.when(F.col("step") == len(FEATURES) + 1, F.col("running"))).alias("last"),
        F.sum(F.when(F.col("step") <= len(FEATURES), F.col("amount"))).alias("total"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    return steps.join(wide.select("application_id", "base"), "application_id").join(scores, "application_id").select(
        "application_id", "steps", close("first", "base").alias("starts_at_base"), close("total", "last").alias("accumulates"),
        close("last", "score").alias("ends_at_probability"))


@query("x4_model_points", on_applications(f"""
    , complete AS (SELECT * {_EXPLAINED}),
    drawn AS (SELECT * FROM complete ORDER BY md5(CAST(application_id AS VARCHAR)), application_id LIMIT 200)
    SELECT application_id, feature, CAST(feature_value AS DOUBLE) AS feature_value, 8 AS ranks
    FROM (UNPIVOT (SELECT application_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)} FROM drawn)
          ON {', '.join(FEATURES)} INTO NAME feature VALUE feature_value)""".strip()))
def model_points(spark, sf_dir):
    """Summary points of the stored forest for a repeatable draw of 200 applications; ranks 1 to 8 each once."""
    wide, _ = _explained(spark, sf_dir)
    points = attribution.summary_points(wide, FEATURES, "application_id", sample=200)
    ranks = points.agg(F.size(F.collect_set("rank"))).scalar()
    return points.select("application_id", "feature", "feature_value", ranks.alias("ranks"))


@query("x6_model_dependence")
def model_dependence(spark, sf_dir):
    """Mean probability of the forest along the debt ratio."""
    rows = matrix(spark, sf_dir)
    train, _ = split_matrix(spark, sf_dir, rows)
    forest = models.random_forest().fit(train)
    return explain.model_dependence(forest, rows, FEATURES, "debt_to_income")


@query("x7_model_explanation")
def model_explanation(spark, sf_dir):
    """A JSON explanation of the stored forest's prediction for every application."""
    attributions = model_attribution(spark, sf_dir)
    return explain.explanation_documents(attributions, explain.summed_prediction(), TRAINED_AT)


@query("x7_model_facts", on_applications(f"""
    SELECT application_id, TRUE AS is_probability, TRUE AS level_fits, 8 AS impacts, TRUE AS impacts_fit {_EXPLAINED}"""))
def model_explanation_facts(spark, sf_dir):
    """Individual explanations of the stored forest: probability, level and the text of each impact."""
    told = attribution.individual_explanation(_explained_scored(spark, sf_dir), FEATURES, "application_id", ["score", "phi"])
    # Plain expressions beside the impacts: a lambda over the array would be interpreted.
    word = lambda p: F.concat(F.when(p > 0, "increases").otherwise("decreases"), F.lit(" risk by "), F.format_string("%.3f", F.abs(p)))
    told = told.withColumn("expected", F.array(*[F.concat(F.lit(f"{name} "), word(F.col("phi")[j])) for j, name in enumerate(FEATURES)]))
    found = _beside(told, ["probability", "risk_level", "impacts"], ["score"], ["expected"])
    level = F.when(F.col("probability") > 0.6, "High").when(F.col("probability") > 0.3, "Medium").otherwise("Low")
    return found.select("application_id", (F.abs(F.col("probability") - F.col("score")) < 1e-9).alias("is_probability"),
                        (F.col("risk_level") == level).alias("level_fits"), F.size("impacts").alias("impacts"),
                        (F.col("impacts") == F.col("expected")).alias("impacts_fit"))
