"""Attributions of the scorecard and of fitted models, importance, partial dependence, what-if."""

from __future__ import annotations

import random

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import policy, session
from riskloom.functions import scorecard
from riskloom.operators import ranking, scoring


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with every scoring input present; a missing score has no attribution."""
    return df.dropna(subset=policy.SCORE_INPUTS)


def mean_contributions(df: DataFrame) -> Column:
    """Scalar subquery: struct of the mean of each term over the complete rows."""
    means = [F.avg(term).alias(label) for label, term in scorecard.contributions()]
    return complete_rows(df).agg(F.struct(*means)).scalar()


def base_value() -> Column:
    """Sum of the mean terms in ``_means``: the score of the average."""
    total = F.lit(0.0)
    for label in policy.SCORE_LABELS:
        total = total + F.col("_means")[label]
    return total


def _phi(i: int) -> Column:
    return F.col(f"_phi{i}")


def _with_phi(df: DataFrame) -> DataFrame:
    """Append ``_base`` and the attributions ``_phi0`` to ``_phi5`` to the complete rows.

    For an additive model the Shapley value is the term minus its mean. Each value is a
    column of its own, so that later steps refer to it instead of repeating the term.
    """
    located = complete_rows(df).withColumn("_means", mean_contributions(df))
    return located.withColumns({"_base": base_value()} | {
        f"_phi{i}": term - F.col("_means")[label]
        for i, (label, term) in enumerate(scorecard.contributions())})


def scorecard_attribution(df: DataFrame, id_column: str = "application_id") -> DataFrame:
    """(id, feature, feature_value, phi, base): exact for the score before its cap."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("feature"), F.col(column).cast("double").alias("feature_value"),
                 _phi(i).alias("phi"))
        for i, (column, label, _) in enumerate(policy.SCORE_TERMS)])
    return _with_phi(df).select(id_column, F.col("_base").alias("base"), F.inline(rows))


def _step(number: int, label: str, amount: Column, running: Column) -> Column:
    return F.struct(F.lit(number).alias("step"), F.lit(label).alias("label"),
                    amount.alias("amount"), running.alias("running"))


def waterfall(df: DataFrame, id_column: str = "application_id") -> DataFrame:
    """Base value, one step per feature with its running total, final value.

    Running totals are sums inside the row, each built on the one before it: no
    window, no shuffle.
    """
    rows = _with_phi(df).withColumn("_run0", F.col("_base"))
    steps = [_step(0, "Base Value", F.col("_base"), F.col("_base"))]
    for i, label in enumerate(policy.SCORE_LABELS):
        rows = rows.withColumn(f"_run{i + 1}", F.col(f"_run{i}") + _phi(i))
        steps.append(_step(i + 1, label, _phi(i), F.col(f"_run{i + 1}")))
    last = F.col(f"_run{len(policy.SCORE_LABELS)}")
    steps.append(_step(len(steps), "Final Prediction", last, last))
    return rows.select(id_column, F.inline(F.array(*steps)))


def global_importance(df: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature and its rank; ranks see six rows."""
    row = _with_phi(df).agg(*[
        F.avg(F.abs(_phi(i))).alias(label) for i, label in enumerate(policy.SCORE_LABELS)])
    importance = row.unpivot([], policy.SCORE_LABELS, "feature", "importance")
    return rank_importance(importance)


def rank_importance(importance: DataFrame) -> DataFrame:
    by_size = Window.orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(by_size))


def importance_of(attributions: DataFrame) -> DataFrame:
    """Importance from long attributions of any model."""
    return rank_importance(
        attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")))


def summary_points(df: DataFrame, id_column: str = "application_id",
                   sample: int | None = None) -> DataFrame:
    """(rank, feature, phi, feature_value) points; ``sample`` draws the points of that many rows.

    Means and ranks are those of all rows, so a drawn point is one of the whole set's.
    """
    complete = complete_rows(df)
    points = scorecard_attribution(complete, id_column)
    if sample is not None:
        drawn = ranking.stable_sample(complete, sample, id_column).select(id_column)
        points = points.join(drawn, id_column, "left_semi")
    ranks = global_importance(complete).select("feature", "rank")
    # Six rows, one per scorecard term.
    return points.join(F.broadcast(ranks), "feature") \
        .select(id_column, "rank", "feature", "phi", "feature_value")


def individual_explanation(df: DataFrame, id_column: str = "application_id") -> DataFrame:
    """Probability, risk level, base rate and the impact of each feature as text."""
    explained = _with_phi(df)
    impacts = F.array(*[
        F.concat(F.lit(f"{label} "), scoring.impact_text(_phi(i)))
        for i, label in enumerate(policy.SCORE_LABELS)])
    probability = scorecard.risk_score()
    return explained.select(
        id_column, probability.alias("probability"),
        scorecard.risk_level(probability).alias("risk_level"),
        F.col("_base").alias("base_rate"), impacts.alias("impacts"))


def scorecard_documents(df: DataFrame, as_of: str, id_column: str = "application_id") -> DataFrame:
    """One JSON explanation per application, built inside the row."""
    prediction = F.col("_base")
    for i in range(len(policy.SCORE_LABELS)):
        prediction = prediction + _phi(i)
    document = F.struct(
        F.lit(as_of).alias("timestamp"), prediction.alias("prediction"),
        F.col("_base").alias("expected_value"),
        F.struct(*[_phi(i).alias(label) for i, label in enumerate(policy.SCORE_LABELS)])
        .alias("feature_contributions"),
        F.struct(*[F.col(c).cast("double").alias(label) for c, label, _ in policy.SCORE_TERMS])
        .alias("feature_values"))
    return _with_phi(df).select(id_column, F.to_json(document).alias("document"))


def explanation_documents(attributions: DataFrame, prediction: Column, as_of: str,
                          id_column: str = "application_id") -> DataFrame:
    """One JSON explanation per row from long attributions (a handful per row)."""
    entries = F.array_sort(F.collect_list(F.struct("feature", "phi")))
    values = F.array_sort(F.collect_list(F.struct("feature", "feature_value")))
    grouped = attributions.groupBy(id_column).agg(
        F.max("base").alias("expected_value"),
        F.map_from_entries(entries).alias("feature_contributions"),
        F.map_from_entries(values).alias("feature_values"))
    document = F.struct(
        F.lit(as_of).alias("timestamp"), prediction.alias("prediction"), "expected_value",
        "feature_contributions", "feature_values")
    return grouped.select(id_column, F.to_json(document).alias("document"))


def summed_prediction() -> Column:
    """Base plus all attributions of a grouped explanation."""
    return F.aggregate(F.map_values("feature_contributions"), F.col("expected_value"),
                       lambda total, phi: total + phi)


def partial_dependence(df: DataFrame, feature: str, points: int = 50) -> DataFrame:
    """Mean score with ``feature`` fixed at each grid point from its min to its max.

    One aggregation with one sum per grid point: rows are not multiplied. The other
    terms of a row are added up once.
    """
    rows = complete_rows(df)
    limits = rows.agg(F.struct(F.min(feature).cast("double").alias("low"),
                               F.max(feature).cast("double").alias("high"))).scalar()
    rest = scorecard.uncapped_score(without=feature)
    located = rows.select(rest.alias("rest"), limits.alias("r"))
    span = (F.col("r.high") - F.col("r.low")) / (points - 1)
    grid = [F.col("r.low") + span * i for i in range(points)]
    scores = [F.least(F.col("rest") + scorecard.contribution_at(feature, at), F.lit(1.0))
              for at in grid]
    sums = located.agg(F.count("*").alias("n"), F.any_value("r").alias("r"),
                       *[F.sum(s).alias(f"s{i}") for i, s in enumerate(scores)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("point"), at.alias("feature_value"),
                 F.try_divide(F.col(f"s{i}"), F.col("n")).alias("mean_score"))
        for i, at in enumerate(grid)])))


def model_dependence(model: Model, df: DataFrame, features: list[str], feature: str,
                     points: int = 50) -> DataFrame:
    """Mean probability of a fitted classifier with ``feature`` fixed at each grid point.

    The mean of a forest is that of its trees, so the rows that can reach each leaf are counted
    instead of scoring them at each point. For other models a row is multiplied inside its task
    and scored there; only one sum per grid point and task is shuffled. Rows with a missing
    feature are left out.
    """
    rows = df.dropna(subset=features).select(*[F.col(c).cast("double").alias(c) for c in features])
    stages = model.stages if hasattr(model, "stages") else [model]
    if len(stages) == 1 and isinstance(stages[0], RandomForestClassificationModel) and stages[0].numClasses == 2:
        return _forest_dependence(stages[0], rows, features, feature, points)
    limits = rows.agg(F.struct(F.min(feature).alias("low"), F.max(feature).alias("high"))).scalar()
    placed = rows.withColumn("_r", limits) \
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    span = (F.col("_r.high") - F.col("_r.low")) / max(1, points - 1)
    placed = placed.withColumn(feature, F.col("_r.low") + span * F.col("point"))
    scored = model.transform(placed.withColumn("features", array_to_vector(F.array(*features))))
    return scored.groupBy("point").agg(
        F.any_value(feature).alias("feature_value"),
        F.avg(vector_to_array("probability")[1]).alias("mean_score"))


def _forest_dependence(model: Model, rows: DataFrame, features: list[str], feature: str, points: int) -> DataFrame:
    from riskloom.operators import attribution  # which imports this module

    low, high = rows.agg(F.min(feature), F.max(feature)).first()
    grid = [] if low is None else [low + (high - low) / max(1, points - 1) * i for i in range(points)]
    means = attribution.dependence(attribution.ensemble(model, len(features)), rows, features, feature, grid) if grid else []
    return rows.sparkSession.createDataFrame(
        [(i, *pair) for i, pair in enumerate(zip(grid, means))], "point int, feature_value double, mean_score double")


def what_if(df: DataFrame, scenarios: DataFrame, id_column: str = "scenario_id") -> DataFrame:
    """Score scenarios; inputs they leave out take the column mean of ``df``."""
    means = df.agg(F.struct(*[
        F.avg(c).alias(c) for c in policy.SCORE_INPUTS])).scalar()
    given = set(scenarios.columns)
    filled = scenarios.withColumn("_means", means).select(id_column, *[
        F.coalesce(F.col(c).cast("double") if c in given else F.lit(None).cast("double"),
                   F.col("_means")[c]).alias(c) for c in policy.SCORE_INPUTS])
    return scoring.score(filled)


def sampled_shapley(model: Model, rows: DataFrame, background: DataFrame, features: list[str],
                    id_column: str, permutations: int = 4, n_background: int = 25,
                    seed: int = 42) -> DataFrame:
    """Permutation-sampling attributions of any fitted classifier: (id, feature, feature_value, phi, base).

    Each row is expanded inside its own task into permutations x background rows x
    steps and scored by one ``transform``. Features enter one by one in permutation
    order; the score after a feature enters counts for it, the score before counts
    against it, so the attributions of a row add up to its prediction minus the base.
    More permutations and background rows give less noise at proportional work.
    The rows are partitioned by id once, and the sums per id reuse that partitioning.
    """
    d = len(features)
    draw = random.Random(seed)
    orders = [draw.sample(range(d), d) for _ in range(permutations)]
    # positions[p][j]: step at which feature j enters in permutation p.
    positions = F.array(*[
        F.array(*[F.lit(order.index(j)) for j in range(d)]) for order in orders])
    entering = F.array(*[F.array(*[F.lit(j) for j in order]) for order in orders])

    as_array = F.array(*[F.col(c).cast("double") for c in features])
    reference = ranking.stable_sample(background, n_background, id_column) \
        .agg(F.collect_list(as_array)).scalar()
    spread = session.parallelism(rows.sparkSession)
    expanded = (
        rows.select(id_column, as_array.alias("x")).repartition(spread, id_column)
        .withColumn("reference", reference)
        .select(id_column, "x", F.explode("reference").alias("z"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"))
    )
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(F.get(F.get(positions, F.col("p")), j) < F.col("step"),
                         F.get(F.col("x"), j)).otherwise(F.get(F.col("z"), j)))
    scored = model.transform(expanded.withColumn("features", array_to_vector(mixed)))
    value = vector_to_array("probability")[1]
    order = F.get(entering, F.col("p"))
    evaluations = permutations * n_background
    steps = scored.select(
        id_column, "x", "step", value.alias("f"),
        F.get(order, F.col("step") - 1).alias("entered"), F.get(order, F.col("step")).alias("next"))

    def attributed(j):
        sign = F.coalesce((F.col("entered") == j).cast("int"), F.lit(0)) \
            - F.coalesce((F.col("next") == j).cast("int"), F.lit(0))
        return F.sum(F.col("f") * sign) / evaluations

    per_row = steps.groupBy(id_column).agg(
        F.any_value("x").alias("x"),
        (F.sum(F.when(F.col("step") == 0, F.col("f"))) / evaluations).alias("base"),
        F.array(*[attributed(j) for j in range(d)]).alias("phi"))
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col("x")[j].alias("feature_value"),
                 F.col("phi")[j].alias("phi")) for j, name in enumerate(features)])
    return per_row.select(id_column, "base", F.inline(cells))
