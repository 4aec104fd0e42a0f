"""Training, hold-out evaluation, cross-validation, importance and the model registry."""

from __future__ import annotations

import json
import math
import random
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, TargetEncoder,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom import policy, session
from riskloom.operators import evaluation, explain, registry
from riskloom.operators.boosting import BoostedTrees
from riskloom.operators.forest import RandomForest

SEED = 42
FEATURES = policy.MODEL_FEATURES
FOLD_BUCKETS = 10007  # prime, so that strided ids still spread
_KERNEL_ROWS = 4096


def hash_percent(id_column: str) -> Column:
    """0..99 from the id alone: the same row lands in the same split on every run."""
    return F.conv(F.substring(F.md5(F.col(id_column).cast("string")), 1, 8), 16, 10) \
        .cast("bigint") % 100


def assign_split(df: DataFrame, id_column: str = "application_id", test: int = 20,
                 validation: int = 20) -> DataFrame:
    """Append ``split``: ``test`` percent hold-out, then ``validation`` percent of the rest."""
    bucket = hash_percent(id_column)
    kept_out = test + round((100 - test) * validation / 100)
    return df.withColumn("split", F.when(bucket < test, "test")
                         .when(bucket < kept_out, "validation").otherwise("train"))


def assign_folds(df: DataFrame, label: str, id_column: str = "application_id",
                 folds: int = 5) -> DataFrame:
    """Append ``fold``: rows of each class dealt out evenly.

    Classes are numbered in (id bucket, id) order. Each bucket is numbered in its own
    task and starts after the rows of the earlier buckets, so a class of any size is
    never sorted in one place.
    """
    bucket = F.pmod(F.col(id_column), F.lit(FOLD_BUCKETS))
    placed = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(label).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(label, "_bucket").agg(F.count("*").alias("_n")).select(
        label, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(label, "_bucket").orderBy(id_column)
    offsets = offsets.withColumnsRenamed({label: "_label", "_bucket": "_at"})
    same = placed[label].eqNullSafe(offsets["_label"]) & placed["_bucket"].eqNullSafe(offsets["_at"])  # a null label is a class
    return placed.join(offsets, same).drop("_label", "_at") \
        .withColumn("fold", ((F.col("_offset") + F.row_number().over(inside) - 1) % folds).cast("int")) \
        .drop("_bucket", "_offset")


def training_matrix(df: DataFrame, features: list[str] = FEATURES,
                    label: str = "default_risk") -> DataFrame:
    """Assembled features and a double label; rows with a missing feature are left out."""
    complete = df.dropna(subset=[*features, label])
    return VectorAssembler(inputCols=features, outputCol="features").transform(complete) \
        .withColumn("label", F.col(label).cast("double"))


def random_forest(trees: int = 100, depth: int = 10) -> RandomForest:
    return RandomForest(trees, depth, least=2, seed=SEED)


def logistic_regression(rows: int, c: float = 1.0) -> Estimator:
    """L2 with strength C: the penalty is divided by the rows because the loss is a mean."""
    return LogisticRegression(maxIter=1000, regParam=1.0 / (c * rows), elasticNetParam=0.0,
                              standardization=False)


def standardized(estimator: Estimator) -> Pipeline:
    """The estimator on standardised features, for features of unlike scale."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scaler, estimator.copy({estimator.featuresCol: "scaled"})])


def boosted_trees(rounds: int = 100, depth: int = 6) -> BoostedTrees:
    return BoostedTrees(rounds, depth, SEED, step=0.1, share=0.8, subset=0.8)


def encoder(columns: list[str], method: str = "onehot", label: str | None = None) -> Pipeline:
    """label, onehot or target encoding fitted on the data, for open category sets."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_label" for c in columns],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
    indexed = [f"{c}_label" for c in columns]
    if method == "label":
        return Pipeline(stages=[index])
    if method == "onehot":
        return Pipeline(stages=[index, OneHotEncoder(
            inputCols=indexed, outputCols=[f"{c}_onehot" for c in columns], dropLast=False)])
    if method == "target":
        return Pipeline(stages=[index, TargetEncoder(
            inputCols=indexed, outputCols=[f"{c}_target" for c in columns], labelCol=label,
            targetType="binary")])
    raise ValueError(f"unknown encoding: {method}")


def scaler(method: str = "standard") -> Estimator:
    return {
        "standard": lambda: StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        "minmax": lambda: MinMaxScaler(inputCol="features", outputCol="scaled"),
        "robust": lambda: RobustScaler(inputCol="features", outputCol="scaled", withCentering=True),
    }[method]()


class KernelMachine:
    """RBF support vector machine: random Fourier features, Newton steps, Platt scaling.

    Random features (Rahimi and Recht, 2007) make the kernel linear. The squared hinge loss
    is then minimised by Newton's method: a pass over the rows adds up loss, gradient and
    curvature of the rows inside the margin; the driver solves a system of ``components`` + 1
    unknowns. A step that does not lower the loss is halved. The fit ends when the gradient
    is ``tolerance`` of what it was at the start; ``report`` says whether it got there within
    ``iterations`` passes.
    """

    def __init__(self, features: list[str], components: int = 64, iterations: int = 100,
                 tolerance: float = 1e-6, penalty: float = 1e-4):
        self.features, self.components, self.iterations = features, components, iterations
        self.tolerance, self.penalty = tolerance, penalty

    def _directions(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies (components x features) and phases, the same for every fit."""
        draw = random.Random(SEED)
        spread = math.sqrt(2 / len(self.features))
        phases, rows = [], []
        for _ in range(self.components):
            phases.append(draw.uniform(0, 2 * math.pi))
            rows.append([draw.gauss(0, spread) for _ in self.features])
        return np.array(rows), np.array(phases)

    def fit(self, df: DataFrame) -> "KernelMachine":
        """A fitted copy, so that several fits can run side by side."""
        return KernelMachine(self.features, self.components, self.iterations, self.tolerance, self.penalty)._fitted(df)

    def _fitted(self, df: DataFrame) -> "KernelMachine":
        spark = session.ship(df.sparkSession)
        columns = [F.col(c).cast("double").alias(c) for c in self.features]
        rows = session.materialize(df.select(*columns, F.col("label").cast("double").alias("label")).dropna(), "kernel")
        row = rows.agg(*[F.avg(c) for c in self.features], *[F.stddev_samp(c) for c in self.features],
                       F.count("label").alias("rows")).first()
        n = len(self.features)
        if not row.rows:
            raise ValueError("no rows to train on")
        self.moments = [(row[i], row[n + i] or 1.0) for i in range(n)]
        self._minimise(rows, row.rows)
        margins = session.materialize(self._margin(rows).select("margin", "label"), "margins")  # the scaling reads them twice
        self.platt = LogisticRegression(featuresCol="margin", probabilityCol="probability",
                                        rawPredictionCol="platt_raw",
                                        predictionCol="platt_prediction").fit(margins)
        return self

    def _minimise(self, rows: DataFrame, count: int) -> None:
        size = self.components + 1
        ridge = np.full(size, self.penalty)
        ridge[-1] = 0.0  # the intercept is free

        def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            sums = self._sums(rows, weights)
            loss = sums[0] / count + 0.5 * float(ridge @ weights ** 2)
            gradient = sums[1:size + 1] / count + ridge * weights
            curvature = np.zeros((size, size))
            curvature[np.triu_indices(size)] = sums[size + 1:] / count
            curvature += np.triu(curvature, 1).T
            return loss, gradient, curvature + np.diag(ridge)

        weights, passes = np.zeros(size), 1
        loss, gradient, curvature = at(weights)
        limit = self.tolerance * float(np.linalg.norm(gradient))
        while np.linalg.norm(gradient) > limit and passes < self.iterations:
            direction = -np.linalg.lstsq(curvature, gradient, rcond=1e-12)[0]
            slope, step = float(gradient @ direction), 1.0
            while passes < self.iterations:
                tried = at(weights + step * direction)
                passes += 1
                if tried[0] <= loss + 1e-4 * step * slope:
                    break
                step /= 2
            else:
                break
            weights = weights + step * direction
            loss, gradient, curvature = tried
        norm = float(np.linalg.norm(gradient))
        self.weights = [float(w) for w in weights]
        self.report = {"passes": passes, "loss": float(loss), "gradient_norm": norm, "limit": limit, "converged": norm <= limit}

    def _sums(self, rows: DataFrame, weights: np.ndarray) -> np.ndarray:
        """Loss, gradient and upper triangle of the curvature, summed over all rows.

        A task sends one vector whose length the components fix; vectors are added in Spark.
        """
        frequencies, phases = self._directions()
        means, spreads = (np.array(m) for m in zip(*self.moments))
        size, features = self.components + 1, self.features
        upper = np.triu_indices(size)

        def add(batches):
            total = np.zeros(1 + size + len(upper[0]))
            for batch in batches:
                for start in range(0, batch.num_rows, _KERNEL_ROWS):
                    block = batch.slice(start, _KERNEL_ROWS)
                    x = np.column_stack([block.column(c).to_numpy(zero_copy_only=False) for c in features])
                    y = 2 * block.column("label").to_numpy(zero_copy_only=False) - 1
                    z = np.cos(((x - means) / spreads) @ frequencies.T + phases) * math.sqrt(2 / len(phases))
                    z = np.column_stack([z, np.ones(len(y))])
                    short = 1 - y * (z @ weights)
                    inside = short > 0
                    z, y, short = z[inside], y[inside], short[inside]
                    total[0] += short @ short
                    total[1:size + 1] -= 2 * (z.T @ (y * short))
                    total[size + 1:] += 2 * (z.T @ z)[upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

        summed = rows.mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        found = np.zeros(1 + size + len(upper[0]))
        for r in summed.collect():
            found[r["at"]] = r["value"]
        return found

    def save(self, path: str) -> None:
        """Store the fitted parts below a new path."""
        self.platt.write().save(f"{path}/platt")
        inputs = [(self.features, self.components, self.iterations, self.tolerance, self.penalty,
                   [list(m) for m in self.moments], self.weights, json.dumps(self.report))]
        SparkSession.active().createDataFrame(
            inputs, "features array<string>, components int, iterations int, tolerance double, penalty double, "
            "moments array<array<double>>, weights array<double>, report string",
        ).write.parquet(f"{path}/inputs")

    @classmethod
    def load(cls, path: str) -> "KernelMachine":
        row = SparkSession.active().read.parquet(f"{path}/inputs").first()
        machine = cls(row.features, row.components, row.iterations, row.tolerance, row.penalty)
        machine.moments = [tuple(m) for m in row.moments]
        machine.weights, machine.report = list(row.weights), json.loads(row.report)
        machine.platt = LogisticRegressionModel.load(f"{path}/platt")
        return machine

    def _margin(self, df: DataFrame) -> DataFrame:
        frequencies, phases = self._directions()
        means, spreads = (np.array(m) for m in zip(*self.moments))
        weights, height = np.array(self.weights), math.sqrt(2 / self.components)

        def margin(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            return pd.Series(np.cos(((x - means) / spreads) @ frequencies.T + phases) @ (weights[:-1] * height) + weights[-1])

        value = df.withColumn("_margin", F.pandas_udf(margin, "double")(*[F.col(c).cast("double") for c in self.features]))
        return VectorAssembler(inputCols=["_margin"], outputCol="margin").transform(value)

    def transform(self, df: DataFrame) -> DataFrame:
        margins = self._margin(df)
        sign = (F.col("_margin") > 0).cast("double")
        return self.platt.transform(margins.withColumn("prediction", sign))


def scored_rows(name: str, model, df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(model, label, score, prediction) of a fitted model, ready for the metrics."""
    scored = model.transform(df)
    return scored.select(
        *keep, F.lit(name).alias("model"), F.col("label").cast("int").alias("label"),
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"))


def holdout_evaluation(models: dict[str, object], holdout: DataFrame) -> DataFrame:
    """Train-once models side by side on the hold-out rows."""
    rows = None
    for name, model in models.items():
        scored = scored_rows(name, model, holdout)
        rows = scored if rows is None else rows.unionByName(scored)
    return evaluation.evaluate(rows)


def feature_importance(name: str, model: Model, spark: SparkSession,
                       features: list[str] = FEATURES) -> DataFrame:
    """Ranked importances of a fitted model; empty for kernel machines."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        values = [abs(v) for v in last.coefficients.toArray()]
    else:
        values = []
    rows = [(name, f, float(v)) for f, v in zip(features, values)]
    return explain.rank_importance(
        spark.createDataFrame(rows, "model string, feature string, importance double"))


def select_features(importance: DataFrame, limit: float = policy.IMPORTANCE_LIMIT) -> DataFrame:
    return importance.filter(F.col("importance") >= limit)


def cross_validate(estimators: dict[str, Estimator], df: DataFrame, folds: int = 5,
                   threads: int = 4) -> DataFrame:
    """Out-of-fold AUC per (model, fold). ``df`` has features, label and fold.

    Fits run side by side as separate Spark jobs; all out-of-fold scores are ranked
    by one grouped evaluation. Pass a written table: it is read once per fit.
    """
    def fit(task):
        name, estimator, fold = task
        model = estimator.fit(df.filter(F.col("fold") != fold))
        return scored_rows(f"{name}#{fold}", model, df.filter(F.col("fold") == fold))

    tasks = [(n, e, k) for n, e in estimators.items() for k in range(folds)]
    with ThreadPool(threads) as pool:
        parts = pool.map(fit, tasks)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    scores = evaluation.roc_auc(rows)
    return scores.select(
        F.substring_index("model", "#", 1).alias("model"),
        F.substring_index("model", "#", -1).cast("int").alias("fold"), "roc_auc")


def cross_validation_summary(scores: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the fold scores."""
    return scores.groupBy("model").agg(
        F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("std_auc"),
        F.array_sort(F.collect_list(F.struct("fold", "roc_auc"))).alias("scores"))


def registry_records(metrics: DataFrame, version: str, trained_at: str, status: str,
                     stored: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Registry rows: one per evaluated model.

    ``stored`` has kind and path of each model, as ``save`` returned them; they become
    the columns model_kind and model_path.
    """
    records = metrics.select(
        F.col("model").alias("model_name"), F.lit(version).alias("version"),
        F.lit(trained_at).cast("timestamp").alias("trained_at"), F.lit(status).alias("status"),
        *evaluation.METRICS)
    if stored is None:
        return records
    places = metrics.sparkSession.createDataFrame(
        [(name, *place) for name, place in stored.items()], "model_name string, model_kind string, model_path string")
    return records.join(places, "model_name", "left")


def register(records: DataFrame, path: str) -> DataFrame:
    """Add records to the registry at ``path`` in one commit and read it back."""
    return registry.register(records, path)


def current_models(records: DataFrame) -> DataFrame:
    """The newest version per model and status."""
    rest = [c for c in records.columns if c not in ("model_name", "status")]
    newest = records.groupBy("model_name", "status").agg(
        F.max_by(F.struct(*rest), F.struct("trained_at", "version")).alias("r"))
    return newest.select("model_name", "status", "r.*")


def save(model, path: str) -> tuple[str, str]:
    """Store a fitted model at a new path; returns the kind and path that ``load`` takes."""
    if isinstance(model, KernelMachine):
        model.save(path)
        return "kernel", path
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().save(path)
    return "pipeline", path


def load(kind: str, path: str):
    """A stored model."""
    return KernelMachine.load(path) if kind == "kernel" else PipelineModel.load(path)


def load_current(records: DataFrame, status: str = "Production") -> dict[str, object]:
    """The newest stored version of each model with ``status``, by name."""
    rows = current_models(records).filter(F.col("status") == status) \
        .select("model_name", "model_kind", "model_path").collect()
    return {r.model_name: load(r.model_kind, r.model_path) for r in rows}
