"""Binary-classifier evaluation from (model, label, score, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import policy, session
from riskloom.functions import scalar
from riskloom.operators import ranking

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


def predictions(df: DataFrame, scores: dict[str, str], label: str = "default_risk",
                threshold: float = policy.PROXY_CUT) -> DataFrame:
    """Long (model, label, score, prediction) from score columns; missing scores drop out."""
    columns = df.select(F.col(label).alias("label"),
                        *[F.col(c).cast("double").alias(m) for m, c in scores.items()])
    return columns.unpivot("label", list(scores), "model", "score") \
        .filter(F.col("label").isNotNull() & F.col("score").isNotNull()) \
        .withColumn("prediction", (F.col("score") > threshold).cast("int"))


def confusion(rows: DataFrame) -> DataFrame:
    """True and false negatives and positives per model."""
    return rows.filter(F.col("label").isNotNull() & F.col("prediction").isNotNull()) \
        .groupBy("model").agg(*_cells())


def _cells() -> list[Column]:
    """Counts of the four cells; rows without a label or a prediction are in none."""
    actual, predicted = F.col("label") == 1, F.col("prediction") == 1
    return [F.count_if(~actual & ~predicted).alias("tn"), F.count_if(~actual & predicted).alias("fp"),
            F.count_if(actual & ~predicted).alias("fn"), F.count_if(actual & predicted).alias("tp")]


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 when undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return matrix.select(
        "model",
        _or_zero(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def score_counts(rows: DataFrame, bins: int | None = None, cells: bool = False) -> DataFrame:
    """Positives and negatives per model and distinct score.

    ``bins`` rounds probabilities to a grid: an approximate curve of bounded length.
    ``cells`` adds the confusion cells of each score, so that one pass serves both.
    The counts are a written table, as ranking reads them several times.
    """
    score = F.col("score") if bins is None else F.floor(F.col("score") * bins) / bins
    counts = rows.groupBy("model", score.alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"),
        *(_cells() if cells else []))
    return session.materialize(counts, "score-counts")


def _ranked(counts: DataFrame) -> DataFrame:
    return ranking.cumulative(counts.select("model", "score", "pos", "neg"), ["model"], "score", ["pos", "neg"])


def ranked_scores(rows: DataFrame, bins: int | None = None) -> DataFrame:
    return _ranked(score_counts(rows, bins))


def roc_curve(rows: DataFrame, bins: int | None = None) -> DataFrame:
    """(model, threshold, fpr, tpr) for every distinct score, and the (0, 0) start without one."""
    counts = score_counts(rows, bins)
    points = _ranked(counts).select(
        "model", F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_total") - F.col("neg_before"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("tpr"))
    start = counts.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(rows: DataFrame, bins: int | None = None) -> DataFrame:
    """Exact area under the curve; tied scores count half."""
    return _area(score_counts(rows, bins))


def _area(counts: DataFrame) -> DataFrame:
    below = F.col("neg_before") + F.col("neg") / 2
    return _ranked(counts).groupBy("model").agg(
        F.sum(F.col("pos").cast("double") * below).alias("_area"),
        F.max("pos_total").cast("double").alias("_pos"), F.max("neg_total").alias("_neg"),
    ).select("model", F.try_divide(F.col("_area"), F.col("_pos") * F.col("_neg")).alias("roc_auc"))


def evaluate(rows: DataFrame) -> DataFrame:
    """One row per model with the five metrics, from one pass over the rows."""
    counts = score_counts(rows, cells=True)
    names = ["tn", "fp", "fn", "tp"]
    matrix = counts.groupBy("model").agg(*[F.sum(c).alias(c) for c in names]) \
        .filter(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") > 0)
    return classification_metrics(matrix).join(_area(counts), "model", "left")


def comparison(rows: DataFrame, digits: int = 4) -> DataFrame:
    return evaluate(rows).select(
        "model", *[F.round(m, digits).alias(m) for m in METRICS])


def positive_rate(df: DataFrame, label: str = "default_risk") -> DataFrame:
    return df.agg(F.avg(label).alias("positive_rate"))


def accuracy_zones(matrix: DataFrame) -> DataFrame:
    percentage = F.col("accuracy") * 100
    return classification_metrics(matrix).select(
        "model", percentage.alias("accuracy_pct"), scalar.accuracy_zone(percentage).alias("zone"))
