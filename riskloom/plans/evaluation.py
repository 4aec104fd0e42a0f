"""Classifier evaluation from stored scores, and the split and fold assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import drift, evaluation, models
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_predictions
from riskloom.plans.shared import applications, predictions, prepared, rounded

METRICS = evaluation.METRICS


@query("m5_holdout_split", on_applications("""
    SELECT application_id, CASE WHEN b < 20 THEN 'test' WHEN b < 36 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT application_id, CAST('0x' || substr(md5(CAST(application_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b
          FROM applications)"""))
def holdout_split(spark, sf_dir):
    return models.assign_split(applications(spark, sf_dir, "application_id"))


@query("m6_confusion_matrix", on_predictions("SELECT model, tn, fp, fn, tp FROM confusion"))
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(predictions(spark, sf_dir))


@query("m7_classification_metrics", on_predictions("""
    SELECT model, accuracy, "precision", recall, f1_score FROM model_metrics"""))
def classification_metrics(spark, sf_dir):
    return evaluation.classification_metrics(evaluation.confusion(predictions(spark, sf_dir)))


@query("m8_roc_curve", on_predictions("""
    SELECT model, score AS threshold, fp_so_far / CAST(neg_total AS DOUBLE) AS fpr,
           tp_so_far / CAST(pos_total AS DOUBLE) AS tpr FROM ranked
    UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked"""))
def roc_curve(spark, sf_dir):
    return evaluation.roc_curve(predictions(spark, sf_dir))


@query("m9_roc_auc", on_predictions("SELECT model, round(roc_auc, 9) AS roc_auc FROM auc"))
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(predictions(spark, sf_dir)), "roc_auc", digits=9)


@query("m10_model_comparison", on_predictions("""
    SELECT model, round(accuracy, 4) AS accuracy, round("precision", 4) AS "precision", round(recall, 4) AS recall,
      round(f1_score, 4) AS f1_score, round(roc_auc, 4) AS roc_auc FROM model_metrics"""))
def model_comparison(spark, sf_dir):
    return evaluation.comparison(predictions(spark, sf_dir))


@query("m12_stratified_folds", on_applications("""
    SELECT application_id, default_risk, CAST((row_number() OVER (PARTITION BY default_risk
        ORDER BY application_id % 10007, application_id) - 1) % 5 AS INTEGER) AS fold FROM applications"""))
def stratified_folds(spark, sf_dir):
    df = prepared(spark, sf_dir, "application_id", "default_risk")
    return models.assign_folds(df, "default_risk").select("application_id", "default_risk", "fold")


DRIFT_FEATURES = models.FEATURES
_DRIFT_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, application_ts >= DATE '1999-01-01' AS cur "
    f"FROM applications WHERE {c} IS NOT NULL" for c in DRIFT_FEATURES)
_DRIFT_LIMITS = " + ".join(f"CAST(value > d[{i}] AS INTEGER)" for i in range(1, 10))


@query("m17_drift", on_applications(f"""
    , long AS ({_DRIFT_LONG}),
    d AS (SELECT feature AS f, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS d FROM long WHERE NOT cur GROUP BY feature),
    b AS (SELECT feature, {_DRIFT_LIMITS} AS bin, count(CASE WHEN NOT cur THEN 1 END) AS r, count(CASE WHEN cur THEN 1 END) AS c
      FROM long JOIN d ON f = feature GROUP BY 1, 2),
    s AS (SELECT feature, greatest(r / CAST(sum(r) OVER (PARTITION BY feature) AS DOUBLE), 0.000001) AS q,
        greatest(c / CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE), 0.000001) AS p FROM b)
    SELECT feature, round(sum((p - q) * ln(p / q)), 6) AS psi, sum((p - q) * ln(p / q)) > 0.1 AS drifted
    FROM s GROUP BY feature""".strip()))
def population_drift(spark, sf_dir):
    df = prepared(spark, sf_dir, "application_ts", *DRIFT_FEATURES)
    result = drift.population_stability(df, DRIFT_FEATURES, "application_ts", "1999-01-01")
    return rounded(result, "psi")


DRIFT_WINDOWS = (("1996-03-01", "1996-11-30"), ("1998-02-01", "2000-04-30"))


@query("m17_daily_drift", on_applications(f"""
    , long AS ({_DRIFT_LONG.replace("application_ts >= DATE '1999-01-01' AS cur", "CAST(application_ts AS DATE) AS day")}),
    d AS (SELECT feature AS f, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS d FROM long WHERE day < DATE '1996-01-01' GROUP BY feature),
    b AS (SELECT feature, {_DRIFT_LIMITS} AS bin, count(CASE WHEN day BETWEEN DATE '{DRIFT_WINDOWS[0][0]}' AND DATE '{DRIFT_WINDOWS[0][1]}' THEN 1 END) AS r,
        count(CASE WHEN day BETWEEN DATE '{DRIFT_WINDOWS[1][0]}' AND DATE '{DRIFT_WINDOWS[1][1]}' THEN 1 END) AS c FROM long JOIN d ON f = feature GROUP BY 1, 2),
    s AS (SELECT feature, greatest(r / CAST(sum(r) OVER (PARTITION BY feature) AS DOUBLE), 0.000001) AS q,
        greatest(c / CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE), 0.000001) AS p FROM b)
    SELECT feature, round(sum((p - q) * ln(p / q)), 6) AS psi, sum((p - q) * ln(p / q)) > 0.1 AS drifted
    FROM s GROUP BY feature""".strip()))
def daily_drift(spark, sf_dir):
    """Two windows compared from stored daily counts, which were written in two parts and added."""
    df = prepared(spark, sf_dir, "application_ts", *DRIFT_FEATURES)
    early = F.col("application_ts") < F.lit("1996-01-01").cast("timestamp")
    limits = session.measured(drift.bin_limits(df.filter(early), DRIFT_FEATURES), "limits")
    path = session.scratch_path(spark, "daily-bins")
    for part in (early, ~early):
        drift.daily_bins(df.filter(part), DRIFT_FEATURES, "application_ts", limits).write.mode("append").parquet(path)
    return rounded(drift.stability_between(spark.read.parquet(path), *DRIFT_WINDOWS), "psi")


@query("m16_performance_gate", on_applications("""
    , w AS (SELECT CASE WHEN application_ts >= DATE '1999-01-01' THEN 'current' ELSE 'reference' END AS period,
        default_risk AS label, debt_to_income AS score FROM applications WHERE debt_to_income IS NOT NULL),
    g AS (SELECT period, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM w GROUP BY 1, 2),
    r AS (SELECT *, sum(neg) OVER (PARTITION BY period ORDER BY score) - neg AS below FROM g),
    a AS (SELECT period, sum(pos * (below + neg / CAST(2 AS DOUBLE))) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS auc FROM r GROUP BY period)
    SELECT 'debt' AS model, round(ref.auc, 6) AS reference, round(cur.auc, 6) AS "current",
      cur.auc >= 0.75 AS gate_passed, ref.auc - cur.auc > 0.05 AS degraded
    FROM (SELECT auc FROM a WHERE period = 'reference') ref, (SELECT auc FROM a WHERE period = 'current') cur""".strip()))
def performance_gate(spark, sf_dir):
    """Ranking quality of a score before and after a date."""
    df = prepared(spark, sf_dir, "application_ts", "debt_to_income", "default_risk")
    recent = F.col("application_ts") >= F.lit("1999-01-01").cast("timestamp")
    auc = lambda part: evaluation.roc_auc(evaluation.predictions(part, {"debt": "debt_to_income"}))
    result = drift.performance_gate(auc(df.filter(recent)), auc(df.filter(~recent)))
    return rounded(result, "reference", "current")
