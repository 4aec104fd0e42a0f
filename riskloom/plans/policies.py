"""Derived features, scaling, encoding, outliers, alert priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import policy
from riskloom.operators import encoding, features, models, rules
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_audit
from riskloom.plans.shared import PROFILE_COLUMNS, applications, prepared, rounded
from riskloom.sources import applications as views

SCALED = PROFILE_COLUMNS[:-1]


@query("p22_derived_features", on_applications("""
    SELECT application_id, loan_amount / nullif(annual_income, 0) AS loan_to_income_ratio,
      credit_score / CAST(850 AS DOUBLE) * least(credit_history_months / CAST(120 AS DOUBLE), 1) AS credit_age_score
    FROM applications"""))
def derived_features(spark, sf_dir):
    df = applications(spark, sf_dir, "application_id", "loan_amount", "annual_income",
                      "credit_score", "credit_history_months")
    return features.derived_features(df).select(
        "application_id", "loan_to_income_ratio", "credit_age_score")


@query("p22_utilization_trend", on_applications("""
    , t AS (SELECT application_id, credit_utilization, avg(credit_utilization) OVER (PARTITION BY customer_id
        ORDER BY datediff('day', DATE '1970-01-01', CAST(application_ts AS DATE))
        RANGE BETWEEN 179 PRECEDING AND CURRENT ROW) AS average FROM applications)
    SELECT application_id, round(credit_utilization - average, 6) + 0 AS utilization_trend FROM t""".strip()))
def utilization_trend(spark, sf_dir):
    df = prepared(spark, sf_dir, "application_id", "customer_id", "application_ts",
                      "credit_utilization")
    return rounded(features.utilization_trend(df), "utilization_trend") \
        .select("application_id", (F.col("utilization_trend") + 0.0).alias("utilization_trend"))


def _scale_sql(centre: str, width: str) -> str:
    return "SELECT application_id, " + ", ".join(
        f"round(({c} - (SELECT {centre.format(c=c)} FROM applications)) / "
        f"nullif((SELECT {width.format(c=c)} FROM applications), 0), 6) + 0 AS {c}" for c in SCALED
    ) + " FROM applications"


def _scaled(spark, sf_dir, method):
    df = prepared(spark, sf_dir, "application_id", *SCALED)
    scaled = rounded(features.scale(df, SCALED, method), *SCALED)
    return scaled.select("application_id", *[(F.col(c) + 0.0).alias(c) for c in SCALED])


@query("p23_scale_standard", on_applications(_scale_sql("avg({c})", "stddev_samp({c})")))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("p23_scale_minmax", on_applications(_scale_sql("min({c})", "max({c}) - min({c})")))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("p23_scale_robust", on_applications(_scale_sql(
    "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")))
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@query("p24_encode", on_applications("""
    SELECT application_id, CASE home_ownership WHEN 'MORTGAGE' THEN 0 WHEN 'OTHER' THEN 1 WHEN 'OWN' THEN 2
        WHEN 'RENT' THEN 3 END AS home_ownership_label,
      CAST(employment_status = 'EMPLOYED' AS INTEGER) AS employment_status_EMPLOYED,
      CAST(employment_status = 'SELF_EMPLOYED' AS INTEGER) AS employment_status_SELF_EMPLOYED,
      CAST(employment_status = 'UNEMPLOYED' AS INTEGER) AS employment_status_UNEMPLOYED,
      CAST(employment_status = 'RETIRED' AS INTEGER) AS employment_status_RETIRED,
      round(avg(default_risk) OVER (PARTITION BY loan_purpose), 6) AS loan_purpose_target
    FROM applications"""))
def encode(spark, sf_dir):
    """label, one-hot and target encoding."""
    df = prepared(spark, sf_dir, "application_id", "home_ownership", "employment_status",
                      "loan_purpose", "default_risk")
    labelled = features.label_encode(df, "home_ownership", policy.DOMAINS["home_ownership"])
    flags = features.onehot_encode(labelled, "employment_status", policy.DOMAINS["employment_status"])
    encoded = features.target_encode(flags, "loan_purpose", "default_risk")
    return rounded(encoded, "loan_purpose_target").drop(
        "home_ownership", "employment_status", "loan_purpose", "default_risk")


@query("p24_encode_fitted", on_applications("""
    SELECT application_id, CAST(dense_rank() OVER (ORDER BY loan_purpose NULLS LAST) - 1 AS DOUBLE) AS loan_purpose_label,
      round(avg(default_risk) OVER (PARTITION BY loan_purpose), 6) AS loan_purpose_target FROM applications"""))
def encode_fitted(spark, sf_dir):
    """The encoders fitted on the data, for open category sets."""
    df = prepared(spark, sf_dir, "application_id", "loan_purpose", "default_risk")
    fitted = models.encoder(["loan_purpose"], "target", "default_risk").fit(df).transform(df)
    return rounded(fitted.select("application_id", "loan_purpose_label", "loan_purpose_target"), "loan_purpose_target")


_SMOOTHING = 10.0


@query("p24_encode_open", on_applications(f"""
    , placed AS (SELECT application_id, customer_id, default_risk, application_id % 5 AS fold FROM applications),
    cells AS (SELECT customer_id, fold, count(default_risk) AS n, coalesce(sum(default_risk), 0) AS s FROM placed GROUP BY ALL),
    folds AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM cells GROUP BY fold),
    priors AS (SELECT fold, CAST((SELECT sum(s) FROM folds) - s AS DOUBLE) / nullif((SELECT sum(n) FROM folds) - n, 0) AS prior FROM folds),
    others AS (SELECT customer_id, fold, sum(n) OVER (PARTITION BY customer_id) - n AS n,
        CAST(sum(s) OVER (PARTITION BY customer_id) - s AS DOUBLE) AS s FROM cells)
    SELECT application_id, CAST(dense_rank() OVER (ORDER BY placed.customer_id) - 1 AS BIGINT) AS customer_id_label,
      round(CASE WHEN n > 0 THEN (s + {_SMOOTHING} * prior) / (n + {_SMOOTHING}) ELSE prior END, 9) AS customer_id_target
    FROM placed JOIN others USING (customer_id, fold) JOIN priors USING (fold)""".strip()))
def encode_open(spark, sf_dir):
    """Customers, an open set, by a distributed dictionary and by out-of-fold default rates."""
    df = prepared(spark, sf_dir, "application_id", "customer_id", "default_risk")
    df = df.withColumn("fold", F.pmod("application_id", F.lit(5)))
    labelled = encoding.label_encode(df, "customer_id", encoding.dictionary(df, "customer_id"))
    encoded = encoding.out_of_fold_target(labelled, "customer_id", "default_risk", "fold", _SMOOTHING)
    return rounded(encoded.select("application_id", "customer_id_label", "customer_id_target"), "customer_id_target", digits=9)


OUTLIER_COLUMNS = PROFILE_COLUMNS[:-1]  # every numeric feature; the last one is the label
_IQR = f"""
    , q AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_3' for c in OUTLIER_COLUMNS)}
      FROM applications),
    f AS (SELECT {', '.join(f'{c}_1 - ({c}_3 - {c}_1) * 1.5 AS {c}_l, {c}_3 + ({c}_3 - {c}_1) * 1.5 AS {c}_h' for c in OUTLIER_COLUMNS)} FROM q)"""
_Z = f"""
    , f AS (SELECT {', '.join(f'avg({c}) - 3 * stddev_samp({c}) AS {c}_l, avg({c}) + 3 * stddev_samp({c}) AS {c}_h' for c in OUTLIER_COLUMNS)} FROM applications)"""
_FLAGS = f"""
    SELECT application_id, {', '.join(f'coalesce({c} NOT BETWEEN {c}_l AND {c}_h, false) AS {c}_outlier' for c in OUTLIER_COLUMNS)}
    FROM applications, f"""


@query("p25_outliers_iqr", on_applications(_IQR.strip() + _FLAGS))
def outliers_iqr(spark, sf_dir):
    df = prepared(spark, sf_dir, "application_id", *OUTLIER_COLUMNS)
    return features.flag_outliers(df, OUTLIER_COLUMNS, "iqr").drop(*OUTLIER_COLUMNS)


@query("p25_outliers_zscore", on_applications(_Z.strip() + _FLAGS))
def outliers_zscore(spark, sf_dir):
    df = prepared(spark, sf_dir, "application_id", *OUTLIER_COLUMNS)
    return features.flag_outliers(df, OUTLIER_COLUMNS, "zscore").drop(*OUTLIER_COLUMNS)


@query("p25_outliers_capped", on_applications(_IQR.strip() + f"""
    SELECT application_id, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN round(least(greatest({c}, {c}_l), {c}_h), 6) END AS {c}' for c in OUTLIER_COLUMNS)}
    FROM applications, f"""))
def outliers_capped(spark, sf_dir):
    df = prepared(spark, sf_dir, "application_id", *OUTLIER_COLUMNS)
    return rounded(features.handle_outliers(df, OUTLIER_COLUMNS, "iqr", "cap"), *OUTLIER_COLUMNS)


@query("p25_outliers_removed", on_applications(_IQR.strip() + f"""
    SELECT application_id FROM applications, f
    WHERE {' AND '.join(f'coalesce({c} BETWEEN {c}_l AND {c}_h, true)' for c in OUTLIER_COLUMNS)}"""))
def outliers_removed(spark, sf_dir):
    df = prepared(spark, sf_dir, "application_id", *OUTLIER_COLUMNS)
    return features.handle_outliers(df, OUTLIER_COLUMNS, "iqr", "remove").select("application_id")


@query("p25_outliers_transformed", on_applications(f"""
    SELECT application_id, {', '.join(f'round(sign({c}) * ln(1 + abs({c})), 6) AS {c}' for c in OUTLIER_COLUMNS)} FROM applications"""))
def outliers_transformed(spark, sf_dir):
    df = applications(spark, sf_dir, "application_id", *OUTLIER_COLUMNS)
    return rounded(features.handle_outliers(df, OUTLIER_COLUMNS, handling="transform"),
                   *OUTLIER_COLUMNS)


@query("k7_prioritised_alerts", on_audit("""
    SELECT audit_id, level, CASE level WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS priority
    FROM (SELECT audit_id, CASE WHEN status = 'Failed' AND risk_level = 'High' THEN 'critical'
            WHEN status = 'Failed' THEN 'error' WHEN risk_level = 'High' THEN 'warning' ELSE 'info' END AS level
          FROM audit) ORDER BY priority DESC, audit_id"""))
def prioritised_alerts(spark, sf_dir):
    failed, high = F.col("status") == "Failed", F.col("risk_level") == "High"
    alerts = views.audit_trail(spark, sf_dir).withColumn(
        "level", F.when(failed & high, "critical").when(failed, "error")
        .when(high, "warning").otherwise("info"))
    return rules.prioritised_alerts(alerts, ["audit_id"]).select("audit_id", "level", "priority")
