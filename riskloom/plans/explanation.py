"""Attributions, importance, waterfall, partial dependence of the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import scalar
from riskloom.operators import explain
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_phi, on_scored
from riskloom.plans.shared import prepared, rounded
from riskloom.sources import applications as views


def inputs(spark, sf_dir):
    return prepared(spark, sf_dir, *views.SCORING_COLUMNS)


@query("x1_scorecard_attribution", on_phi("""
    SELECT application_id, round(base, 6) AS base, feature, feature_value, round(phi, 6) + 0 AS phi FROM phi_long"""))
def scorecard_attribution(spark, sf_dir):
    rows = rounded(explain.scorecard_attribution(inputs(spark, sf_dir)), "base", "phi")
    return rows.withColumn("phi", F.col("phi") + 0.0)


@query("x3_waterfall", on_phi("""
    , steps AS (
      SELECT application_id, 0 AS step, 'Base Value' AS label, base AS amount, base AS running FROM phi
      UNION ALL SELECT application_id, 1, 'Credit Score', p1, base + p1 FROM phi
      UNION ALL SELECT application_id, 2, 'Annual Income', p2, base + p1 + p2 FROM phi
      UNION ALL SELECT application_id, 3, 'Debt-to-Income', p3, base + p1 + p2 + p3 FROM phi
      UNION ALL SELECT application_id, 4, 'Employment Length', p4, base + p1 + p2 + p3 + p4 FROM phi
      UNION ALL SELECT application_id, 5, 'Loan Amount', p5, base + p1 + p2 + p3 + p4 + p5 FROM phi
      UNION ALL SELECT application_id, 6, 'Credit Utilization', p6, base + p1 + p2 + p3 + p4 + p5 + p6 FROM phi
      UNION ALL SELECT application_id, 7, 'Final Prediction', base + p1 + p2 + p3 + p4 + p5 + p6,
        base + p1 + p2 + p3 + p4 + p5 + p6 FROM phi)
    SELECT application_id, step, label, round(amount, 4) + 0 AS amount, round(running, 4) + 0 AS running FROM steps""".strip()))
def waterfall(spark, sf_dir):
    rows = rounded(explain.waterfall(inputs(spark, sf_dir)), "amount", "running", digits=4)
    return rows.withColumns({c: F.col(c) + 0.0 for c in ("amount", "running")})


@query("x4_summary_points", on_phi("""
    SELECT application_id, rank, feature, round(phi, 6) + 0 AS phi, feature_value
    FROM phi_long JOIN importance USING (feature)"""))
def summary_points(spark, sf_dir):
    rows = explain.summary_points(inputs(spark, sf_dir))
    return rows.withColumns({"rank": F.col("rank").cast("bigint"),
                             "phi": F.round("phi", 6) + 0.0})


@query("x4_summary_sample", on_scored("""
    , drawn AS (SELECT * FROM scored WHERE risk_score IS NOT NULL
        ORDER BY md5(CAST(application_id AS VARCHAR)), application_id LIMIT 200),
    m AS (SELECT avg(c1) AS m1, avg(c2) AS m2, avg(c3) AS m3, avg(c4) AS m4, avg(c5) AS m5, avg(c6) AS m6 FROM scored WHERE risk_score IS NOT NULL)
    SELECT application_id, round(c1 - m1, 9) + 0 AS credit_score_phi, round(c4 - m4, 9) + 0 AS employment_phi
    FROM drawn, m""".strip()))
def summary_sample(spark, sf_dir):
    """The sampled form: attributions within a repeatable draw of 200 applications."""
    points = explain.summary_points(inputs(spark, sf_dir), sample=200)
    pick = lambda label: F.max(F.when(F.col("feature") == label, F.col("phi")))
    wide = points.groupBy("application_id").agg(
        pick("Credit Score").alias("credit_score_phi"),
        pick("Employment Length").alias("employment_phi"))
    return wide.select("application_id", *[
        (F.round(c, 9) + 0.0).alias(c) for c in ("credit_score_phi", "employment_phi")])


@query("x5_global_importance", on_phi(
    "SELECT feature, round(importance, 6) AS importance, CAST(rank AS INTEGER) AS rank FROM importance"))
def global_importance(spark, sf_dir):
    return rounded(explain.global_importance(inputs(spark, sf_dir)), "importance")


def _pdp_sql(column: str, term: str) -> str:
    rest = [t for t in ("c1", "c2", "c3", "c4", "c5", "c6") if t != term]
    share = {
        "c1": "(1 - least(g / 850, 1)) * CAST(0.25 AS DOUBLE)",
        "c3": "g * CAST(0.2 AS DOUBLE)",
    }[term]
    return f"""
    , complete AS (SELECT * FROM scored WHERE risk_score IS NOT NULL),
    lim AS (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM complete),
    grid AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) / 49 * i AS g FROM range(50) r(i), lim)
    SELECT point, round(max(g), 6) AS feature_value,
      round(avg(least({' + '.join(rest)} + {share}, 1)), 6) AS mean_score
    FROM complete, grid GROUP BY point""".strip()


@query("x6_partial_dependence", on_scored(_pdp_sql("debt_to_income", "c3")))
def partial_dependence(spark, sf_dir):
    return rounded(explain.partial_dependence(inputs(spark, sf_dir), "debt_to_income"),
                   "feature_value", "mean_score")


@query("x6_partial_dependence_score", on_scored(_pdp_sql("credit_score", "c1")))
def partial_dependence_score(spark, sf_dir):
    return rounded(explain.partial_dependence(inputs(spark, sf_dir), "credit_score"),
                   "feature_value", "mean_score")


@query("x7_individual_explanation", on_phi("""
    SELECT application_id, risk_score AS probability, CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN 'High'
        WHEN risk_score > CAST(0.3 AS DOUBLE) THEN 'Medium' ELSE 'Low' END AS risk_level, round(base, 6) AS base_rate,
      CASE WHEN p1 > 0 THEN 'increases' ELSE 'decreases' END AS credit_score_direction, 6 AS impacts, TRUE AS impacts_fit
    FROM phi"""))
def individual_explanation(spark, sf_dir):
    """Each impact's text is held against the feature's attribution: name, direction and size."""
    df = inputs(spark, sf_dir)
    rows = explain.individual_explanation(df)
    told = explain.scorecard_attribution(df).select("application_id", F.concat(
        F.col("feature"), F.when(F.col("phi") > 0, " increases").otherwise(" decreases"), F.lit(" risk by "),
        F.format_string("%.3f", F.abs("phi"))).alias("t")).groupBy("application_id").agg(F.array_sort(F.collect_list("t")).alias("told"))
    direction = F.regexp_extract(F.col("impacts")[0], "(increases|decreases)", 1)
    checked = rows.join(told, "application_id").withColumns({
        "credit_score_direction": direction, "impacts_fit": F.array_sort("impacts") == F.col("told"), "impacts": F.size("impacts")})
    return rounded(checked.drop("told"), "base_rate")


@query("p17_impact_direction", on_phi("""
    SELECT feature, CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END AS direction, count(*) AS n,
           round(avg(abs(phi)), 6) AS mean_size FROM phi_long GROUP BY 1, 2"""))
def impact_direction(spark, sf_dir):
    rows = explain.scorecard_attribution(inputs(spark, sf_dir))
    return rounded(rows.groupBy("feature", scalar.impact_direction(F.col("phi")).alias("direction")).agg(
        F.count("*").alias("n"), F.avg(F.abs("phi")).alias("mean_size")), "mean_size")
