"""Data exploration: quality, summaries, correlation, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import profiling
from riskloom.plans.catalog import query
from riskloom.plans.oracle import on_applications, on_audit
from riskloom.plans.shared import (
    CATEGORY_COLUMNS, EXPLORER_COLUMNS, PROFILE_COLUMNS, applications, prepared, rounded,
)
from riskloom.sources import applications as views

_MISSING = " + ".join(f"(count(*) - count({c}))" for c in EXPLORER_COLUMNS)
_COPIES = f"""
copies AS (SELECT coalesce(sum(n - 1), 0) AS d FROM (SELECT count(*) AS n FROM applications
           GROUP BY {', '.join(EXPLORER_COLUMNS)}))"""


@query("p10_column_kinds", on_applications(f"""
    SELECT count(*) AS n, {len(PROFILE_COLUMNS)} AS numeric_features, {1 + len(CATEGORY_COLUMNS)} AS categorical_features
    FROM applications"""))
def column_kinds(spark, sf_dir):
    df = applications(spark, sf_dir, *EXPLORER_COLUMNS)
    return df.agg(F.count("*").alias("n")).withColumns({
        "numeric_features": F.lit(len(profiling.numeric_columns(df))),
        "categorical_features": F.lit(len(profiling.categorical_columns(df)))})


@query("a2_value_counts", on_applications("""
    SELECT loan_purpose, count(*) AS n FROM applications WHERE loan_purpose IS NOT NULL
    GROUP BY loan_purpose ORDER BY n DESC, loan_purpose"""))
def value_counts(spark, sf_dir):
    return profiling.value_counts(applications(spark, sf_dir, "loan_purpose"), "loan_purpose")


@query("a3_quality_metrics", on_applications(f"""
    SELECT count(*) AS total_records, {len(EXPLORER_COLUMNS)} AS total_features, {_MISSING} AS missing_values,
           CAST((SELECT d FROM copies) AS BIGINT) AS duplicate_records, {len(PROFILE_COLUMNS)} AS numeric_features,
           {1 + len(CATEGORY_COLUMNS)} AS categorical_features FROM applications""", _COPIES))
def quality_metrics(spark, sf_dir):
    return profiling.quality_metrics(prepared(spark, sf_dir, *EXPLORER_COLUMNS), EXPLORER_COLUMNS)


@query("a4_missing_by_column", on_applications(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round((count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100, 2) AS missing_pct
    FROM applications HAVING count(*) > count({c})""" for c in EXPLORER_COLUMNS)))
def missing_by_column(spark, sf_dir):
    return profiling.missing_by_column(applications(spark, sf_dir, *EXPLORER_COLUMNS))


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "l_returnflag", "l_linestatus", "l_shipdate"]


@query("a5_duplicates", f"""
    SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_records FROM (
      SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(LINE_COLUMNS)})""")
def duplicates(spark, sf_dir):
    """Whole rows of the line table that repeat an earlier one."""
    return profiling.duplicate_count(views.read_table(spark, sf_dir, "lineitem"))


@query("a5_repeated_attributes", """
    SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_records FROM (
      SELECT count(*) AS n FROM lineitem
      GROUP BY l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)""")
def repeated_attributes(spark, sf_dir):
    """The same over chosen columns: line attributes without keys, price and date."""
    return profiling.duplicate_count(views.read_table(spark, sf_dir, "lineitem"), [
        "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus"])


@query("a6_quality_ratings", on_applications(f"""
    SELECT round(missing_pct, 6) AS missing_pct, CASE WHEN missing_pct < 1 THEN 'Excellent' WHEN missing_pct < 5 THEN 'Good'
             WHEN missing_pct < 10 THEN 'Warning' ELSE 'Poor' END AS missing_rating,
           round(duplicate_pct, 6) AS duplicate_pct, CASE WHEN duplicate_pct < 1 THEN 'Excellent' WHEN duplicate_pct < 3 THEN 'Good'
             WHEN duplicate_pct < 5 THEN 'Warning' ELSE 'Poor' END AS duplicate_rating
    FROM (SELECT ({_MISSING}) * CAST(100 AS DOUBLE) / (count(*) * {len(EXPLORER_COLUMNS)}) AS missing_pct,
                 (SELECT d FROM copies) * CAST(100 AS DOUBLE) / count(*) AS duplicate_pct FROM applications)""", _COPIES))
def quality_ratings(spark, sf_dir):
    metrics = profiling.quality_metrics(prepared(spark, sf_dir, *EXPLORER_COLUMNS), EXPLORER_COLUMNS)
    return rounded(profiling.quality_ratings(metrics), "missing_pct", "duplicate_pct")


def _describe_sql(c: str) -> str:
    stats = {
        "count": f"CAST(count({c}) AS DOUBLE)", "mean": f"avg({c})", "std": f"stddev_samp({c})",
        "min": f"CAST(min({c}) AS DOUBLE)", "25%": f"quantile_cont(CAST({c} AS DOUBLE), 0.25)",
        "50%": f"quantile_cont(CAST({c} AS DOUBLE), 0.5)", "75%": f"quantile_cont(CAST({c} AS DOUBLE), 0.75)",
        "max": f"CAST(max({c}) AS DOUBLE)",
    }
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS stat, round({v}, 6) AS value FROM applications"""
        for k, v in stats.items())


@query("a7_describe", on_applications(" UNION ALL ".join(_describe_sql(c) for c in PROFILE_COLUMNS)))
def describe(spark, sf_dir):
    return profiling.describe(prepared(spark, sf_dir, *PROFILE_COLUMNS), PROFILE_COLUMNS, digits=6)


@query("a8_categorical_summary", on_applications(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS unique_values, first(v ORDER BY n DESC, v) AS most_frequent, max(n) AS frequency
    FROM (SELECT {c} AS v, count(*) AS n FROM applications WHERE {c} IS NOT NULL GROUP BY {c})"""
    for c in ["customer_id", *CATEGORY_COLUMNS])))
def categorical_summary(spark, sf_dir):
    columns = ["customer_id", *CATEGORY_COLUMNS]
    return profiling.categorical_summary(applications(spark, sf_dir, *columns), columns)


def _corr_sql(a: str, b: str) -> str:
    return f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS r FROM applications"


@query("a9_correlation", on_applications(" UNION ALL ".join(
    _corr_sql(a, b) for a in PROFILE_COLUMNS for b in PROFILE_COLUMNS)))
def correlation(spark, sf_dir):
    return rounded(profiling.correlation_matrix(
        prepared(spark, sf_dir, *PROFILE_COLUMNS), PROFILE_COLUMNS), "r")


@query("a10_strong_correlations", on_applications(
    "SELECT * FROM (" + " UNION ALL ".join(
        _corr_sql(a, b) for i, a in enumerate(PROFILE_COLUMNS) for b in PROFILE_COLUMNS[i + 1:])
    + ") WHERE abs(r) > 0.7"))
def strong_correlations(spark, sf_dir):
    return rounded(profiling.strong_correlations(
        prepared(spark, sf_dir, *PROFILE_COLUMNS), PROFILE_COLUMNS), "r")


@query("a11_histogram", on_applications("""
    , r AS (SELECT min(loan_amount) AS lo, max(loan_amount) AS hi FROM applications),
    placed AS (SELECT CAST(least(floor((loan_amount - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n
      FROM applications, r WHERE loan_amount IS NOT NULL GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 30 * b.bin, 6) AS bin_start,
      round(lo + (hi - lo) / 30 * (b.bin + 1), 6) AS bin_end, coalesce(n, 0) AS n
    FROM range(30) b(bin) LEFT JOIN placed ON placed.bin = b.bin, r""".strip()))
def histogram(spark, sf_dir):
    return rounded(profiling.histogram(prepared(spark, sf_dir, "loan_amount"), "loan_amount"),
                   "bin_start", "bin_end")


@query("a12_box_statistics", on_applications("""
    , q AS (SELECT home_ownership, quantile_cont(annual_income, 0.25) AS q1, quantile_cont(annual_income, 0.5) AS median,
        quantile_cont(annual_income, 0.75) AS q3 FROM applications GROUP BY home_ownership)
    SELECT home_ownership, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(CASE WHEN annual_income BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN annual_income END) AS whisker_low,
      max(CASE WHEN annual_income BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN annual_income END) AS whisker_high,
      count(CASE WHEN annual_income NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers,
      count(annual_income) AS n
    FROM applications JOIN q USING (home_ownership) GROUP BY home_ownership, q1, median, q3""".strip()))
def box_statistics(spark, sf_dir):
    df = prepared(spark, sf_dir, "home_ownership", "annual_income")
    return rounded(profiling.box_statistics(df, "annual_income", "home_ownership"),
                   "q1", "median", "q3")


@query("a13_scatter_pairs", on_applications("""
    SELECT credit_score, loan_amount, home_ownership FROM applications"""))
def scatter_pairs(spark, sf_dir):
    return profiling.scatter_pairs(
        applications(spark, sf_dir, "credit_score", "loan_amount", "home_ownership"),
        "credit_score", "loan_amount", "home_ownership")


@query("a14_column_ranges", on_applications(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM applications"""
    for c in PROFILE_COLUMNS)))
def column_ranges(spark, sf_dir):
    return profiling.column_ranges(applications(spark, sf_dir, *PROFILE_COLUMNS), PROFILE_COLUMNS)


@query("a15_distinct_values", on_applications("SELECT DISTINCT home_ownership FROM applications"))
def distinct_values(spark, sf_dir):
    return profiling.distinct_values(applications(spark, sf_dir, "home_ownership"), "home_ownership")
