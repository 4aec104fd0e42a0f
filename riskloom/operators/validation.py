"""Input validation, quarantine, domains, completeness and the data-quality verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import policy
from riskloom.operators import profiling


def missing_columns(df: DataFrame) -> list[str]:
    """Required scoring columns the table lacks (schema only, no job)."""
    return [c for c in policy.REQUIRED_COLUMNS if c not in df.columns]


def bad_score() -> Column:
    low, high = policy.CREDIT_SCORE_RANGE
    return (F.col("credit_score") < low) | (F.col("credit_score") > high)


def bad_income() -> Column:
    return F.col("annual_income") <= 0


def validation_report(df: DataFrame) -> DataFrame:
    """Error counts, messages and the verdict in one row; missing values are not errors."""
    missing = missing_columns(df)
    invalid_scores = F.count_if(bad_score()) if "credit_score" in df.columns else F.lit(0)
    invalid_income = F.count_if(bad_income()) if "annual_income" in df.columns else F.lit(0)
    counts = df.agg(invalid_scores.cast("long").alias("invalid_scores"),
                    invalid_income.cast("long").alias("invalid_income"))
    messages = F.array_compact(F.array(
        F.lit("Missing required columns: " + ", ".join(missing) if missing else None).cast("string"),
        F.when(F.col("invalid_scores") > 0, F.format_string(
            "Invalid credit scores found in %d rows", F.col("invalid_scores"))),
        F.when(F.col("invalid_income") > 0, F.format_string(
            "Invalid income values found in %d rows", F.col("invalid_income"))),
    ))
    return counts.select(
        F.lit(len(missing)).alias("missing_columns"), "invalid_scores", "invalid_income",
        messages.alias("errors"), (F.size(messages) == 0).alias("is_valid"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows): the row-level form of the gate."""
    bad = F.coalesce(bad_score() | bad_income(), F.lit(False))
    return df.filter(~bad), df.filter(bad)


def violated_rules(ranges: dict[str, tuple] = policy.FIELD_RANGES) -> Column:
    """Names of the fields outside their range, in rule order."""
    return F.array_compact(F.array(*[
        F.when(~F.col(c).between(low, high), c) for c, (low, high) in ranges.items()]))


def field_violations(df: DataFrame, ranges: dict[str, tuple] = policy.FIELD_RANGES) -> DataFrame:
    """(field, violations) for every constrained field, one pass."""
    row = df.agg(*[
        F.count_if(~F.col(c).between(low, high)).alias(c) for c, (low, high) in ranges.items()])
    return row.unpivot([], list(ranges), "field", "violations")


def domain_violations(df: DataFrame, domains: dict[str, list] = policy.DOMAINS) -> DataFrame:
    """(field, violations): present values outside the allowed list."""
    row = df.agg(*[F.count_if(~F.col(c).isin(values)).alias(c) for c, values in domains.items()])
    return row.unpivot([], list(domains), "field", "violations")


def outside_domain(df: DataFrame, column: str, domain: DataFrame, key: str) -> DataFrame:
    """Rows whose value has no entry in a domain table."""
    return df.join(domain, F.col(column) == domain[key], "left_anti")


def completeness(df: DataFrame, fields: list[str] = policy.REQUIRED_FIELDS) -> DataFrame:
    """(field, missing) for the required fields."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    return row.unpivot([], fields, "field", "missing")


def quality_verdict(df: DataFrame, outlier_columns: list[str],
                    duplicate_columns: list[str] | None = None) -> DataFrame:
    """Missing, duplicate, outlier and consistency ratios against their limits.

    Outliers are values beyond three standard deviations; a row is consistent when no
    field constraint is violated.
    """
    cells = len(df.columns)
    moments = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c)
        for c in outlier_columns])).scalar()
    with_moments = df.withColumn("_m", moments)
    missing, outliers = F.lit(0), F.lit(0)
    for c in df.columns:
        missing = missing + F.col(c).isNull().cast("int")
    for c in outlier_columns:
        far = F.abs(F.col(c) - F.col("_m")[c]["mean"]) > policy.Z_LIMIT * F.col("_m")[c]["std"]
        outliers = outliers + F.coalesce(far.cast("int"), F.lit(0))
    sums = with_moments.agg(
        F.count("*").alias("n"),
        F.sum(missing).alias("missing"),
        F.sum(outliers).alias("outliers"),
        F.count_if(F.size(violated_rules()) == 0).alias("consistent"),
    ).withColumn("duplicates", profiling.duplicate_count(df, duplicate_columns).scalar())
    n = F.col("n")
    ratios = {
        "missing": F.try_divide(F.col("missing"), n * cells),
        "duplicate": F.try_divide(F.col("duplicates"), n),
        "outlier": F.try_divide(F.col("outliers"), n * len(outlier_columns)),
        "consistency": F.try_divide(F.col("consistent"), n),
    }
    limit = F.create_map(*[x for k, v in policy.QUALITY_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    return sums.select(*[r.alias(k) for k, r in ratios.items()]) \
        .unpivot([], list(ratios), "check", "ratio") \
        .withColumn("limit", limit[F.col("check")]) \
        .withColumn("passed", F.when(F.col("check") == "consistency", F.col("ratio") >= F.col("limit"))
                    .otherwise(F.col("ratio") <= F.col("limit")))
