"""Derived features, scaling, encoding and outliers. One-row statistics enter as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import policy, session
from riskloom.operators import ranking

TREND_DAYS = 180


def utilization_trend(df: DataFrame) -> DataFrame:
    """Append utilization minus the customer's average over the trailing 180 days.

    Sums and counts are taken per (customer, day) first, so the window sees at most
    one row per day and customer.
    """
    day = F.unix_date(F.to_date("application_ts"))
    dated = df.withColumn("_day", day)
    daily = dated.groupBy("customer_id", "_day").agg(
        F.sum("credit_utilization").alias("_sum"), F.count("credit_utilization").alias("_n"))
    trailing = Window.partitionBy("customer_id").orderBy("_day").rangeBetween(1 - TREND_DAYS, 0)
    averages = daily.select(
        "customer_id", "_day",
        F.try_divide(F.sum("_sum").over(trailing), F.sum("_n").over(trailing)).alias("_avg"))
    return dated.join(averages, ["customer_id", "_day"], "left") \
        .withColumn("utilization_trend", F.col("credit_utilization") - F.col("_avg")) \
        .drop("_day", "_avg")


def derived_features(df: DataFrame) -> DataFrame:
    """Append the derived features whose inputs the table has."""
    have = set(df.columns)
    available = {
        "loan_to_income_ratio": (
            {"loan_amount", "annual_income"},
            lambda: F.try_divide(F.col("loan_amount"), F.col("annual_income"))),
        "income_per_person": (
            {"annual_income", "dependents"},
            lambda: F.col("annual_income") / (1 + F.col("dependents"))),
        "credit_age_score": (
            {"credit_score", "credit_history_months"},
            lambda: F.col("credit_score") / policy.MAX_CREDIT_SCORE
            * F.least(F.col("credit_history_months") / 120, F.lit(1.0))),
        "stability_score": (
            {"employment_length", "residence_length"},
            lambda: (F.col("employment_length") + F.col("residence_length")) / 2),
    }
    return df.withColumns({name: make() for name, (inputs, make) in available.items()
                           if inputs <= have})


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Replace ``columns`` by their scaled values: standard, minmax or robust."""
    if method == "robust":
        stats = ranking.quantile_map(ranking.column_quantiles(df, columns, [0.25, 0.5, 0.75]))
        centre = {c: F.col("_s")[c][1] for c in columns}
        width = {c: F.col("_s")[c][2] - F.col("_s")[c][0] for c in columns}
    else:
        low, spread = {
            "standard": (F.avg, F.stddev_samp),
            "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        }[method]
        stats = df.agg(F.struct(*[
            F.struct(low(c).alias("low"), spread(c).alias("spread")).alias(c) for c in columns
        ])).scalar()
        centre = {c: F.col("_s")[c]["low"] for c in columns}
        width = {c: F.col("_s")[c]["spread"] for c in columns}
    return df.withColumn("_s", stats).withColumns({
        c: F.try_divide(F.col(c) - centre[c], width[c]) for c in columns}).drop("_s")


def label_encode(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Append the alphabetical index of each known category; null for others.

    For an open domain use ``models.encoder``, which counts categories distributed.
    """
    codes = F.create_map(*[x for i, v in enumerate(sorted(values)) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(f"{column}_label", F.try_element_at(codes, F.col(column)))


def onehot_encode(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Append one 0/1 column per known category."""
    return df.withColumns({
        f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def target_encode(df: DataFrame, column: str, label: str) -> DataFrame:
    """Append the mean label of each category."""
    means = session.measured(
        df.groupBy(column).agg(F.avg(label).alias(f"{column}_target")), "category-means")
    return df.join(means, column, "left")


def outlier_limits(df: DataFrame, columns: list[str], method: str = "iqr") -> Column:
    """Scalar subquery: column name -> [low, high]."""
    if method == "iqr":
        spread = (F.col("q")[1] - F.col("q")[0]) * policy.IQR_FENCE
        rows = ranking.column_quantiles(df, columns, [0.25, 0.75]) \
            .withColumn("q", F.array(F.col("q")[0] - spread, F.col("q")[1] + spread))
    elif method == "zscore":
        rows = df.agg(*[
            F.array(F.avg(c) - policy.Z_LIMIT * F.stddev_samp(c),
                    F.avg(c) + policy.Z_LIMIT * F.stddev_samp(c)).alias(c) for c in columns
        ]).unpivot([], columns, "column", "q")
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return ranking.quantile_map(rows)


def flag_outliers(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Append ``<column>_outlier``; missing values are not outliers."""
    located = df.withColumn("_l", outlier_limits(df, columns, method))
    return located.withColumns({
        f"{c}_outlier": F.coalesce(
            ~F.col(c).between(F.col("_l")[c][0], F.col("_l")[c][1]), F.lit(False))
        for c in columns}).drop("_l")


def handle_outliers(df: DataFrame, columns: list[str], method: str = "iqr",
                    handling: str = "cap") -> DataFrame:
    """cap to the limits, remove the rows, or transform by log1p of the magnitude."""
    if handling == "transform":
        return df.withColumns({
            c: F.signum(F.col(c)) * F.log1p(F.abs(F.col(c))) for c in columns})
    located = df.withColumn("_l", outlier_limits(df, columns, method))
    if handling == "cap":
        return located.withColumns({
            c: F.when(F.col(c).isNotNull(), F.least(
                F.greatest(F.col(c).cast("double"), F.col("_l")[c][0]), F.col("_l")[c][1]))
            for c in columns}).drop("_l")
    if handling == "remove":
        keep = F.lit(True)
        for c in columns:
            keep = keep & F.coalesce(
                F.col(c).between(F.col("_l")[c][0], F.col("_l")[c][1]), F.lit(True))
        return located.filter(keep).drop("_l")
    raise ValueError(f"unknown handling: {handling}")
