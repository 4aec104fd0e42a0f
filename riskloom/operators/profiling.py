"""Data profiling: quality, summaries, correlation, histograms, box statistics, filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom import policy, session
from riskloom.functions import scalar
from riskloom.operators import ranking

QUARTILES = [0.25, 0.5, 0.75]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Descending counts of present values, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), column)
    return ordered if limit is None else ordered.limit(limit)


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row, exact.

    Phase one counts 8-byte row hashes; only rows whose hash occurs twice go on to the
    comparison of all columns, so a wide table without copies is never shuffled whole.
    The hashes that occur twice are written first: where they are few, as in a table of
    few different rows, the planner broadcasts them and equal rows are combined in their
    task before any is moved.
    """
    columns = columns or df.columns
    hashed = df.select(*columns, F.xxhash64(*columns).alias("_hash"))
    repeated = session.measured(
        hashed.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash"), "repeated-hashes")
    copies = hashed.join(repeated, "_hash", "left_semi").groupBy(*columns) \
        .agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records"))


def _missing(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]


def quality_metrics(df: DataFrame, duplicate_columns: list[str] | None = None) -> DataFrame:
    """Records, features, missing cells, duplicate rows, column kinds: one row."""
    counts = df.agg(F.count("*").alias("total_records"), *_missing(df))
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.col(c)
    return counts.select(
        "total_records",
        F.lit(len(df.columns)).alias("total_features"),
        missing.alias("missing_values"),
        duplicate_count(df, duplicate_columns).scalar().alias("duplicate_records"),
        F.lit(len(numeric_columns(df))).alias("numeric_features"),
        F.lit(len(categorical_columns(df))).alias("categorical_features"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing_pct) where any value is missing."""
    row = df.agg(F.count("*").alias("_rows"), *_missing(df))
    return row.unpivot("_rows", df.columns, "column", "n").filter("n > 0").select(
        "column", F.round(F.col("n") / F.col("_rows") * 100, 2).alias("missing_pct"))


def quality_ratings(metrics: DataFrame) -> DataFrame:
    """Missing and duplicate percentages with their ratings."""
    records = F.col("total_records")
    rated = metrics.select(
        F.try_divide(F.col("missing_values") * 100.0, records * F.col("total_features"))
        .alias("missing_pct"),
        F.try_divide(F.col("duplicate_records") * 100.0, records).alias("duplicate_pct"),
    )
    return rated.select(
        "missing_pct",
        scalar.rating(F.col("missing_pct"), policy.MISSING_RATINGS).alias("missing_rating"),
        "duplicate_pct",
        scalar.rating(F.col("duplicate_pct"), policy.DUPLICATE_RATINGS).alias("duplicate_rating"),
    )


def describe(df: DataFrame, columns: list[str] | None = None, digits: int = 2,
             exact: bool = True) -> DataFrame:
    """(column, stat, value): count, mean, std, min, quartiles, max."""
    columns = columns or numeric_columns(df)
    moments = df.agg(*[
        F.struct(
            F.count(c).cast("double").alias("count"),
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ).alias(c) for c in columns
    ]).unpivot([], columns, "column", "m")
    quartiles = ranking.column_quantiles(df, columns, QUARTILES, exact)
    # Both sides hold one row per profiled column.
    joined = moments.join(quartiles, "column", "left")
    stats = {
        "count": F.col("m.count"), "mean": F.col("m.mean"), "std": F.col("m.std"),
        "min": F.col("m.min"), "25%": F.col("q")[0], "50%": F.col("q")[1],
        "75%": F.col("q")[2], "max": F.col("m.max"),
    }
    return joined.select("column", *[v.alias(k) for k, v in stats.items()]) \
        .unpivot("column", [f"`{k}`" for k in stats], "stat", "value") \
        .select("column", "stat", F.round("value", digits).alias("value"))


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values, mode (smallest on ties) and its frequency per text column."""
    columns = columns or categorical_columns(df)
    counts = df.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("column").agg(
        F.count("*").alias("unique_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_frequent"),
        F.max("n").alias("frequency"),
    )
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(found, "column", "left").select(
        "column",
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        F.coalesce("most_frequent", F.lit("N/A")).alias("most_frequent"),
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
    )


#: Rows of which co-moments are taken at a time.
_BLOCK = 8192


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations, long and square; null for constants.

    Each task takes the co-moments of all pairs by products of blocks of rows: with the values
    shifted by the column means, which keeps the squares accurate, and a mask of present
    values, four matrix products give the counts, sums, squares and products over the rows
    that have both values. A task sends one row a pair, whatever is missing where, and the
    rows are added. A task holds 32 bytes a pair of columns. ``df`` is read twice; pass a
    written table.
    """
    columns = columns or numeric_columns(df)
    session.ship(df.sparkSession)
    means = df.agg(F.array(*[F.avg(F.col(c).cast("double")) for c in columns])).scalar()
    shifted = df.select(*columns, means.alias("_m")).select(*[
        (F.col(c).cast("double") - F.coalesce(F.col("_m")[i], F.lit(0.0))).alias(f"x{i}") for i, c in enumerate(columns)])
    sums = shifted.mapInArrow(_co_moments, "i int, j int, n double, si double, sj double, sii double, sjj double, sij double")
    totals = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")]).filter("n > 0")
    # A spread within rounding error of zero means a constant.
    spread = "IF(s{0}{0} - s{0} * s{0} / n > 1e-12 * s{0}{0}, s{0}{0} - s{0} * s{0} / n, NULL)"
    upper = totals.selectExpr(
        "i", "j", f"(sij - si * sj / n) / sqrt({spread.format('i')}) / "
                  f"sqrt({spread.format('j')}) AS r")
    # Pairs without a common row have no totals; they come from the list of pairs.
    names, each = F.array(*[F.lit(c) for c in columns]), range(len(columns))
    listed = df.sparkSession.createDataFrame(
        [(i, j, min(i, j), max(i, j)) for i in each for j in each],
        "first int, second int, i int, j int")
    return listed.join(upper, ["i", "j"], "left").select(
        names[F.col("first")].alias("feature_1"), names[F.col("second")].alias("feature_2"), "r")


def _co_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums, squares and product of every pair of columns over the rows that have both."""
    total = None
    for batch in batches:
        k = batch.num_columns
        if total is None:
            total = np.zeros((4, k, k))
        for low in range(0, batch.num_rows, _BLOCK):
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.slice(low, _BLOCK).columns])
            present = (~np.isnan(values)).astype(float)
            values = np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf)
            total += [present.T @ present, values.T @ present, (values * values).T @ present, values.T @ values]
    if total is not None:
        i, j = np.triu_indices(total.shape[1])
        n, sums, squares, products = total
        columns = [i.astype(np.int32), j.astype(np.int32), n[i, j], sums[i, j], sums[j, i], squares[i, j], squares[j, i], products[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "si", "sj", "sii", "sjj", "sij"])


def strong_correlations(df: DataFrame, columns: list[str] | None = None,
                        limit: float = 0.7) -> DataFrame:
    """Pairs of different columns, each once, with abs(r) above ``limit``."""
    columns = columns or numeric_columns(df)
    position = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return correlation_matrix(df, columns).filter(
        (position[F.col("feature_1")] < position[F.col("feature_2")]) & (F.abs("r") > limit))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from min to max, empty ones included."""
    value = F.col(column).cast("double")
    present = df.filter(value.isNotNull())
    limits = present.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    placed = present.select(value.alias("v"), limits.alias("limits")).select(
        F.coalesce(
            F.least(
                F.floor(F.try_divide((F.col("v") - F.col("limits.low")) * bins,
                                     F.col("limits.high") - F.col("limits.low"))),
                F.lit(bins - 1)),
            F.lit(0)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = frame.join(counts, "bin", "left").select("bin", "n", limits.alias("limits"))
    low, width = F.col("limits.low"), (F.col("limits.high") - F.col("limits.low")) / bins
    return edges.select(
        "bin",
        (low + width * F.col("bin")).alias("bin_start"),
        (low + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (extremes inside the fences) and outliers per group.

    ``df`` is read four times; pass a written table. Rows are counted per group before
    any shuffle; only the values around the quartiles are ordered.
    """
    present = df.select(group, F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    quartiles = ranking.quantiles(present, [group], QUARTILES, closed=False).select(
        group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * policy.IQR_FENCE
    fenced = quartiles.withColumns({"_low": F.col("q1") - spread, "_high": F.col("q3") + spread})
    inside = F.col("value").between(F.col("_low"), F.col("_high"))
    return present.join(session.measured(fenced, "fences"), group).groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count("*").alias("n"),
    )


def scatter_pairs(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    return df.select(*[x, y] + ([color] if color else []))


def column_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, low, high) over numeric columns, one pass."""
    columns = columns or numeric_columns(df)
    row = df.agg(*[
        F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
        .alias(c) for c in columns])
    return row.unpivot([], columns, "column", "r").select("column", "r.low", "r.high")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null kept as a value."""
    return df.select(column).distinct()


@dataclass(frozen=True)
class NumericRange:
    """Inclusive range; missing values are dropped."""

    column: str
    low: float
    high: float

    def predicate(self) -> Column:
        return F.col(self.column).between(self.low, self.high)


@dataclass(frozen=True)
class CategorySet:
    """Chosen categories; missing values stay when None is chosen."""

    column: str
    values: tuple

    def predicate(self) -> Column:
        chosen = F.col(self.column).isin([v for v in self.values if v is not None])
        if None in self.values:
            chosen = chosen | F.col(self.column).isNull()
        return chosen


def matches(filters: list[NumericRange | CategorySet]) -> Column:
    keep = F.lit(True)
    for f in filters:
        keep = keep & f.predicate()
    return F.coalesce(keep, F.lit(False))


def apply_filters(df: DataFrame, filters: list[NumericRange | CategorySet]) -> DataFrame:
    return df.filter(matches(filters))


def filter_reduction(df: DataFrame, filters: list[NumericRange | CategorySet]) -> DataFrame:
    """Original and filtered record counts and the reduction in percent."""
    counts = df.agg(F.count("*").alias("original_records"),
                    F.count_if(matches(filters)).alias("filtered_records"))
    return counts.withColumn("reduction_pct", F.try_divide(
        (F.col("original_records") - F.col("filtered_records")) * 100.0, F.col("original_records")))
