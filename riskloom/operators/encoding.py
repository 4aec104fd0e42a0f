"""Encodings of open category sets: distributed dictionaries and out-of-fold target means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskloom import session

_ROW_BITS = 33  # of monotonically_increasing_id: partition above, row below


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values of ``column`` in order, numbered from 0; null has no code.

    Values are cut into ranges, each range is sorted in its own task and starts after the
    values of the ranges before it. The driver holds nothing; an empty table gives an
    empty dictionary.
    """
    spark = df.sparkSession
    values = df.select(F.col(column).alias("value")).dropna().distinct()
    place = F.monotonically_increasing_id()
    placed = values.repartitionByRange(session.parallelism(spark), "value").sortWithinPartitions("value") \
        .withColumn("_place", place)
    placed = session.materialize(placed, "dictionary")
    part = F.shiftright("_place", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("_part", part).join(offsets, "_part") \
        .select("value", (F.col("_offset") + inside).alias("code"))


def label_encode(df: DataFrame, column: str, known: DataFrame, output: str | None = None) -> DataFrame:
    """Append the code of ``column`` by a ``dictionary``; null and unknown values get the next free code.

    The dictionary is a written table, so that the planner broadcasts it only if its files
    are small; its values are unique, so a hot value's rows can be split.
    """
    known = session.measured(known.withColumnsRenamed({"value": "_value", "code": "_code"}), "codes")
    size = known.agg(F.count("*")).scalar()
    return df.join(known, df[column] == known["_value"], "left") \
        .withColumn(output or f"{column}_label", F.coalesce("_code", size)).drop("_value", "_code")


def out_of_fold_target(df: DataFrame, column: str, label: str, fold: str, smoothing: float = 0.0,
                       output: str | None = None) -> DataFrame:
    """Append the mean label of a row's category over the rows of all other folds.

    A row's own label, and those of its fold, never enter its code. The mean is drawn
    towards the other folds' overall mean by ``smoothing`` rows of it; a category that the
    other folds do not have gets that overall mean, null where there is no other label.
    Null is a category, rows with a null label are encoded but not counted, a null fold is
    a fold. Sums are taken per (category, fold) before anything is joined, so a category
    of any size is one row a fold.
    """
    names = dict(value=F.col(column), fold=F.col(fold))
    cells = df.groupBy(*[c.alias(f"_{n}") for n, c in names.items()]).agg(
        F.count(label).alias("_rows"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("_hits"))
    cells = session.materialize(cells, "cells")
    folds = cells.groupBy("_fold").agg(F.sum("_rows").alias("_fold_rows"), F.sum("_hits").alias("_fold_hits"))
    everything = Window.partitionBy()
    prior = F.try_divide(F.sum("_fold_hits").over(everything) - F.col("_fold_hits"),
                         F.sum("_fold_rows").over(everything) - F.col("_fold_rows"))
    priors = folds.select(F.col("_fold").alias("_of"), prior.alias("_prior"))  # one row a fold
    category = Window.partitionBy("_value")
    others = lambda c: F.sum(c).over(category) - F.col(c)
    means = cells.withColumns({"_n": others("_rows"), "_s": others("_hits")}) \
        .join(priors, F.col("_fold").eqNullSafe(F.col("_of")))
    drawn = F.try_divide(F.col("_s") + F.coalesce(smoothing * F.col("_prior"), F.lit(0.0)), F.col("_n") + smoothing)
    code = F.when(F.col("_n") > 0, drawn).otherwise(F.col("_prior"))
    means = session.measured(means.select("_value", "_fold", code.alias("_code")), "means")
    same = df[column].eqNullSafe(means["_value"]) & df[fold].eqNullSafe(means["_fold"])
    return df.join(means, same).withColumn(output or f"{column}_target", F.col("_code")).drop("_value", "_fold", "_code")
