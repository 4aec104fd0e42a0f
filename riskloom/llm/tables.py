"""Global row numbers and small helpers for written tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import riskloom
from riskloom.session import materialize

_shipped: dict[str, str] = {}


def with_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Number the rows from 0 in ``order``, without sorting in one task.

    Rows are range-partitioned and written sorted; a row's number is its place in its
    part plus the rows of the parts before. One row per part is summed on one task.
    Equal keys may come in any order, so ``order`` should be unique. ``df`` should be
    narrow.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialize(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "position")
    kept = kept.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    parts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in parts:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "_part long, _before long")
    joined = kept.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_before")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once per application.

    The Arrow functions are pickled by reference, so workers must be able to import
    them wherever the driver was started from.
    """
    context = spark.sparkContext
    if _shipped.get("application") != context.applicationId:
        package = Path(riskloom.__file__).parent
        target = Path(tempfile.mkdtemp()) / "riskloom.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for module in sorted(package.rglob("*.py")):
                archive.write(module, module.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped["application"] = context.applicationId
    return spark
