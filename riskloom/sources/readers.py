"""File readers with explicit schemas and dataset information."""

from __future__ import annotations

import re
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

APPLICATIONS = T.StructType([
    T.StructField("application_id", T.LongType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("application_ts", T.TimestampType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("annual_income", T.DoubleType()),
    T.StructField("credit_score", T.IntegerType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("employment_length", T.DoubleType()),
    T.StructField("debt_to_income", T.DoubleType()),
    T.StructField("credit_utilization", T.DoubleType()),
    T.StructField("delinquencies_2yrs", T.IntegerType()),
    T.StructField("inquiries_6mths", T.IntegerType()),
    T.StructField("open_accounts", T.IntegerType()),
    T.StructField("total_accounts", T.IntegerType()),
    T.StructField("loan_purpose", T.StringType()),
    T.StructField("home_ownership", T.StringType()),
    T.StructField("employment_status", T.StringType()),
    T.StructField("default_risk", T.IntegerType()),
])

CORRUPT = "_corrupt"
#: Files whose first line is read side by side.
HEADERS_AT_ONCE = 16


def schema_of(columns: list[str]) -> T.StructType:
    """The application schema cut down to ``columns``, in the given order."""
    return T.StructType([APPLICATIONS[c] for c in columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value only: NaN in floating columns becomes null."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floating:
        return df
    return df.withColumns({
        c: F.nullif(F.col(c), F.lit(float("nan")).cast(df.schema[c].dataType)) for c in floating
    })


def _files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The CSV files below ``path`` by their header, from one listing.

    The first line of each file is read by a short job, several side by side. Files of
    one header are then one scan. Files without any line have no header and are left out.
    """
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())

    def header(file: str) -> tuple[str, ...]:
        return tuple(spark.read.option("header", True).csv(file).columns)

    with ThreadPool(HEADERS_AT_ONCE) as pool:
        headers = pool.map(header, files)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, columns in zip(files, headers, strict=True):
        if columns:
            groups.setdefault(columns, []).append(file)
    return groups


def read_applications(spark: SparkSession, path: str, fmt: str | None = None,
                      schema: T.StructType = APPLICATIONS) -> DataFrame:
    """Read csv, json or parquet; the format follows the extension unless given.

    Text formats keep unparseable records in ``_corrupt`` instead of failing the job. A
    column that no file has is absent, whatever the format; one that only some files have
    is null in the rows of the others. The files of a folder may have their columns in any order.
    """
    name = re.sub(r"\.(gz|bz2|zst|deflate|snappy|lz4)$", "", path.rstrip("/").lower())
    fmt = fmt or name.rsplit(".", 1)[-1]
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    text = spark.read.schema(with_corrupt).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        df = None
        for header, files in _files_by_header(spark, path).items():
            # CSV columns are matched by position, so the header decides the order.
            ordered = T.StructType(
                [schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in header]
                + [T.StructField(CORRUPT, T.StringType())])
            part = text.schema(ordered).option("header", True).option("enforceSchema", False).csv(files)
            df = part if df is None else df.unionByName(part, allowMissingColumns=True)
        if df is None:
            df = text.csv(path)
        df = df.select(*[c for c in df.columns if c != CORRUPT], CORRUPT)
    elif fmt in ("json", "jsonl", "ndjson"):
        keys = F.json_object_keys("value")
        found = spark.read.text(path).agg(*[
            F.max(F.array_contains(keys, c)).alias(c) for c in schema.names]).first()
        df = text.json(path).select(*[c for c in schema.names if found[c]], CORRUPT)
    elif fmt == "parquet":
        present = spark.read.option("mergeSchema", True).parquet(path).columns
        df = spark.read.schema(T.StructType([f for f in schema if f.name in present])).parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return nan_to_null(df)


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns, files and stored bytes of a file-backed table, in one pass."""
    files = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count("*").alias("n"), F.max("_metadata.file_size").alias("size"))
    return files.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"),
    )
