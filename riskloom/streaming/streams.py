"""Streams over the base tables: scoring, activity counts, KPI alerts, de-duplication.

Sources are files; each query drains what is there (``availableNow``) into a parquet
table below the shared scratch folder, with its checkpoint beside it, so a restarted
query goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskloom import session
from riskloom.operators import kpi, scoring
from riskloom.sources import applications as views


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A base table as a stream; the pattern matches a file or a folder of files."""
    schema = views.read_table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def orders_with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with the ratios of their lines, from two streams, whichever comes first.

    The state is one row per order: its columns and four sums. A micro-batch reads and
    emits only orders that it brings or whose lines it brings, so no table of lines is
    scanned again; a late line gives its order anew. For ``update`` mode; the newest row of
    an order is the right one. Lines wait in the state until their order comes. An order
    that is sent twice counts once, with the greatest of its versions.
    """
    rest = [c for c in orders.columns if c != "o_orderkey"]
    line_columns = ["l_orderkey", "l_discount", "l_quantity", "l_returnflag"]
    none = {c: F.lit(None).cast(lines.schema[c].dataType) for c in line_columns}
    left = orders.select("o_orderkey", F.struct(*rest).alias("o"), *[v.alias(c) for c, v in none.items()])
    order_type = left.schema["o"].dataType
    right = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(None).cast(order_type).alias("o"), *line_columns)
    sums = left.union(right).groupBy("o_orderkey").agg(
        F.max("o").alias("o"), *[v.alias(k) for k, v in views.line_sums().items()])
    return sums.filter("o IS NOT NULL").select(
        "o_orderkey", "o.*", "line_count", "returned", *[v.alias(k) for k, v in views.ratios_of_sums().items()])


def application_stream(spark: SparkSession, sf_dir: str, columns: list[str],
                       files_per_batch: int | None = None) -> DataFrame:
    """Applications from streams of orders and lines, joined to the static customer table.

    With columns of lines it is for ``update`` mode, see ``orders_with_lines``. Columns that
    look back over a customer's other orders are not available on a stream.
    """
    if set(columns) & views.HISTORY_COLUMNS or "default_risk" in columns:
        raise ValueError("history columns must be precomputed in the stream input")
    orders = stream_table(spark, sf_dir, "orders", files_per_batch)
    if set(columns) & views.LINE_COLUMNS:
        orders = orders_with_lines(orders, stream_table(spark, sf_dir, "lineitem", files_per_batch))
    return views.derive_applications(
        orders,
        views.read_table(spark, sf_dir, "customer"),
        views.read_table(spark, sf_dir, "nation"),
        views.read_table(spark, sf_dir, "region"),
        None, None, columns)


def audit_stream(spark: SparkSession, sf_dir: str, delay: str = "1 day") -> DataFrame:
    return views.audit_rows(stream_table(spark, sf_dir, "events")) \
        .withWatermark("timestamp", delay)


def drain_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream to the end of its input and read the sink."""
    spark = stream.sparkSession
    path = session.scratch_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/data") \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def drain_complete(stream: DataFrame, name: str, then=None) -> DataFrame:
    """Run an aggregating stream in complete mode; the last batch holds the whole result.

    Each batch writes its own folder and overwrites it when it is retried. ``then``
    transforms the batch result before it is written.
    """
    spark = stream.sparkSession
    path = session.scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        result = then(batch) if then else batch
        result.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = stream.writeStream.outputMode("complete").foreachBatch(store) \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(f"{path}/data")
    return written.filter(F.col("batch") == written.agg(F.max("batch")).scalar()).drop("batch")


def drain_latest(stream: DataFrame, key: str, name: str, path: str | None = None) -> DataFrame:
    """Run a stream in update mode to the end of its input; the newest row of each key.

    Each batch writes the rows that it changed to a folder of its own and overwrites it
    when it is retried. ``path`` names the place of a stream that goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or session.scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(store) \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c != key]
    changes = spark.read.schema(T.StructType(stream.schema.fields + [T.StructField("batch", T.IntegerType())])).parquet(f"{path}/data")
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(key, "r.*")


def score_stream(applications: DataFrame) -> DataFrame:
    """The batch scorecard on a stream: the same expressions, no state."""
    return scoring.score(applications)


def activity_counts(audit: DataFrame, width: str = "1 day") -> DataFrame:
    """Events per tumbling window and activity."""
    return audit.groupBy(F.window("timestamp", width).alias("w"), "activity") \
        .agg(F.count("*").alias("n")) \
        .select(F.col("w.start").alias("window_start"), "activity", "n")


def approval_rates(scored: DataFrame, width: str = "7 days", delay: str = "30 days") -> DataFrame:
    """Approval rate per tumbling window."""
    return scored.withWatermark("application_ts", delay) \
        .groupBy(F.window("application_ts", width).alias("w")) \
        .agg(F.count("*").alias("scored"),
             F.avg((F.col("decision") == "APPROVED").cast("double")).alias("approval_rate")) \
        .select(F.col("w.start").alias("window_start"), "scored", "approval_rate")


def rate_alerts(rates: DataFrame) -> DataFrame:
    """Alerts of one batch of window rates against the KPI thresholds."""
    rows = rates.select("window_start", F.lit("approval_rate").alias("kpi"),
                        F.col("approval_rate").alias("value"))
    return kpi.alerts_of(rows, "window_start")


def store_alerts(rates: DataFrame, path: str) -> None:
    """Write the alerts of closed windows, one folder a window.

    The folder is overwritten as a whole, so a batch that is retried leaves one copy.
    """
    alerts = rate_alerts(rates).withColumn("window_second", F.unix_timestamp("window_start"))
    alerts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("window_second").parquet(f"{path}/data")


def closed_alerts(decisions: DataFrame, name: str, width: str = "7 days", delay: str = "30 days",
                  path: str | None = None) -> DataFrame:
    """Alerts of the windows that the watermark has closed, from a stream of scored rows.

    Append mode: a window is judged once, when no row of it can come any more, and its
    state is dropped. Rows behind the watermark are left out. ``path`` names the place of a
    stream that goes on where it stopped.
    """
    spark = decisions.sparkSession
    path = path or session.scratch_path(spark, name)
    none = spark.createDataFrame([], "window_start timestamp, scored long, approval_rate double")
    store_alerts(none, path)  # so that the folder is there without any alert, too
    rates = approval_rates(decisions, width, delay)
    query = rates.writeStream.outputMode("append").foreachBatch(lambda batch, _: store_alerts(batch, path)) \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    told = rate_alerts(none)
    return spark.read.schema(told.schema).parquet(f"{path}/data").select(*told.columns)


def open_alerts(decisions: DataFrame, width: str = "7 days", delay: str = "30 days") -> DataFrame:
    """Alerts, so far, of the windows that the watermark has not closed: a batch over the newest rows."""
    limit = decisions.agg((F.max("application_ts") - F.expr(f"INTERVAL {delay}")).alias("t")).scalar()
    rates = decisions.groupBy(F.window("application_ts", width).alias("w")).agg(
        F.count("*").alias("scored"), F.avg((F.col("decision") == "APPROVED").cast("double")).alias("approval_rate"))
    return rate_alerts(rates.filter(F.col("w.end") > limit).select(F.col("w.start").alias("window_start"), "scored", "approval_rate"))


def without_duplicates(audit: DataFrame, keys: list[str]) -> DataFrame:
    """First submission per key; state is dropped once the watermark passes it."""
    return audit.dropDuplicatesWithinWatermark(keys)
