import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF
from riskloom import policy, session
from riskloom.operators import scoring, sinks, validation
from riskloom.sources import applications as views, readers
from riskloom.streaming import streams


def folder():
    return tempfile.mkdtemp(prefix="run-")


def test_csv_keeps_bad_records_and_follows_the_header(spark):
    path = folder()
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write("customer_id,credit_score,annual_income,note\nC1,700,50000.5,x\nC2,oops,1,y\nC3,,NaN,z\n")
    df = readers.read_applications(spark, path, "csv").cache()
    rows = {r.customer_id: r for r in df.collect()}
    assert rows["C1"].credit_score == 700 and rows["C1"].annual_income == 50000.5
    assert rows["C2"].credit_score is None and rows["C2"]._corrupt is not None
    assert rows["C3"].credit_score is None and rows["C3"].annual_income is None
    assert rows["C1"].note == "x"
    assert validation.missing_columns(df) == ["loan_amount", "employment_length", "debt_to_income",
                                              "credit_utilization"]


def test_formats_round_trip(spark):
    template = policy.sample_template(spark)
    schema = readers.schema_of(template.columns)
    expected = sorted(tuple(r) for r in template.collect())
    for fmt, write in [("csv", sinks.write_csv), ("json", sinks.write_json),
                       ("parquet", lambda df, p: df.write.parquet(p))]:
        path = session.scratch_path(spark, "template") + "." + fmt
        write(template, path)
        back = readers.read_applications(spark, path, schema=schema).select(*template.columns)
        assert sorted(tuple(r) for r in back.collect()) == expected
    with pytest.raises(ValueError):
        readers.read_applications(spark, "/tmp/x.xlsx")


def test_dataset_info(spark):
    path = f"{SF}/lineitem.parquet"
    row = readers.dataset_info(spark.read.parquet(path)).first()
    assert (row.n_rows, row.n_columns, row.n_files) == (6000, 11, 1)
    assert row.n_bytes == os.path.getsize(path)


def test_only_needed_tables_are_read(spark):
    def plan(*columns):
        return views.applications(spark, SF, list(columns))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan("application_id", "credit_score")
    assert "Window" not in plan("application_id", "debt_to_income")
    assert "r_name" in plan("ethnicity") and "r_name" not in plan("marital_status")


def test_history_of_one_hot_customer(spark):
    """A third of all orders belong to one customer; compared with a plain count."""
    orders = spark.range(3000).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 31 % 700).cast("int"))
        .cast("timestamp_ntz").alias("o_orderdate"))
    got = {(r.o_custkey, r.day_no): r.inquiries_6mths for r in views.account_history(orders).collect()}
    rows = [(r.o_custkey, r.d) for r in orders.select(
        "o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("d")).collect()]
    for customer, day in rows[:300]:
        expected = sum(1 for c, d in rows if c == customer and day - 180 < d <= day) - 1
        assert got[customer, day] == expected


def test_assessment_document(spark, scoring_rows):
    scored = scoring.score(scoring_rows([(1, 720, None, 0.30, 5.0, 25000.0, 0.25)]))
    document = json.loads(scoring.assessment_documents(scored, "2001-01-01").first().document)
    assert document["risk_score"] is None and document["customer_data"]["annual_income"] is None
    assert list(document["feature_contributions"]) == policy.SCORE_LABELS
    assert document["analysis_version"] == "2.0.0"


def test_decision_log_prunes_months(spark):
    from riskloom.operators import audit
    df = scoring.score(views.applications(spark, SF, [*views.SCORING_COLUMNS, "application_ts", "customer_id"]))
    path = sinks.write_decision_log(audit.decision_log(df), session.scratch_path(spark, "log"))
    log = spark.read.parquet(path)
    assert log.count() == 1500
    text = log.filter(F.col("month") == "1999-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in text


def test_late_rows_are_dropped(spark):
    """The third file holds a row older than the watermark and one inside it.

    A batch drops rows behind the watermark that the batch before it ran with.
    """
    path = folder()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"

    def add(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double") \
            .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(path)

    audit = lambda: views.audit_rows(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)).withWatermark("timestamp", "1 day")
    add([(1, "2024-01-10 01:00:00", 1, "click", 1.0), (2, "2024-01-10 02:00:00", 1, "click", 1.0)])
    add([(7, "2024-01-10 03:00:00", 1, "click", 1.0)])
    add([(3, "2024-01-01 00:00:00", 1, "click", 1.0), (4, "2024-01-09 23:00:00", 1, "click", 1.0)])
    add([(5, "2024-01-20 00:00:00", 1, "click", 1.0)])
    add([(6, "2024-01-20 00:00:01", 1, "click", 1.0)])
    rows = streams.drain_append(streams.activity_counts(audit()), "late").collect()
    assert {(str(r.window_start), r.n) for r in rows} == {("2024-01-10 00:00:00", 3), ("2024-01-09 00:00:00", 1)}


def test_stream_refuses_history_columns(spark):
    with pytest.raises(ValueError):
        streams.application_stream(spark, SF, ["inquiries_6mths"])


def test_hot_customer_join_is_split(spark):
    """A third of all orders belong to one customer; adaptive execution splits that partition."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        read = lambda name: views.read_table(spark, SF, name)
        orders = spark.range(0, 300000, 1, 8).select(
            F.col("id").alias("o_orderkey"),
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 150).alias("o_custkey"),
            F.lit("O").alias("o_orderstatus"), F.rand(1).alias("o_totalprice"),
            F.lit("2000-01-01").cast("timestamp_ntz").alias("o_orderdate"),
            F.lit("1-URGENT").alias("o_orderpriority"))
        df = views.derive_applications(
            orders, read("customer"), read("nation"), read("region"), read("lineitem"), None,
            views.SCORING_COLUMNS)
        assert len(df.collect()) == 300000
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_csv_files_of_unlike_headers(spark):
    """Two orders, a file with fewer and one with more columns, a corrupt record, an empty file."""
    path = folder()
    texts = {
        "a": "customer_id,annual_income,loan_amount\nC1,60000,2000\nC2,not a number,1\n",
        "b": "customer_id,loan_amount,annual_income\nC3,3000,70000\n",
        "c": "loan_amount,customer_id\n4000,C4\n",
        "d": "note,customer_id,annual_income,loan_amount\nhello,C5,80000,5000\n",
        "e": "customer_id,loan_amount,annual_income\nC6,6000,90000\n",
        "f": "",
    }
    for name, text in texts.items():
        with open(os.path.join(path, f"{name}.csv"), "w") as f:
            f.write(text)
    df = readers.read_applications(spark, path, "csv")
    found = {r.customer_id: (r.annual_income, r.loan_amount, r.note) for r in df.collect()}
    assert found == {"C1": (60000.0, 2000.0, None), "C2": (None, 1.0, None), "C3": (70000.0, 3000.0, None), "C4": (None, 4000.0, None),
                     "C5": (80000.0, 5000.0, "hello"), "C6": (90000.0, 6000.0, None)}
    assert [r.customer_id for r in df.collect() if r._corrupt is not None] == ["C2"]
    assert len(readers._files_by_header(spark, path)) == 4


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "csv.gz"])
def test_missing_columns_are_seen_in_every_format(spark, fmt):
    path = f"{folder()}/upload.{fmt}"
    rows = spark.createDataFrame([("C1", 50000.0), ("C2", None)], "customer_id string, annual_income double")
    writer = rows.coalesce(1).write.option("header", True)
    kind = fmt.split(".")[0]
    (writer.option("compression", "gzip") if fmt.endswith("gz") else writer).format(kind).save(path)
    found = readers.read_applications(spark, path)
    assert found.count() == 2
    assert validation.missing_columns(found) == ["credit_score", "loan_amount", "employment_length", "debt_to_income",
                                                 "credit_utilization"]
