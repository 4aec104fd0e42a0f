"""Streams over several micro-batches: late lines, closed windows, retried batches."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF
from riskloom import session
from riskloom.operators import scoring
from riskloom.sources import applications as views
from riskloom.streaming import streams


def batch_scores(spark, folder):
    return {r.application_id: r.risk_score for r in scoring.score(views.applications(spark, folder, views.SCORING_COLUMNS)).collect()}


def put(df, folder, name, age):
    """Append one file, whose time decides when the stream takes it."""
    path = f"{folder}/{name}.parquet"
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    df.coalesce(1).write.mode("append").parquet(path)
    for file in set(os.listdir(path)) - before:
        os.utime(f"{path}/{file}", (1_700_000_000 + age, 1_700_000_000 + age))


@pytest.fixture
def folder(spark):
    root = session.scratch_path(spark, "stream-input").removeprefix("file:")
    os.makedirs(root)
    for name in ("customer", "nation", "region"):
        put(views.read_table(spark, SF, name), root, name, 0)
    return root


def test_lines_may_come_before_with_or_after_their_order(spark, folder):
    orders = views.read_table(spark, SF, "orders").where("o_orderkey % 20 = 3")
    keys = orders.select("o_orderkey")
    lines = views.read_table(spark, SF, "lineitem").join(keys, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    for i in range(3):
        put(orders.where(F.col("o_orderkey") % 3 == i), folder, "orders", i)
        put(lines.where((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == i), folder, "lineitem", i)
    path = session.scratch_path(spark, "scores")

    def run():
        stream = streams.score_stream(streams.application_stream(spark, folder, views.SCORING_COLUMNS, files_per_batch=1))
        return streams.drain_latest(stream.select("application_id", "risk_score"), "application_id", "scores", path)
    got = {r.application_id: r.risk_score for r in run().collect()}
    assert got == batch_scores(spark, folder) and len(got) == 75
    changes = spark.read.parquet(f"{path}/data").groupBy("application_id").agg(F.count("*").alias("n"), F.count_distinct("risk_score").alias("scores"))
    assert changes.where("n > 1 AND scores > 1").count() > 0

    late = lines.where("l_linenumber = 1").withColumn("l_discount", F.lit(0.1)).withColumn("l_linenumber", F.lit(99))
    put(late, folder, "lineitem", 50)
    again = {r.application_id: r.risk_score for r in run().collect()}
    assert again == batch_scores(spark, folder) and again != got
    last = spark.read.parquet(f"{path}/data").agg(F.max("batch")).first()[0]
    touched = spark.read.parquet(f"{path}/data").where(F.col("batch") == last).count()
    assert touched == late.select("l_orderkey").distinct().count() < len(again)


def test_no_micro_batch_scans_the_lines_as_a_table(spark, folder):
    put(views.read_table(spark, SF, "orders"), folder, "orders", 0)
    put(views.read_table(spark, SF, "lineitem"), folder, "lineitem", 0)
    stream = streams.application_stream(spark, folder, views.SCORING_COLUMNS)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("l_orderkey") > 0 and "Relation [l_orderkey" not in plan
    assert "Relation [c_custkey" in plan


def test_orders_without_lines_have_no_score(spark, folder):
    put(views.read_table(spark, SF, "orders").limit(5), folder, "orders", 0)
    put(views.read_table(spark, SF, "lineitem").limit(0), folder, "lineitem", 0)
    stream = streams.score_stream(streams.application_stream(spark, folder, views.SCORING_COLUMNS))
    rows = streams.drain_latest(stream.select("application_id", "risk_score", "decision"), "application_id", "scores").collect()
    assert len(rows) == 5 and {(r.risk_score, r.decision) for r in rows} == {(None, "REJECTED")}


DECISIONS = "application_ts timestamp, decision string"


@pytest.fixture
def decisions(spark):
    """Four files: weeks of day 0, 7, 14 and 70, then rows for a closed and an open window."""
    path = session.scratch_path(spark, "decisions").removeprefix("file:")
    start = datetime(1970, 1, 1) + timedelta(days=7 * 1500)
    rows = lambda day, decisions: [(start + timedelta(days=day, hours=i), d) for i, d in enumerate(decisions)]
    good, bad = "APPROVED", "REJECTED"
    files = [rows(0, [bad, bad, good]), rows(7, [good, good]) + rows(14, [good, bad]), rows(70, [bad]),
             rows(1, [good] * 50) + rows(72, [good])]

    def add(number):
        spark.createDataFrame(files[number], DECISIONS).coalesce(1).write.mode("append").parquet(path)
        for file in os.listdir(path):
            if os.path.getmtime(f"{path}/{file}") > 1_700_001_000:
                os.utime(f"{path}/{file}", (1_700_000_000 + number, 1_700_000_000 + number))
    stream = lambda: spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", 1).parquet(path)
    return path, add, stream, start


def told(df, start):
    return sorted(((r.window_start - start).days, round(r.value, 6), r.level) for r in df.collect())


def test_closed_windows_alert_once(spark, decisions):
    """Windows 0 and 14 alert when day 70 has come; rows of day 1 that come later change nothing."""
    path, add, stream, start = decisions
    for i in range(3):
        add(i)
    sink = session.scratch_path(spark, "alerts").removeprefix("file:")
    run = lambda: streams.closed_alerts(stream(), "alerts", delay="10 days", path=sink)
    expected = [(0, round(1 / 3, 6), "error"), (14, 0.5, "error")]
    assert told(run(), start) == expected
    assert told(run(), start) == expected
    add(3)
    assert told(run(), start) == expected
    open_now = streams.open_alerts(spark.read.schema(DECISIONS).parquet(path), delay="10 days")
    assert told(open_now, start) == [(70, 0.5, "error")]


def test_a_retried_batch_leaves_one_copy(spark, decisions):
    """The last batches are run again, as after a loss between writing and committing."""
    _, add, stream, start = decisions
    for i in range(3):
        add(i)
    sink = session.scratch_path(spark, "alerts").removeprefix("file:")
    run = lambda: streams.closed_alerts(stream(), "alerts", delay="10 days", path=sink)
    before = told(run(), start)
    commits = sorted((f for f in os.listdir(f"{sink}/checkpoint/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{sink}/checkpoint/commits/{name}"):
            os.remove(f"{sink}/checkpoint/commits/{name}")
    assert told(run(), start) == before and len(before) == 2


def test_no_alerts(spark, decisions):
    _, add, stream, _ = decisions
    add(1)
    assert streams.closed_alerts(stream(), "alerts").count() == 0
