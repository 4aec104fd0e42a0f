"""Enclosed quantiles and stored drift counts against numpy."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import drift, profiling, ranking

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_only_values_near_the_ranks_are_kept(spark, monkeypatch):
    """Of 300,000 different values less than a hundredth is grouped and ordered."""
    kept, df = {}, session.materialize(spark.range(300_000).select(F.col("id") * 7919 % 300_007 + F.lit(0.5)).toDF("v"), "values")

    def keep(table, name):
        kept[name] = session_materialize(table, name)
        return kept[name]
    session_materialize = session.materialize
    monkeypatch.setattr(session, "materialize", keep)
    found = ranking.column_quantiles(df, ["v"], [0.25, 0.5, 0.75]).first().q
    assert found == pytest.approx(list(np.quantile([i * 7919 % 300_007 + 0.5 for i in range(300_000)], [0.25, 0.5, 0.75])), abs=0)
    assert kept["enclosed"].count() < 3_000


def test_a_sketch_that_misses_is_widened(spark, monkeypatch):
    """Enclosures that do not hold their rank are refused; the result stays exact."""
    honest, margins = ranking._sketched, []

    def off(values, group, probabilities, margin):
        margins.append(margin)
        table = honest(values, group, probabilities, margin)
        return table if margin > 0.01 else table.withColumn("_low", F.col("_high"))
    monkeypatch.setattr(ranking, "_sketched", off)
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranking.quantiles(df, [], PROBABILITIES, "v").first().q == pytest.approx(list(np.quantile(values, PROBABILITIES)))
    assert len(margins) > 1 and margins == sorted(margins)


def test_column_enclosures_that_miss_are_widened(spark, monkeypatch):
    """The same for columns side by side: the summaries are made to answer a rank too high."""
    honest, asked = F.percentile_approx, []

    def off(column, points, accuracy):
        asked.append(points)
        return honest(column, [min(1.0, p + 0.02) for p in points], accuracy)
    monkeypatch.setattr(ranking.F, "percentile_approx", off)
    values = [random.Random(4).gauss(0, 1) for _ in range(400)] + [random.Random(i).gauss(0, 1) for i in range(400)]
    df = spark.createDataFrame([(v, -v) for v in values], "v double, w double")
    found = {r.column: r.q for r in ranking.column_quantiles(df, ["v", "w"], PROBABILITIES).collect()}
    assert found["v"] == pytest.approx(list(np.quantile(values, PROBABILITIES)))
    assert found["w"] == pytest.approx(list(np.quantile([-v for v in values], PROBABILITIES)))
    assert len(asked) > 2


@pytest.mark.parametrize("closed", [True, False])
def test_groups_ties_and_missing_values(spark, closed):
    rng = random.Random(2)
    rows = [(g, rng.choice([1.0, 2.0, 2.0, 7.5, rng.random(), None, float("nan")])) for g in ("a", "b", "b", "c") * 90]
    rows += [("one", 4.0), ("none", None), ("flat", 3.0), ("flat", 3.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r.q for r in ranking.quantiles(df, ["g"], PROBABILITIES, "v", closed).collect()}
    for g in ("a", "b", "c", "one", "flat"):
        present = [v for k, v in rows if k == g and v is not None and not math.isnan(v)]
        assert found[g] == pytest.approx(list(np.quantile(present, PROBABILITIES)))
    assert "none" not in found


def test_extreme_and_empty_columns(spark):
    df = spark.createDataFrame([(1e308, None, 1), (-1e308, None, 2), (0.0, None, 2**53)], "a double, b double, c long")
    found = {r.column: r.q for r in ranking.column_quantiles(df, ["a", "b", "c"], [0.0, 0.5, 1.0]).collect()}
    assert found == {"a": [-1e308, 0.0, 1e308], "c": [1.0, 2.0, float(2**53)]}
    assert ranking.column_quantiles(df.limit(0), ["a", "b"], [0.5]).count() == 0
    assert profiling.box_statistics(df.limit(0), "a", "c").count() == 0


def psi(reference, current, limits):
    bins = lambda values: [sum(int(v > x) for x in limits) for v in values]
    r, c = bins(reference), bins(current)
    total = 0.0
    for b in set(r) | set(c):
        q, p = max(r.count(b) / len(r), 1e-6) if r else 1e-6, max(c.count(b) / len(c), 1e-6) if c else 1e-6
        total += (p - q) * math.log(p / q)
    return total


@pytest.fixture
def series(spark):
    rng = random.Random(3)
    first = date(2024, 1, 1)
    rows = [(first + timedelta(days=rng.randrange(90)), rng.gauss(0, 1), rng.choice([0.0, 1.0, None])) for _ in range(3000)]
    rows = [(d, x + (d - first).days / 60, y) for d, x, y in rows] + [(None, 0.0, 0.0)]
    return rows, session.materialize(spark.createDataFrame(rows, "d date, x double, y double").withColumn("ts", F.col("d").cast("timestamp")), "series")


def test_daily_counts_compare_any_windows(spark, series):
    rows, df = series
    limits = session.materialize(drift.bin_limits(df.where("d < date'2024-01-31'"), ["x", "y"]), "limits")
    path = session.scratch_path(spark, "bins")
    for part in ("d < date'2024-02-10'", "d >= date'2024-02-10' AND x < 0", "d >= date'2024-02-10' AND x >= 0 OR d IS NULL"):
        drift.daily_bins(df.where(part), ["x", "y"], "ts", limits).write.mode("append").parquet(path)
    bins = spark.read.parquet(path)
    assert bins.agg(F.sum("n")).first()[0] == sum(v is not None for r in rows for v in r[1:])
    windows = [(("2024-01-01", "2024-01-10"), ("2024-02-05", "2024-03-01")), (("2024-02-01", "2024-02-01"), ("2024-03-20", "2024-12-31"))]
    for reference, current in windows:
        found = {r.feature: r.psi for r in drift.stability_between(bins, reference, current).collect()}
        for i, feature in ((1, "x"), (2, "y")):
            early = [r[i] for r in rows if r[0] and r[0] < date(2024, 1, 31) and r[i] is not None]
            edges = np.quantile(early, [k / 10 for k in range(1, 10)])
            inside = lambda w: [r[i] for r in rows if r[0] and w[0] <= str(r[0]) <= w[1] and r[i] is not None]
            assert found[feature] == pytest.approx(psi(inside(reference), inside(current), edges), abs=1e-9)


def test_stability_of_rows(spark, series):
    rows, df = series
    found = {r.feature: (r.psi, r.drifted) for r in drift.population_stability(df, ["x", "y"], "ts", "2024-02-15").collect()}
    for i, feature in ((1, "x"), (2, "y")):
        old, new = ([r[i] for r in rows if r[0] and (str(r[0]) < "2024-02-15") == early and r[i] is not None] for early in (True, False))
        expected = psi(old, new, np.quantile(old, [k / 10 for k in range(1, 10)]))
        assert found[feature][0] == pytest.approx(expected) and found[feature][1] == (expected > 0.1)
