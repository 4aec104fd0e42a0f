"""Exact ranks, running totals and quantiles without a single-task sort.

A global window would order the whole input in one task. Here distinct values are
cut into buckets of near-equal size at approximate quantiles, each bucket is ordered
on its own, and the totals of the buckets before it (a thousand rows) are added.
The bucket limits only steer the partitioning; results are exact whatever they are.
Quantiles need no order of all values: sketches enclose the wanted ranks, and only the
values near them are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import session

BUCKETS = 1024
ACCURACY = 20 * BUCKETS
SKETCH = 10_000


def _with_bucket(df: DataFrame, value: str) -> DataFrame:
    """Append ``bucket``: how many of ``_limits`` are not above ``value``.

    A binary search with one projection per step, so that it stays in generated code.
    """
    df = df.withColumn("bucket", F.lit(0))
    step = BUCKETS // 2
    while step:
        limit = F.get("_limits", F.col("bucket") + (step - 1))
        reached = F.coalesce(limit <= F.col(value), F.lit(False))
        df = df.withColumn("bucket", F.col("bucket") + F.when(reached, step).otherwise(0))
        step //= 2
    return df.drop("_limits")


def bucketed(df: DataFrame, group: list[str], order: str, closed: bool = True) -> DataFrame:
    """Append ``bucket``, increasing with ``order`` and balanced by row count per group.

    ``closed`` groups are names fixed by the caller (columns, features, models): one
    limits row each, small enough to broadcast. The limits of groups taken from the
    data are broadcast only if they measure small.
    """
    probabilities = [i / BUCKETS for i in range(1, BUCKETS)]
    limits = F.percentile_approx(order, probabilities, ACCURACY).alias("_limits")
    if group:
        per_group = df.groupBy(*group).agg(limits)
        per_group = F.broadcast(per_group) if closed else session.measured(per_group, "limits")
        located = df.join(per_group, group)
    else:
        located = df.withColumn("_limits", df.agg(limits).scalar())
    return _with_bucket(located, order)


def bucket_offsets(parts: DataFrame, group: list[str], sums: list[str]) -> DataFrame:
    """Per bucket: what lies in it, before it, and in the whole group (<= 1024 rows a group)."""
    sizes = parts.groupBy(*group, "bucket").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    columns = []
    for c in sums:
        columns += [
            F.col(f"_{c}").alias(f"{c}_inside"),
            F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"{c}_offset"),
            F.sum(f"_{c}").over(whole).alias(f"{c}_total"),
        ]
    return sizes.select(*group, "bucket", *columns)


def _running(parts: DataFrame, offsets: DataFrame, group: list[str], order: str,
             sums: list[str]) -> DataFrame:
    inside = Window.partitionBy(*group, "bucket").orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(offsets, [*group, "bucket"])
    return joined.withColumns({
        f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}_offset")
        for c in sums
    }).drop("bucket", *[f"{c}_{x}" for c in sums for x in ("inside", "offset")])


def cumulative(df: DataFrame, group: list[str], order: str, sums: list[str],
               closed: bool = True) -> DataFrame:
    """Append ``<c>_before`` and ``<c>_total`` for each summed column.

    Rows must be unique per (group, order): aggregate first, so that equal values,
    however many copies they have, are one row. Pass a written table: it is read three
    times, for the limits, the bucket sizes and the rows.
    """
    parts = bucketed(df, group, order, closed)
    return _running(parts, bucket_offsets(parts, group, sums), group, order, sums)


def _sketched(values: DataFrame, group: list[str], probabilities: list[float], margin: float) -> DataFrame:
    """Per group its rows and, for each wanted rank, values that should enclose it.

    The quantile summaries are merged from all tasks; a value's rank in them is off by
    a ``1/SKETCH``-th of the rows, so twice that on both sides encloses.
    """
    points = sorted({q for p in probabilities for q in (p - margin, p + margin) if 0 < q < 1})
    near = F.percentile_approx("value", points or [0.5], SKETCH)
    per_group = values.groupBy(*group).agg(
        F.count("*").alias("_total"), F.min("value").alias("_min"), F.max("value").alias("_max"), near.alias("_near"))
    low = [F.col("_min") if p - margin <= 0 else F.col("_near")[points.index(p - margin)] for p in probabilities]
    high = [F.col("_max") if p + margin >= 1 else F.col("_near")[points.index(p + margin)] for p in probabilities]
    return per_group.select(*group, "_total", F.array(*low).alias("_low"), F.array(*high).alias("_high"))


def quantiles(df: DataFrame, group: list[str], probabilities: list[float], value: str = "value",
              closed: bool = True) -> DataFrame:
    """Exact linear-interpolated quantiles per group: (group, q) in the order of ``probabilities``.

    A mergeable sketch encloses each wanted rank between two values. A second scan
    counts the rows below them and keeps only the values between; just those are shuffled,
    ordered and searched for the rank. Should a sketch miss a rank, the enclosure
    is widened until it does not, at last to the whole range. ``df`` is read for the
    sketch and twice for the scan; pass a written table. Missing values (null, NaN) do
    not count; groups without values have no row. ``closed`` is that of ``bucketed``.
    """
    if not probabilities:
        raise ValueError("no quantile is asked for")
    values = df.select(*group, F.col(value).cast("double").alias("value")) \
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    margin = 2 / SKETCH
    while True:
        found = _enclosed(values, group, probabilities, margin, closed)
        if found is not None:
            return found
        margin *= 16


def _counted_before(inside: DataFrame, key: list[str]) -> DataFrame:
    """Append ``n_before``: the rows of smaller values. An enclosure holds a 2,500th of its group's rows."""
    smaller = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return inside.withColumn("n_before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))


def _enclosed(values: DataFrame, group: list[str], probabilities: list[float], margin: float,
              closed: bool) -> DataFrame | None:
    """Quantiles by enclosures of ``margin``; None if one does not hold its rank."""
    place = F.broadcast if closed else lambda t: t
    each = range(len(probabilities))
    sketch = session.measured(_sketched(values, group, probabilities, margin), "sketch")
    located = values.join(place(sketch), group) if group else values.crossJoin(F.broadcast(sketch))
    between = [F.col("value").between(F.col("_low")[i], F.col("_high")[i]) for i in each]
    any_between = between[0]
    for condition in between[1:]:
        any_between = any_between | condition
    inside = located.filter(any_between).select(*group, "value", F.explode(F.array(*[
        F.when(condition, F.lit(i)) for i, condition in enumerate(between)])).alias("_i")).filter("_i IS NOT NULL")
    inside = session.materialize(inside.groupBy(*group, "_i", "value").agg(F.count("*").alias("n")), "enclosed")
    below = located.groupBy(*group).agg(
        F.any_value("_total").alias("_total"),
        F.array(*[F.count_if(F.col("value") < F.col("_low")[i]) for i in each]).alias("_below"))
    last = F.col("_total") - 1
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), F.col("_below")[i].alias("_below"), (last * F.lit(float(p))).alias("_position"))
                      for i, p in enumerate(probabilities)])
    ranks = below.select(*group, F.inline(ranks)).withColumns(
        {"_first": F.floor("_position") - F.col("_below"), "_second": F.ceil("_position") - F.col("_below")})
    key = [*group, "_i"]
    sizes = inside.groupBy(*key).agg(F.sum("n").alias("_inside"))
    ranks = session.measured(ranks.join(sizes, key, "left"), "ranks")
    held = (F.col("_first") >= 0) & (F.col("_second") < F.col("_inside"))
    if not ranks.filter(~F.coalesce(held, F.lit(False))).isEmpty():
        return None
    ordered = _counted_before(inside, key).join(place(ranks), key)
    at = lambda rank: F.max(F.when((F.col("n_before") <= F.col(rank)) & (F.col(rank) < F.col("n_before") + F.col("n")), F.col("value")))
    picked = ordered.groupBy(*key).agg(
        at("_first").alias("_lower"), at("_second").alias("_upper"), F.any_value("_position").alias("_position"))
    interpolated = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * (F.col("_position") - F.floor("_position"))
    return picked.groupBy(*group).agg(F.array(*[F.max(F.when(F.col("_i") == i, interpolated)) for i in each]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                     exact: bool = True) -> DataFrame:
    """(column, q) for numeric columns; ``exact=False`` is one pass of sketches.

    The exact form is that of ``quantiles`` with the columns side by side: three scans of
    ``df``, each without a join. Columns without values have no row. The driver holds two
    numbers for each column and probability.
    """
    if not exact:
        row = df.agg(*[
            F.percentile_approx(F.col(c).cast("double"), probabilities, 10000).alias(c)
            for c in columns])
        return row.unpivot([], columns, "column", "q")
    values = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    margin, wanted = 2 / SKETCH, None
    while wanted is None:
        wanted, inside = _enclosed_columns(values, columns, probabilities, margin)
        margin *= 16
    ranks = F.broadcast(df.sparkSession.createDataFrame(
        wanted, "_k int, column string, _i int, _first long, _second long, _part double"))
    found = _counted_before(inside, ["_k"]).join(ranks, "_k").groupBy("column", "_i").agg(*[
        F.max(F.when((F.col("n_before") <= F.col(r)) & (F.col(r) < F.col("n_before") + F.col("n")), F.col("value"))).alias(r)
        for r in ("_first", "_second")], F.any_value("_part").alias("_part"))
    between = F.col("_first") + (F.col("_second") - F.col("_first")) * F.col("_part")
    return found.groupBy("column").agg(F.array(*[F.max(F.when(F.col("_i") == i, between)) for i in range(len(probabilities))]).alias("q"))


def _enclosed_columns(values: DataFrame, columns: list[str], probabilities: list[float],
                      margin: float) -> tuple[list[tuple] | None, DataFrame]:
    """Ranks within enclosures and the counted values of those; None if one misses its rank."""
    points = sorted({q for p in probabilities for q in (p - margin, p + margin) if 0 < q < 1})
    row = values.agg(*[F.struct(F.count(c), F.min(c), F.max(c), F.percentile_approx(c, points or [0.5], SKETCH)) for c in columns]).first()
    enclosures, ranks = [], []
    for c, (total, least, most, near) in zip(columns, row, strict=True):
        if not total:
            continue
        spans = sorted((least if p - margin <= 0 else near[points.index(p - margin)],
                        most if p + margin >= 1 else near[points.index(p + margin)], i) for i, p in enumerate(probabilities))
        for low, high, i in spans:
            if enclosures and enclosures[-1][0] == c and low <= enclosures[-1][2]:
                enclosures[-1][2] = max(high, enclosures[-1][2])
            else:
                enclosures.append([c, low, high])
            ranks.append((len(enclosures) - 1, c, i, (total - 1) * float(probabilities[i])))
    cells, any_inside = [], F.lit(False)
    for c in {e[0]: None for e in enclosures}:
        cell = F
        for k, (column, low, high) in enumerate(enclosures):
            if column == c:
                inside = F.col(c).between(F.lit(low), F.lit(high))
                cell, any_inside = cell.when(inside, F.struct(F.lit(k).alias("_k"), F.col(c).alias("value"))), any_inside | inside
        cells.append(cell)
    empty = values.sparkSession.createDataFrame([], "_k int, value double, n long")
    if not cells:
        return [], empty
    kept = values.filter(any_inside).select(F.inline(F.array(*cells))).filter("value IS NOT NULL")
    kept = session.materialize(kept.groupBy("_k", "value").agg(F.count("*").alias("n")), "enclosed")
    below = values.agg(*[F.count_if(F.col(c) < F.lit(low)) for c, low, _ in enclosures]).first()
    sizes = dict(map(tuple, kept.groupBy("_k").agg(F.sum("n")).collect()))
    wanted = []
    for k, c, i, position in ranks:
        first, second = math.floor(position) - below[k], math.ceil(position) - below[k]
        if first < 0 or second >= sizes.get(k, 0):
            return None, empty
        wanted.append((k, c, i, first, second, position - math.floor(position)))
    return wanted, kept


def quantile_map(quantile_rows: DataFrame) -> Column:
    """Scalar subquery: column name -> quantile array, one entry per profiled column."""
    return quantile_rows.agg(
        F.map_from_entries(F.collect_list(F.struct("column", "q")))).scalar()


def stable_sample(df: DataFrame, n: int, id_column: str) -> DataFrame:
    """``n`` rows in the order of a hash of their id: repeatable, no full sort."""
    return df.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(n)
