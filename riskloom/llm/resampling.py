"""Importance resampling of documents towards a target text, without replacement.

A document's features are its runs of one to ``orders`` consecutive words, hashed into buckets. The
gain of a bucket is the log ratio of its smoothed shares in the target and in the documents;
a document weighs the sum of its features' gains, looked up in one array. With Gumbel
noise that is fixed by the document's id, the highest scores are a sample by weight.

The draw is by exact rank, found by parallel sorting by regular sampling: each task
sorts its run and gives keys at regular distances; the sorted keys of all runs give
regular splitters; rows move to the segment between two splitters, and each segment is
ordered on its own. Ranks are places within a segment plus the rows of the segments before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import text
from riskloom.session import materialize, parallelism

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Keys that a run gives at most; no segment then exceeds an even share by more than 1/SAMPLES of all rows.
SAMPLES = 512
_SCALE = 1000
_LONG = 64
_ONES = 0xFFFFFFFF


def _word_bytes() -> np.ndarray:
    out = np.ones(256, bool)
    out[:128] = False
    for low, high in ((48, 58), (65, 91), (97, 123)):
        out[low:high] = True
    return out


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_IN_WORD = _word_bytes()
_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word."""
    inside = _IN_WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    starts[first], ends[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _extended(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksum states after the bytes of each span, all but long spans advancing together a byte at a time."""
    out, lengths = state.copy(), ends - starts
    for i in np.flatnonzero(lengths > _LONG).tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]], int(state[i]) ^ _ONES) ^ _ONES
    rows = np.argsort(-np.where(lengths > _LONG, 0, lengths), kind="stable")
    rows = rows[:np.count_nonzero(lengths <= _LONG)]
    at, falling, run = starts[rows], -lengths[rows], out[rows]
    for i in range(int(-falling[0]) if len(rows) else 0):
        left = int(np.searchsorted(falling, -i, "left"))
        run[:left] = _CRC[(run[:left] ^ data[at[:left] + i]) & 255] ^ (run[:left] >> 8)
    out[rows] = run
    return out


def features(data: np.ndarray, offsets: np.ndarray, orders: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of each run of 1 to ``orders`` words in order, and the first run of each document."""
    data = _LOWER[data]
    starts, ends, first = _words(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    state = np.full(len(starts), _ONES, np.uint32)
    for n in range(orders):
        state = state[:max(0, len(starts) - n)]
        if n:
            state = _CRC[(state ^ 32) & 255] ^ (state >> 8)
        state = _extended(state, data, starts[n:], ends[n:])
        whole = owner[:len(state)] == owner[n:]
        kept = owner[:len(state)][whole]
        yield (state[whole] ^ np.uint32(_ONES)).astype(np.int64) % buckets, np.searchsorted(kept, np.arange(len(offsets)))


def _counted(batches: Iterator[pa.RecordBatch], orders: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Features of all texts of a task, per bucket."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, data, offsets in text.slices(batch.column("text")):
            for bucket, _ in features(data, offsets, orders, buckets):
                total += np.bincount(bucket, minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, orders: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; a task sends at most one row a bucket."""
    rows = texts.select("text").mapInArrow(partial(_counted, orders=orders, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio of smoothed shares) of each bucket."""
    buckets = len(documents)
    total, wanted = float(documents.sum()), float(target.sum())
    ratios = ((target + 1.0) * (total + buckets)) / ((documents + 1.0) * (wanted + buckets))
    return np.array([math.floor(_SCALE * math.log(r)) for r in ratios.tolist()], np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray, orders: int) -> Iterator[pa.RecordBatch]:
    """Words, features and weight of each document."""
    for batch in batches:
        n_words, count, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for low, high, data, offsets in text.slices(batch.column("text")):
            for n, (bucket, first) in enumerate(features(data, offsets, orders, len(gain))):
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                weight[low:high] += sums[first[1:]] - sums[first[:-1]]
                count[low:high] += np.diff(first)
                if not n:
                    n_words[low:high] = np.diff(first)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(count), pa.array(weight)],
                                         names=["doc_id", "n_words", "n_features", "weight"])


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(1000 * Gumbel noise) that is fixed by ``key``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-float(_SCALE) * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs``, by texts of ``target``."""
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    rows = docs.select("doc_id", "text").mapInArrow(partial(_weighed, gain=gain, orders=orders), "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _segment(splitters: Column, steps: list[int], key: Column) -> Column:
    """How many of the sorted ``splitters`` are not above ``key``, by binary search with falling steps."""
    def further(found: Column, step: Column) -> Column:
        reached = F.get(splitters, found + step - 1) <= key
        return found + F.when(F.coalesce(reached, F.lit(False)), step).otherwise(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def ranked(rows: DataFrame, order: list[Column], segments: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """Append ``rank``: 1, 2, 3, ... in ascending ``order`` of integer keys without nulls.

    Equal keys get different ranks in the order in which the rows were written. The
    driver gets ``samples`` keys of each of ``segments`` runs, whatever the number of rows
    (their default is the session's parallelism), and one count a segment.
    """
    spark = rows.sparkSession
    segments = segments or parallelism(spark)
    keys = [f"_k{i}" for i in range(len(order))]
    runs = rows.withColumns(dict(zip(keys, [c.cast("long") for c in order], strict=True))).repartition(segments)
    runs = runs.sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    runs = materialize(runs, "sorted_runs").withColumn("_run", F.shiftright("_row", 33)).withColumn("_at", F.col("_row").bitwiseAND((1 << 33) - 1))
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / samples))
    regular = runs.join(F.broadcast(sizes), "_run").where(F.col("_at") % step == 0).select(*keys, "_row")
    taken = sorted(map(tuple, regular.collect()))
    splitters = [taken[len(taken) * i // segments] for i in range(1, segments)] if len(taken) >= segments else taken[1:]
    fields = ",".join(f"k{i}:bigint" for i in range(len(keys) + 1))
    limits = spark.createDataFrame([(splitters,)], f"s array<struct<{fields}>>").select("s").scalar()
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*keys, "_row"])])
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))] or [1]
    runs = runs.withColumn("_splitters", limits).withColumn("_segment", _segment(F.col("_splitters"), steps, key)).drop("_splitters")
    runs = materialize(runs, "segments")
    counts = dict(map(tuple, runs.groupBy("_segment").agg(F.count("*")).collect()))
    before, total = [], 0
    for segment in sorted(counts):
        before.append((segment, total))
        total += counts[segment]
    starts = F.broadcast(spark.createDataFrame(before, "_segment int, _before long"))
    inside = Window.partitionBy("_segment").orderBy(*keys, "_row")
    placed = runs.withColumn("_place", F.row_number().over(inside)).join(starts, "_segment")
    return placed.withColumn("rank", F.col("_before") + F.col("_place")).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = 1,
             buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words towards ``target``.

    Takes doc_id and text of ``docs`` and text of ``target``; other columns are ignored. Returns a
    row per input row: doc_id, n_features, weight, score, rank (from 1; null if not drawn).
    Null and empty texts have no features, weigh 0 and are never drawn while ``least_words`` is
    positive. Ties go to the smaller doc_id, null last; then to fewer features; rows equal in all
    are drawn in any order, which shows in no column. Empty tables give no rows; without
    target texts all buckets share one gain of the target's smoothing.
    """
    rows = materialize(scored(docs, target, orders, buckets, seed), "resampling_scores")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    order = [-F.col("score"), F.when(F.col("doc_id").isNull(), 1).otherwise(0), F.coalesce("doc_id", F.lit(0)), F.col("n_features")]
    first = ranked(rows.where(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
