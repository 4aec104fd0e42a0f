"""Exact top-k inner products by MaxScore over shards of whole-number vectors.

Every component is a term of the query; its postings are the components of a shard's
vectors. In a shard, a term adds at most max(q * largest, q * least) to a score. Terms are
taken by falling spread of that bound: the essential ones are those without which no vector
can reach the query's threshold (its k-th best score so far). Their postings are traversed
for all vectors of the shard; the others are probed term by term only for vectors whose
score so far plus the bounds that are left is still competitive. The threshold starts from
the whole scores of a few vectors of each shard. Each shard gives k vectors per query; these
are merged.

Vectors and queries are packed into blocks; each query block meets each shard once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import text
from riskloom.session import materialize

SHARD = 2048
QUERIES = 256
PROBE = 8
_SAFE = 1 << 24


def whole_numbers(vectors: list[list[float]]) -> np.ndarray:
    """floor(256 * x) of each component, as int64, or as Python ints where those are too
    large to add up; shorter vectors end in zeros."""
    width = max(map(len, vectors))
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[:len(vector)] = vector
    out = np.floor(256 * out)
    if np.abs(out).max(initial=0) < _SAFE:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object)


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``size`` vectors: ids, sizes, components."""
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            rows = batch.slice(low, size)
            vectors = rows.column("vector")
            sizes = np.array(vectors.value_lengths(), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()),
                 pa.array([np.asarray(vectors.flatten(), np.float64).tobytes()], pa.binary())], names=["ids", "sizes", "components"])


def _opened(ids: bytes, sizes: bytes, components: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = np.cumsum(np.frombuffer(sizes, np.int32))[:-1]
    return np.frombuffer(ids, np.int64), np.split(np.frombuffer(components, np.float64), cuts)


def best(query: np.ndarray, own: int, ids: np.ndarray, shard: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the query's k best vectors of a shard; ties to the smaller id."""
    alive = np.flatnonzero(ids != own)
    most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    terms = np.argsort(least - most, kind="stable")
    bound = np.append(np.cumsum(most[terms][::-1])[::-1], 0)  # of the terms from i on
    floor = np.append(np.cumsum(least[terms][::-1])[::-1], 0)
    seeds = np.sort(shard[alive[:: max(1, len(alive) // (8 * k))]] @ query)
    threshold = seeds[-k] if len(seeds) >= k else floor[0]
    # without the essential terms, at their least, no vector reaches the threshold
    at = int(np.argmax(floor[0] - floor + bound < threshold)) or len(terms)
    scores = shard[np.ix_(alive, terms[:at])] @ query[terms[:at]]
    while True:
        keep = scores + bound[at] >= threshold
        alive, scores = alive[keep], scores[keep]
        if at >= len(terms):
            break
        if len(scores) > k:  # the k-th best of the scores that are certain by now
            threshold = max(threshold, np.sort(scores)[-k] + floor[at])
        more = terms[at:at + PROBE]
        scores = scores + shard[np.ix_(alive, more)] @ query[more]
        at += len(more)
    order = sorted(range(len(alive)), key=lambda i: (-scores[i], ids[alive[i]]))[:k] if len(alive) < 64 else np.lexsort((ids[alive], -scores))[:k]
    return alive[order], scores[order]


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    limit = (1 << 63) - 1
    for batch in batches:
        for row in batch.to_pylist():
            ids, vectors = _opened(row["ids"], row["sizes"], row["components"])
            query_ids, queries = _opened(row["q_ids"], row["q_sizes"], row["q_components"])
            whole = whole_numbers([*vectors, *queries])
            shard, asked = whole[:len(ids)], whole[len(ids):]
            low, high = shard.min(0), shard.max(0)
            found: list[tuple[int, int, int]] = []
            for own, query in zip(query_ids.tolist(), asked, strict=True):
                places, scores = best(query, own, ids, shard, low, high, k)
                found += [(own, int(ids[p]), max(-limit, min(limit, int(s)))) for p, s in zip(places, scores, strict=True)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k best other vectors of every query row by integer inner product.

    Takes vec_id and embedding; components are floor(256 * x). ``is_query`` selects the
    query rows. Returns query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Rows without vec_id and vectors that are null or hold null or non-finite components
    take no part. Shorter vectors count as ending in zeros, so an empty vector scores 0.
    Repeated rows of one vec_id with equal vectors count once; a query is never its own
    answer. Scores beyond 64 bits stop at the limits. An empty table gives an empty result.
    """
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & value.isNotNull()).where(finite)
    rows = rows.select("vec_id", value.cast("array<double>").alias("vector"), is_query.alias("asked"))
    repeated = rows.groupBy("vec_id").count().where("count > 1")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["vec_id", "vector"])
    rows = materialize(rows, "vectors")
    blocks = "ids binary, sizes binary, components binary"
    shards = materialize(rows.select("vec_id", "vector").mapInArrow(partial(_packed, size=SHARD), blocks), "shards")
    asked = rows.where("asked").select("vec_id", "vector")
    n = asked.count()
    parts = max(1, -(-n // QUERIES))
    asked = asked.repartition(parts).mapInArrow(partial(_packed, size=QUERIES), blocks)
    asked = asked.toDF("q_ids", "q_sizes", "q_components").withColumn("block", F.monotonically_increasing_id())
    asked = materialize(asked, "queries")
    numbers = asked.select(F.sort_array(F.collect_list("block")).alias("blocks"))  # one number per query block
    spread = shards.withColumn("block", F.explode(numbers.scalar()))
    pairs = spread.join(asked, "block").withColumn("salt", F.xxhash64("ids", "block")).repartition("salt").drop("block", "salt")
    found = pairs.mapInArrow(partial(_searched, k=k), "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
