"""Pack documents into bins of a fixed number of words by conflict-constrained best fit.

Words of a text are cut into pieces of at most the capacity; full pieces are bins of their
own. The other pieces are packed by falling size: a piece goes to the tightest open bin
that has room for it and holds neither its source nor its duplicate cluster. Open bins are
kept in order of what is left in them, with a bitmap of sources and one of clusters; the
search starts at the first bin with room and goes on to its successors until a compatible
one is found, or else opens a bin.

Pieces are dealt over shards of about SHARD_PIECES in turn of their global order, so that
the sizes, sources and clusters of every shard are alike whatever group is hot. Each shard
is packed by itself; texts are not shuffled for it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import text
from riskloom.llm.tables import with_position
from riskloom.session import materialize

CAPACITY = 2048
SHARD_PIECES = 4096
#: Between the texts of a bin.
SEPARATOR = "\n\n"
_PIECES = "row long, doc_id long, source string, cluster string, piece int, start long, size int"


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each piece (size, source bit or -1, cluster bit or -1), best fit in the given order.

    -1 conflicts with nothing.
    """
    open_bins: list[tuple[int, int]] = []  # (room, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        source_bit, cluster_bit = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & source_bit or clusters[open_bins[at][1]] & cluster_bit):
            at += 1
        if at < len(open_bins):
            room, number = open_bins.pop(at)
        else:
            room, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= source_bit
        clusters[number] |= cluster_bit
        if room > size:
            insort(open_bins, (room - size, number))
        out.append(number)
    return out


def _cut(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for _, _, data, offsets in text.slices(batch.column("text")):
            counts.append(np.diff(text.words(data, offsets)[2]))
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        parts = np.maximum(1, -(-count // capacity))
        owner = np.repeat(np.arange(len(count)), parts)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(capacity, count[owner] - piece * capacity)
        take = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(take) for c in ("row", "doc_id", "source", "cluster")], pa.array(piece.astype(np.int32)),
             pa.array(piece * capacity), pa.array(size.astype(np.int32))], names=["row", "doc_id", "source", "cluster", "piece", "start", "size"])


def _packed(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Pack each shard of rows sorted by shard and falling size."""
    for table in text.runs(batches, "shard"):
        sources, clusters = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        source_bits: dict[str, int] = {}
        seen: dict[str, int] = {}
        for c in clusters:
            if c is not None:
                seen[c] = seen.get(c, 0) + 1
        cluster_bits = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1)}  # a lone piece has no conflict
        rows = [(size, -1 if s is None else source_bits.setdefault(s, len(source_bits)), cluster_bits.get(c, -1))
                for size, s, c in zip(table.column("size").to_pylist(), sources, clusters, strict=True)]
        bins = np.array(pack(rows, capacity), np.int64)
        sizes = np.array([r[0] for r in rows], np.int64)
        fill = np.bincount(bins, sizes).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        upto = np.cumsum(sizes[order]) - sizes[order]
        offset = np.empty(len(bins), np.int64)
        opened = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset[order] = upto - np.maximum.accumulate(np.where(opened, upto, 0))
        shard = table.column("shard").to_numpy()
        names = ["row", "doc_id", "piece", "start", "size"]
        yield pa.RecordBatch.from_arrays(
            [*[table.column(n).combine_chunks() for n in names], pa.array((shard << 32) | bins), pa.array(offset.astype(np.int32)), pa.array(fill[bins].astype(np.int32))],
            names=[*names, "bin_id", "slot", "bin_size"])


def pieces_in_bins(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, spread_sources: bool = True) -> DataFrame:
    """The bin of every piece of every document.

    Takes doc_id, text and source. ``cluster`` names a document's duplicate cluster (by
    default equal texts); a null cluster or source conflicts with nothing. Without
    ``spread_sources`` sources do not conflict. Returns row (digest of document and text),
    doc_id, piece (from 0), start and size in words, bin_id, slot (words before it in the
    bin) and bin_size.

    A null or empty text, or one without words, is one piece of no words, which fits in
    any compatible bin. Repeated rows are documents of one cluster, so they get different
    bins. Equal sizes are packed by doc_id, then text digest. An empty table has no bin.
    """
    cluster = F.md5(F.coalesce(F.col("text"), F.lit(""))) if cluster is None else cluster
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "source", cluster.alias("cluster"), "text")
    pieces = materialize(rows.mapInArrow(partial(_cut, capacity=capacity), _PIECES), "pieces")
    if not spread_sources:
        pieces = pieces.withColumn("source", F.lit(None).cast("string"))
    full = F.col("size") == capacity
    rest = with_position(pieces.where(~full), [F.desc("size"), F.col("doc_id").asc_nulls_last(), F.col("row"), F.col("piece")])
    shards = max(1, -(-rest.count() // SHARD_PIECES))
    rest = rest.withColumn("shard", F.col("position") % shards)
    rest = rest.repartition(shards, "shard").sortWithinPartitions("shard", "position").drop("position")
    schema = "row long, doc_id long, piece int, start long, size int, bin_id long, slot int, bin_size int"
    packed = rest.mapInArrow(partial(_packed, capacity=capacity), schema)
    alone = with_position(pieces.where(full), [F.col("doc_id").asc_nulls_last(), F.col("row"), F.col("piece")])
    alone = alone.select("row", "doc_id", "piece", "start", "size", (-1 - F.col("position")).alias("bin_id"), F.lit(0).alias("slot"), F.col("size").alias("bin_size"))
    return packed.unionByName(alone)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted piece: from its first word up to the next piece's, white space included.

    The first piece begins and the last one ends with the text, so the pieces in order are the text.
    """
    for batch in batches:
        wanted, values = batch.column("wanted").to_pylist(), batch.column("text").to_pylist()
        found = []
        for value, pieces in zip(values, wanted, strict=True):
            raw = np.frombuffer((value or "").encode(), np.uint8)
            starts, _, _ = text.words(raw, np.array([0, len(raw)]))
            data, cuts = raw.tobytes(), [0, *starts[1:].tolist()]
            for p in pieces:
                low, high = p["start"], p["start"] + p["size"]
                found.append((p, data[cuts[low]:cuts[high] if high < len(starts) else len(data)].decode()))
        kinds = {"bin_id": pa.int64(), "slot": pa.int32(), "doc_id": pa.int64(), "piece": pa.int32(), "size": pa.int32()}
        yield pa.RecordBatch.from_arrays([*[pa.array([p[c] for p, _ in found], k) for c, k in kinds.items()], pa.array([t for _, t in found], pa.string())],
                                         names=[*kinds, "text"])


def bins(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, spread_sources: bool = True,
         separator: str = SEPARATOR) -> DataFrame:
    """A row per bin: bin_id, doc_ids and pieces in order, n_words, chars, text.

    ``text`` holds the pieces' texts, byte for byte, with ``separator`` between them; ``chars`` is the
    length of each, so that any piece can be cut out again. Null texts count as empty.
    Repeated rows are told apart: as many bins hold a piece as rows have it.
    """
    placed = materialize(pieces_in_bins(docs, cluster, capacity, spread_sources), "placed")
    wanted = placed.groupBy("row").agg(F.collect_list(F.struct("bin_id", "slot", "doc_id", "piece", "start", "size")).alias("wanted"))
    once = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    repeated = once.groupBy("row").count().where("count > 1")
    copies = once.join(repeated, "row", "left_semi").dropDuplicates(["row"])
    once = once.join(repeated, "row", "left_anti").unionByName(copies)
    schema = "bin_id long, slot int, doc_id long, piece int, size int, text string"
    found = once.join(wanted, "row").select("wanted", "text").mapInArrow(_texts, schema)
    ordered = F.array_sort(F.collect_list(F.struct("slot", "size", "doc_id", "piece", "text")))
    grouped = found.groupBy("bin_id").agg(ordered.alias("p"), F.sum("size").cast("long").alias("n_words"))
    return grouped.select("bin_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), "n_words",
                          F.transform("p.text", F.length).alias("chars"), F.array_join("p.text", separator).alias("text"))
