"""Remove byte strings that occur again anywhere in a table of documents.

A string of ``length`` bytes (a window) is repeated when it also starts elsewhere, in the
same or another document. Exact, in these steps:

1. Windows are routed by content. The gram of a window is the least hash of its strings of
   a quarter of the length; equal windows have equal grams. Neighbouring windows of one
   gram form a run; runs, not windows, are shuffled, combined by (gram, hash of the run).
2. A gram that occurs in one run only has no repeated window. Equal runs repeat in all
   their windows. Only grams with several different runs need their text.
3. One text of each such run is sent to the task of its gram. There a suffix array cut at
   ``length`` bytes is built by prefix doubling; positions break ties, so the predecessor in
   suffix order is the previous smaller position of its matches and the successor the next:
   a longest-previous-factor array of at least ``length`` marks the later copies.
4. A gram with very many different runs (a passage within changing surroundings) is not
   gathered: its windows are counted by their 128-bit hashes, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import text
from riskloom.session import materialize

CHUNK_BYTES = 1 << 20
LONGEST_RUN = 2048
GATHERED_RUNS = 1024
_RUNS = "doc_id long, row long, start int, stop int, gram long, run long, several boolean"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[:size - width], values[width - size:])


def find_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of equal gram: document, first byte, end byte, gram, hash, whether
    the gram starts more than once in the run. Bytes count from the document's start."""
    gram = max(1, length // 4)
    width = length - gram + 1
    if len(data) < length:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    prefix = text.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = text.span_hash(prefix, at, at + gram)
    least = sliding_least(hashes, width)  # of the windows that start at 0 .. len - length
    valid = np.zeros(len(least) + 1, np.int8)
    whole = offsets[1:] - offsets[:-1] >= length
    valid[offsets[:-1][whole]] += 1
    np.subtract.at(valid, offsets[1:][whole] - length + 1, 1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[offsets[:-1][whole]] = True
    starts = np.flatnonzero(new)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    parts = -(-(ends - starts) // LONGEST_RUN)  # long runs of periodic text are cut
    if len(parts) and parts.max() > 1:
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, last = np.repeat(starts, parts) + number * LONGEST_RUN, np.repeat(ends, parts)
        starts, ends = first, np.minimum(first + LONGEST_RUN, last)
    value = least[starts]
    stops = ends - 1 + length
    anchor = np.flatnonzero(hashes[:len(hashes)] == _largest_around(least, width, len(hashes)))
    low, high = np.searchsorted(anchor, starts), np.searchsorted(anchor, stops - gram, "right")
    owner = np.repeat(np.arange(len(starts)), high - low)
    inside = anchor[np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    several = np.bincount(owner[hashes[inside] == value[owner]], minlength=len(starts)) > 1
    document = np.searchsorted(offsets, starts, "right") - 1
    run = text.span_hash(prefix, starts, stops)
    base = offsets[document]
    return document, starts - base, stops - base, value, run, several


def _largest_around(least: np.ndarray, width: int, count: int) -> np.ndarray:
    """For each gram position, the largest of the window minima that cover it."""
    padded = np.zeros(count + width - 1, np.uint64)
    padded[width - 1:width - 1 + len(least)] = least
    return ~sliding_least(~padded, width)


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("doc_id"), batch.column("row").to_numpy()
        for low, high, data, offsets in text.slices(batch.column("bytes")):
            document, start, stop, gram, run, several = find_runs(data, offsets, length)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, high - low).take(pa.array(document)), pa.array(rows[low:high][document]), pa.array(start.astype(np.int32)),
                 pa.array(stop.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(run.view(np.int64)), pa.array(several)],
                names=["doc_id", "row", "start", "stop", "gram", "run", "several"])


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position by its next ``length`` bytes (prefix doubling); equal strings
    have equal ranks. Beyond the end counts as zeros."""
    n = len(data)
    done = min(8, length)
    padded = np.append(data, np.zeros(length, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(done):
        key = (key << np.uint64(8)) | padded[i:i + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while done < length:
        step = min(done, length - done)
        later = np.zeros(n, np.int64)
        later[:n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        done += step
    return rank


def factors(data: np.ndarray, windows: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window start has an equal window earlier, and later, by ``order``.

    In suffix order with ties by position, the neighbour before is the previous smaller
    position of the window's longest matches: an equal one means that its longest previous
    factor is at least ``length``; the neighbour after likewise.
    """
    rank = suffix_ranks(data, length)[windows]
    suffixes = np.lexsort((order, rank))
    equal = rank[suffixes[1:]] == rank[suffixes[:-1]]
    previous, following = np.zeros(len(windows), bool), np.zeros(len(windows), bool)
    previous[suffixes[1:]] = equal
    following[suffixes[:-1]] = equal
    return previous, following


def spans(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges covered by the flagged window starts, as starts and stops."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length


_PLACE = ["doc_id", "row", "start"]


def _matched(batches: Iterator[pa.RecordBatch], length: int, first: bool) -> Iterator[pa.RecordBatch]:
    """From run texts sorted by gram: spans of repeated windows of the runs' own documents."""
    held: list[pa.Table] = []
    size = 0

    def solve() -> pa.RecordBatch:
        table = pa.concat_tables(held)
        pieces = [np.frombuffer(x, np.uint8) for x in table.column("piece").to_pylist()]
        sizes = np.array([len(x) for x in pieces])
        data, base = np.concatenate(pieces), np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(pieces)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = [(-1 if d is None else 0, d or 0, r, s) for d, r, s in zip(*[table.column(c).to_pylist() for c in _PLACE], strict=True)]
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        previous, following = factors(data, base[owner] + inside, place[owner] * (int(sizes.max()) + 1) + inside, length)
        flags = previous if first else previous | following
        rows, starts, stops = [], [], []
        bounds = np.cumsum(counts)
        for i in np.unique(owner[flags]):
            a, b = spans(flags[bounds[i] - counts[i]:bounds[i]], length)
            rows.append(np.full(len(a), i))
            starts.append(a + ids[i][3])
            stops.append(b + ids[i][3])
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays(
            [table.column("row").combine_chunks().take(pa.array(np.concatenate(rows or none))),
             pa.array(np.concatenate(starts or none).astype(np.int32)), pa.array(np.concatenate(stops or none).astype(np.int32))],
            names=["row", "start", "stop"])

    for table in text.runs(batches, "gram"):
        held.append(table)
        size += table.column("piece").nbytes
        if size >= CHUNK_BYTES:
            yield solve()
            held, size = [], 0
    if held:
        yield solve()


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Two hashes, document and start of each window of the given run texts."""
    for batch in batches:
        places = zip(*[batch.column(c).to_pylist() for c in (*_PLACE, "copies", "piece")], strict=True)
        for doc_id, row, start, copies, piece in places:
            data = np.frombuffer(piece, np.uint8)
            at = np.arange(len(data) - length + 1)
            one = text.span_hash(text.prefix_hash(data), at, at + length)
            two = text.span_hash(text.prefix_hash(data ^ 0x5A), at, at + length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([doc_id] * len(at), pa.int64()),
                 pa.array(np.full(len(at), row)), pa.array((at + start).astype(np.int32)), pa.array(np.full(len(at), copies))],
                names=["one", "two", "doc_id", "row", "start", "copies"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, wanted = batch.column("bytes").to_pylist(), batch.column("wanted").to_pylist()
        rows = [(w, raw[w["start"]:w["stop"]]) for raw, runs in zip(data, wanted, strict=True) for w in runs]
        kinds = {"doc_id": pa.int64(), "row": pa.int64(), "start": pa.int32(), "gram": pa.int64(), "copies": pa.int64(), "runs": pa.int64()}
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([w[c] for w, _ in rows], kind) for c, kind in kinds.items()], pa.array([p for _, p in rows], pa.binary())],
            names=[*kinds, "piece"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (names document and text), bytes."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))


def repeated_spans(docs: DataFrame, length: int, first: bool) -> DataFrame:
    """Spans (row, start, stop) covered by repeated windows; they may overlap.

    With ``first`` the earliest copy of a window, by doc_id and then by place, is not
    counted as repeated; otherwise every copy is.
    """
    keyed = _keyed(docs)
    runs = materialize(keyed.mapInArrow(partial(_runs, length=length), _RUNS), "runs")
    distinct = runs.groupBy("gram", "run").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "row", "start", "stop")).alias("f"), F.max("several").alias("several"))
    grams = distinct.groupBy("gram").agg(F.count("*").alias("runs"), F.sum("copies").alias("total"), F.max("several").alias("any_several"))
    grams = grams.where("total > 1 or any_several")
    open_runs = materialize(distinct.join(grams, "gram"), "open")
    copied = open_runs.where("copies > 1").select("gram", "run", "f")
    resolved = runs.join(copied, ["gram", "run"])
    if first:
        resolved = resolved.where("struct(doc_id, row, start, stop) != f")
    resolved = resolved.select("row", "start", "stop")
    unclear = open_runs.where("runs > 1 or any_several")
    wanted = unclear.select("f.row", F.struct("f.doc_id", "f.row", "f.start", "f.stop", "gram", "copies", "runs").alias("w"))
    wanted = wanted.groupBy("row").agg(F.collect_list("w").alias("wanted"))
    pieces = keyed.join(wanted, "row").select("bytes", "wanted").mapInArrow(
        _pieces, "doc_id long, row long, start int, gram long, copies long, runs long, piece binary")
    pieces = materialize(pieces, "pieces").dropDuplicates(["gram", "row", "start"])
    gathered = pieces.where(F.col("runs") <= GATHERED_RUNS).select("doc_id", "row", "start", "gram", "piece")
    gathered = gathered.repartition("gram").sortWithinPartitions("gram")
    matched = gathered.mapInArrow(partial(_matched, length=length, first=first), "row long, start int, stop int")
    windows = pieces.where(F.col("runs") > GATHERED_RUNS).mapInArrow(
        partial(_windows, length=length), "one long, two long, doc_id long, row long, start int, copies long")
    counts = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("f")).where("n > 1")
    counted = windows.join(counts, ["one", "two"])
    if first:
        counted = counted.where("struct(doc_id, row, start) != f")
    counted = counted.select("row", "start", (F.col("start") + length).cast("int").alias("stop"))
    return resolved.unionByName(matched).unionByName(counted)


def _merge(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, found in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged = _merge([s["start"] for s in found or []], [s["stop"] for s in found or []])
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((len(raw), sum(b - a for a, b in merged), len(merged), hashlib.sha256(b"".join(kept)).hexdigest(), int(bool(merged))))
        columns = zip(*out, strict=True) if out else ([], [], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut"])


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``text`` by what is left of it, and n_chars; spans shrink to whole characters."""
    for batch in batches:
        names = batch.schema.names
        out, sizes = [], batch.column("n_chars").to_pylist() if "n_chars" in names else []
        for i, (value, found) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)):
            if found:
                raw, kept, last = value.encode(), [], 0
                for a, b in _merge([s["start"] for s in found], [s["stop"] for s in found]):
                    while a < len(raw) and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[last:a])
                    last = b
                value = b"".join([*kept, raw[last:]]).decode()
                if sizes:
                    sizes[i] = len(value)
            out.append(value)
        columns = dict(zip(names, batch.columns, strict=True)) | {"text": pa.array(out, pa.string())}
        if sizes:
            columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
        del columns["_spans"]
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _per_row(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias(name))


def removal_report(docs: DataFrame, length: int = 400, first: bool = False) -> DataFrame:
    """What is removed of each document when repeated windows go.

    Takes doc_id and text; other columns are ignored. Returns a row per input row: doc_id,
    n_bytes, n_removed, n_spans (maximal removed ranges), kept_sha256 of the rest, cut (1 where
    anything is removed).

    Null text counts as empty; texts shorter than ``length`` keep all. Rows with equal
    doc_id and text are copies of each other like any two documents; with ``first``, they
    share one place in the order, so all of them keep what is first. Rows without doc_id
    come first. An empty table gives an empty result.
    """
    found = _per_row(repeated_spans(docs, length, first), "spans")
    joined = _keyed(docs).join(found, "row", "left").select("doc_id", "bytes", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cut int")


def without_repeats(docs: DataFrame, length: int = 400, first: bool = True) -> DataFrame:
    """The documents without repeated windows, the first copy kept; same columns.

    Removed ranges are cut to whole characters. ``n_chars``, where present, is counted
    anew for changed documents. Documents of which nothing is left stay with empty text.
    """
    found = _per_row(repeated_spans(docs, length, first), "_spans").withColumnRenamed("row", "_row")
    joined = docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(found, "_row", "left").drop("_row")
    return joined.mapInArrow(_kept_text, docs.schema)
