"""Groups of documents linked by the Jaccard similarity of their word shingles.

Exact, without listing the pairs of a group:

1. Equal sets are one node, named by the digest of the set.
2. Index lists by position. The first ``slack + k`` shingles of two linked sets, in hash
   order, share at least k: a set with fewer shared first shingles is dropped, and then a
   set of which too few shingles of all occur in any other set.
3. The surviving sets are cut into candidate groups (connected through a list of their
   rarest shingles) and these into blocks ("cells") by set size; a pair of blocks whose
   sizes cannot match is skipped.
4. Within a pair of cells one reference set (shingles of the majority) is compared once
   and every other answer is derived from it: with R the reference's shingles that a set
   lacks and A those it adds, |x & z| = |ref| - |Rx| - |Rz| + |Rx & Rz| + |Ax & Az|.
5. Every cell is compared with itself and a hub cell first. Cells that this proves to be
   of one component are skipped in the second round.

Only set digests, shingles of surviving sets and a spanning forest of links are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import text
from riskloom.llm.components import components
from riskloom.session import materialize

#: Bits of a shingle hash that are left out of the index lists that only filter.
DROPPED = 24
CELL = 512
COLUMNS_AT_ONCE = 2048
#: Bits of the marks by which rows are let through to a join (4 MB, however large the tables).
MARKS = 1 << 25


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any linked set."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """Further index entries of a set of ``n``; any monotone function is exact."""
    return 1 + n // 8


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a text column.

    A document of fewer than ``k`` words has its whole word sequence as one shingle;
    without words its set is empty.
    """
    factor = np.uint64(0xD6E8FEB86659FD93)
    for _, _, data, offsets in text.slices(column):
        hashes, first = text.word_hashes(data, offsets)
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            rolled = rolled * factor + hashes[i:i + len(rolled)]
        rolled = text.mix(rolled + np.uint64(k))
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if high - low >= k:
                yield np.unique(rolled[low:high - k + 1])
            elif high > low:
                h = np.zeros(1, np.uint64)
                for x in hashes[low:high]:
                    h = h * factor + x
                yield text.mix(h + np.uint64(high - low))
            else:
                yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> str:
    return hashlib.md5(shingles.tobytes(), usedforsecurity=False).hexdigest()


def _members(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [(len(s), digest(s) if len(s) else None) for s in shingle_sets(batch.column("text"), k)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("spelled"), pa.array([n for n, _ in sets], pa.int64()), pa.array([d for _, d in sets], pa.string())],
            names=["doc_id", "spelled", "n_shingles", "node"])


def coarse(tokens: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, node) of a set's rising hashes without their low bits, which shortens what is shuffled.

    Hashes that become equal can only make a set share more. Where two of one set do, the set
    shares a token of its own with a node 0 instead, so that it never shares less.
    """
    short = tokens >> np.uint64(DROPPED) << np.uint64(DROPPED)
    first = np.ones(len(short), bool)
    first[1:] = short[1:] != short[:-1]
    lost = np.repeat(tokens[~first] | np.uint64(1), 2)
    nodes = np.full(int(first.sum()) + len(lost), node, np.uint64)
    nodes[len(nodes) - len(lost) + 1::2] = 0
    return np.concatenate([short[first], lost]), nodes


def _entries(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(token, node) for the first shingles of each set, once per distinct set of a task."""
    seen: set[str] = set()
    for batch in batches:
        tokens, nodes = [], []
        for shingles in shingle_sets(batch.column("text"), k):
            n = len(shingles)
            if not n or (node := digest(shingles)) in seen:
                continue
            seen.add(node)
            for out, part in zip((tokens, nodes), coarse(shingles[:n - least_shared(n, percent) + spare(n)], int(node[:16], 16)), strict=True):
                out.append(part)
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes).view(np.int64))], names=["token", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (token, node) sorted by both: how many tokens of a node another node has, too.

    One row is kept from batch to batch, however long a token's list is.
    """
    def rows(nodes: np.ndarray) -> pa.RecordBatch:
        own, counts = np.unique(nodes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts.astype(np.int64))], names=["node", "shared"])

    last: tuple[int, int, bool] | None = None  # token, node, whether it is counted
    for batch in batches:
        token, node = batch.column("token").to_numpy(), batch.column("node").to_numpy()
        keep = np.ones(len(token), bool)  # a set that several tasks sent counts once
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        if last is not None and token[0] == last[0] and node[0] == last[1]:
            keep[0] = False
        token, node = token[keep], node[keep]
        if not len(token):
            continue
        equal = token[1:] == token[:-1]
        hit = np.zeros(len(token), bool)
        hit[1:] |= equal
        hit[:-1] |= equal
        extra = []
        if last is not None and token[0] == last[0]:
            hit[0] = True
            if not last[2]:
                extra = [last[1]]
        last = (int(token[-1]), int(node[-1]), bool(hit[-1]))
        found = np.concatenate([node[hit], np.array(extra, np.int64)])
        if len(found):
            yield rows(found)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text"), k))
        same = np.array([len(s) > 0 and digest(s) == node for s, node in zip(sets, batch.column("node").to_pylist(), strict=True)], bool)
        kept = [s for s, good in zip(sets, same, strict=True) if good]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").filter(pa.array(same)), pa.array([len(s) for s in kept], pa.int64()),
             pa.array([s.tobytes() for s in kept], pa.binary())], names=["node", "n", "shingles"])


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(raw, np.int64) for raw in batch.column("shingles").to_pylist()]
        if sets:
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets)), batch.column("short").take(pa.array(owner))], names=["token", "node"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the links among ``sets``, derived from one reference set."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if count == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        link = 100 * both >= percent * (sizes.sum() - both)
        return np.array([[True, link], [link, True]])
    owner = np.repeat(np.arange(count), sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    in_reference = 2 * df > count
    lacking = int(in_reference.sum()) - np.bincount(owner[in_reference[token]], minlength=count)
    shared = int(in_reference.sum()) - lacking[:, None] - lacking[None, :]
    total = np.zeros((count, count), np.float64)
    useful = np.flatnonzero((df > 1) & (df < count))
    place = np.full(len(df), -1)
    place[useful] = np.arange(len(useful))
    for low in range(0, len(useful), COLUMNS_AT_ONCE):
        high = min(len(useful), low + COLUMNS_AT_ONCE)
        at = place[token]
        here = (at >= low) & (at < high)
        block = np.zeros((count, high - low), np.float32)
        block[owner[here], at[here] - low] = 1
        turned = in_reference[useful[low:high]]
        block[:, turned] = 1 - block[:, turned]
        total += block @ block.T
    both = shared + np.rint(total).astype(np.int64)
    link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(link, True)
    return link


def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each cell pair: every node to the first node it is connected with."""
    for table in text.runs(batches, "pair"):
        order = np.argsort(table.column("node").to_numpy(zero_copy_only=False))
        nodes = [table.column("node")[int(i)].as_py() for i in order]
        raw = table.column("shingles").combine_chunks()
        link = linked([np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order], percent)
        label = np.arange(len(nodes))
        while True:
            after = np.where(link, label[None, :], len(nodes)).min(1)
            after = np.minimum(after, after[after])
            if (after == label).all():
                break
            label = after
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in moved]), pa.array([nodes[label[i]] for i in moved])], names=["a", "b"])


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Spanning links of all pairs of cells. sets: cell, node, shingles; pairs: a, b."""
    named = pairs.withColumn("pair", F.xxhash64("a", "b"))
    sides = named.select("pair", F.col("a").alias("cell")).union(named.where("a != b").select("pair", F.col("b").alias("cell")))
    rows = sets.join(sides, "cell").select("pair", "node", "shingles")
    rows = rows.repartition("pair").sortWithinPartitions("pair")
    return rows.mapInArrow(partial(_forest, percent=percent), "a string, b string")


def _marked(docs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``docs`` whose keys may be among those of ``wanted``: no wanted row is lost, few others stay.

    Each wanted row sets one of ``MARKS`` bits. Only the marks are broadcast, in at most ``MARKS`` / 64
    rows, so the texts of all other rows need not be shuffled for the join that follows.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(MARKS))
    word, at = F.shiftright(slot, 6).alias("_word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("_at")
    marks = wanted.select(word, at).select("_word", F.expr("shiftleft(1L, _at)").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = docs.select("*", word, at).join(F.broadcast(marks), "_word")
    return placed.where(F.getbit("_bits", F.col("_at")) == 1).select(*docs.columns)


def _cells(sets: DataFrame, group: list[str], percent: int) -> DataFrame:
    """Append ``cell``: at most about CELL sets of one group and size class."""
    width = float(np.log(100 / percent)) if percent < 100 else 1.0
    sets = sets.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    small = sets.groupBy(*group).agg(F.count("*").alias("_group"))
    sets = sets.join(small, group).withColumn("class", F.when(F.col("_group") <= CELL, -1).otherwise(F.col("class")))
    sizes = sets.groupBy(*group, "class").agg(F.count("*").alias("_class"))
    sets = sets.join(sizes, [*group, "class"])
    parts = F.ceil(F.col("_class") / CELL)
    sets = sets.withColumn("part", F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64("node"), parts)).cast("long"))
    return sets.withColumn("cell", F.xxhash64(*group, "class", "part")).drop("_class")


def _lowest(n: str, percent: int) -> Column:
    """SQL counterpart of ``least_shared``."""
    return F.ceil(F.col(n) * percent / 100)


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all sets which may be linked, a star for each index list.

    Index entries are a set's rarest shingles, so lists of a passage that many sets share
    are hardly used; shingles of no other set need no list.
    """
    tokens = sets.mapInArrow(_all_tokens, "token long, node long")
    lists = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("node").alias("b")).where("df > 1")
    shared = tokens.join(lists, "token")
    order = Window.partitionBy("node").orderBy("df", "token")
    ranked = shared.withColumn("rank", F.row_number().over(order)).withColumn("shared", F.count("*").over(Window.partitionBy("node")))
    sizes = sets.select(F.col("short").alias("node"), "n")
    ranked = ranked.join(sizes, "node").where(F.col("rank") <= F.col("shared") - _lowest("n", percent) + 1)
    return ranked.select(F.col("node").alias("a"), "b").where("a != b").distinct()


def _components(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of every node that has a link."""
    groups = components(_candidates(sets, percent)).withColumnRenamed("node", "short").withColumnRenamed("component", "group")
    sets = materialize(_cells(sets.join(groups, "short"), ["group"], percent), "cells")
    cells = sets.groupBy("cell").agg(F.first("group").alias("group"), F.first("class").alias("class"), F.first("part").alias("part"))
    hubs = cells.where("part = 0").select("group", F.col("class").alias("hub_class"), F.col("cell").alias("hub"))
    pairs = cells.join(hubs, "group").where(F.abs(F.col("class") - F.col("hub_class")) <= 1).select("cell", "hub")
    pairs = pairs.select(F.least("cell", "hub").alias("a"), F.greatest("cell", "hub").alias("b"))
    pairs = pairs.union(cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))).distinct()
    links = materialize(_links(sets, pairs, percent), "links")
    large = sets.where(F.col("_group") > CELL).drop("cell", "class", "part", "_group")
    if large.isEmpty():
        return components(links)
    found = components(links)
    large = large.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    counts = large.groupBy("group", "label").agg(F.count("*").alias("_label"))
    large = large.join(counts, ["group", "label"]).withColumn("label", F.when(F.col("_label") > CELL // 8, F.col("label")).otherwise(""))
    large = materialize(_cells(large, ["group", "label"], percent), "cells")
    cells = large.groupBy("cell").agg(*[F.first(c).alias(c) for c in ("group", "label", "class")])
    other = cells.select(*[F.col(c).alias(f"_{c}") for c in cells.columns])
    near = (F.col("class") == -1) | (F.col("_class") == -1) | (F.abs(F.col("class") - F.col("_class")) <= 1)
    open_pair = (F.col("label") == "") | (F.col("label") != F.col("_label"))
    pairs = cells.join(other, (F.col("group") == F.col("_group")) & (F.col("cell") <= F.col("_cell")) & near & open_pair)
    more = _links(large, pairs.select(F.col("cell").alias("a"), F.col("_cell").alias("b")), percent)
    return components(links.union(materialize(more, "links")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Documents with the smallest doc_id reachable over links of their shingle sets.

    Two sets are linked when 100 * |intersection| >= percent * |union|. Takes doc_id and
    text; other columns are ignored. Returns a row per input row: doc_id, n_shingles,
    component_id, node (digest of the set, null if empty), component (the least node of the
    component), spelled (hash of the text, which tells rows of one doc_id apart).

    Null or empty text, or text without words, has an empty set and is linked with
    nothing. Repeated rows and equal texts share a component. A row without doc_id takes
    part and gets its component; a component without any doc_id has a null id. An empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("spelled"))
    members = materialize(docs.mapInArrow(partial(_members, k=k), "doc_id long, spelled long, n_shingles long, node string"), "members")
    nodes = members.where("node is not null").groupBy("node").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "spelled")).alias("row"), F.max("n_shingles").alias("n"))
    # a node's set is read from one row, so that rows without doc_id meet only equal texts
    nodes = nodes.select("node", "row.doc_id", "row.spelled", "n")
    entries = docs.mapInArrow(partial(_entries, k=k, percent=percent), "token long, node long")
    shared = entries.repartition("token").sortWithinPartitions("token", "node")
    shared = shared.mapInArrow(_shared, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    shared = materialize(shared, "shared").withColumnRenamed("node", "short")
    enough = F.col("shared") >= 1 + F.floor(_lowest("n", percent) / 8)
    short = F.conv(F.substring("node", 1, 16), 16, -10).cast("long")
    alive = materialize(nodes.withColumn("short", short).join(shared, "short").where(enough).select("node", "doc_id", "spelled"), "alive")
    near = _marked(docs, alive, ["doc_id", "spelled"])
    sets = near.join(alive, near.doc_id.eqNullSafe(alive.doc_id) & (near.spelled == alive.spelled)).select("node", "text")
    sets = sets.mapInArrow(partial(_sets, k=k), "node string, n long, shingles binary").dropDuplicates(["node"])
    sets = materialize(sets.withColumn("short", short), "sets")
    shared = sets.mapInArrow(_all_tokens, "token long, node long").repartition("token").sortWithinPartitions("token", "node")
    shared = shared.mapInArrow(_shared, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    likely = sets.join(shared.withColumnRenamed("node", "short"), "short").where(F.col("shared") >= _lowest("n", percent))
    found = _components(materialize(likely.drop("shared"), "likely"), percent)
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.select("node", "component").join(ids, "component").select("node", "component", "component_id")
    joined = members.join(named, "node", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("component_id"),
                         "node", "component", "spelled")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first (smallest doc_id) of their group; others go.

    Documents with empty texts and rows without doc_id all stay. Rows that share a doc_id
    are judged each by its own text: of those of one group that have its smallest doc_id the
    one with the least node stays, and of rows with equal doc_id and words one.
    """
    found = jaccard_components(docs, k, percent)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = materialize(repeated, "repeated")
    later = found.where("doc_id != component_id").select("doc_id").distinct()
    if repeated.isEmpty():
        return docs.join(later, "doc_id", "left_anti")
    once = docs.join(repeated, "doc_id", "left_anti").join(later, "doc_id", "left_anti")
    first = found.where("doc_id = component_id and node is not null").groupBy("component").agg(F.min("node").alias("_first"))
    judged = found.join(repeated, "doc_id").join(first, "component", "left")
    stays = F.col("node").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("_first")))
    order = Window.partitionBy("doc_id", "node").orderBy("spelled")
    judged = judged.where(stays).select("doc_id", "node", "spelled").distinct()
    kept = judged.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    kept = kept.select(F.col("doc_id").alias("_d"), F.col("spelled").alias("_s"))
    own = docs.where("doc_id is not null")
    same = (own["doc_id"] == F.col("_d")) & (F.xxhash64(own["text"]) == F.col("_s"))
    return once.unionByName(own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]))
