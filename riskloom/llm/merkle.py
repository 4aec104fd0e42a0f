"""Merkle manifest of a document table, with a witness for every document.

Each group of documents (a language) is a tree over its documents in ascending doc_id; the
roots of the trees, in order of their group, form one more tree. A parent is the sha256 of
its children's hexadecimal digests; a last child without a partner is hashed alone.

Trees grow by aligned append. A task takes the leaves of one block of 2**bits consecutive
positions as a stream and keeps the subtrees that are still open. A new leaf starts with
an empty witness; when the sibling of an open subtree is complete, the sibling's root is
added to the witness of every leaf below, on both sides. The roots of the blocks are then
appended to the tree above in the same way, and so on until every tree has one node. What
the tree above says of a block extends the witnesses of all its leaves. So a group of any
size is spread over its blocks, and a task holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import with_position
from riskloom.session import materialize

#: Levels of a tree that one task builds: a block has 2**BITS leaves.
BITS = 11
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32


def leaf(**replaced: Column) -> Column:
    """Digest (binary) of a document's fields, each as byte count, colon and value, or ``-`` for null."""
    def part(name: str) -> Column:
        value = replaced.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(name) for name in FIELDS]), 256))


def parent(*children: bytes) -> bytes:
    """Digest of a run of nodes."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class OpenTrees:
    """The open subtrees of one block, and a witness for each leaf appended so far."""

    def __init__(self, bits: int):
        self.open: list[tuple[int, bytes, int]] = []
        self.size = 0
        self.siblings = np.zeros((1 << bits, bits, _DIGEST), np.uint8)
        self.known = np.zeros((1 << bits, bits), bool)

    def append(self, node: bytes) -> None:
        self.size += 1
        self._add(0, node, self.size - 1)

    def _add(self, height: int, node: bytes, start: int) -> None:
        """Put a complete subtree beside the open ones; equal heights join."""
        while self.open and self.open[-1][0] == height:
            _, left, first = self.open.pop()
            self.siblings[first:start, height] = np.frombuffer(node, np.uint8)
            self.siblings[start:self.size, height] = np.frombuffer(left, np.uint8)
            self.known[first:self.size, height] = True
            node, height, start = parent(left, node), height + 1, first
        self.open.append((height, node, start))

    def close(self, height: int) -> tuple[bytes, pa.Array]:
        """Root at ``height`` or, if that is higher, of all leaves; and the witnesses, lowest sibling first."""
        while len(self.open) > 1 or self.open[-1][0] < height:
            last, node, start = self.open.pop()
            if self.open and self.open[-1][0] == last:
                self._add(last, node, start)
            else:
                self.open.append((last + 1, parent(node), start))
                if len(self.open) > 1 and self.open[-2][0] == last + 1:
                    self._add(*self.open.pop())
        known = self.known[:self.size]
        offsets = np.concatenate([[0], np.cumsum(known.sum(axis=1) * _DIGEST)]).astype(np.int32)
        data = self.siblings[:self.size][known].tobytes()
        witnesses = pa.Array.from_buffers(pa.binary(), self.size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        root = self.open[-1][1]
        self.open, self.size = [], 0
        self.known[:] = False
        return root, witnesses


def _append(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Witness of every node within its block, and one row more with the root of each block."""
    tree, held, key, n = OpenTrees(bits), [], None, 0

    def closed() -> Iterator[pa.RecordBatch]:
        root, witnesses = tree.close(bits if n > 1 << bits else 0)
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.append_column("witness", witnesses).append_column("block_root", pa.nulls(len(rows), pa.binary()))
        yield from rows.to_batches()
        own = {"tree": key[0], "pos": key[1], "n": (n + (1 << bits) - 1) >> bits, "block_root": root}
        yield pa.RecordBatch.from_pylist([own], schema=rows.schema)

    for batch in batches:
        trees, places, counts, nodes = (batch.column(c).to_pylist() for c in ("tree", "pos", "n", "node"))
        low = 0
        for i, (t, p) in enumerate(zip(trees, places, strict=True)):
            if key != (t, p >> bits):
                if i > low:
                    held.append(batch.slice(low, i - low))
                if key is not None:
                    yield from closed()
                held, low, key, n = [], i, (t, p >> bits), counts[i]
            tree.append(nodes[i])
        if batch.num_rows > low:
            held.append(batch.slice(low))
    if key is not None:
        yield from closed()


def _grown(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of blocks over (tree, pos, n, node, ...), and the root (tree, node) of each tree."""
    levels = []
    while True:
        block = F.shiftright("pos", bits)
        rows = nodes.repartition("tree", block).sortWithinPartitions("tree", "pos")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", witness binary, block_root binary"
        grown = materialize(rows.mapInArrow(partial(_append, bits=bits), schema), "merkle_level")
        levels.append(grown.where("block_root IS NULL").drop("block_root"))
        nodes = grown.where("block_root IS NOT NULL").select("tree", "pos", "n", F.col("block_root").alias("node"))
        if nodes.where("n > 1").isEmpty():
            return levels, nodes.select("tree", "node")


def _extended(level: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """A level's witnesses with what the level above (tree, pos, upper, ...) adds to each block."""
    above = materialize(above.withColumnRenamed("pos", "_block"), "merkle_above")
    joined = level.join(above.withColumnRenamed("tree", "_tree"), (F.col("tree") == F.col("_tree")) & (F.shiftright("pos", bits) == F.col("_block")))
    return joined.withColumn("upper", F.concat("witness", "upper")).drop("_tree", "_block", "witness")


def manifest(docs: DataFrame, bits: int = BITS, **kept: Column) -> DataFrame:
    """Leaf, place, witness and roots of every document.

    Takes doc_id, source, lang, n_chars and text; other columns are ignored, but for
    ``kept`` ones, which are computed on ``docs`` and carried along. Returns a row per input row:
    doc_id, lang, leaf, tree and n_trees (place of the language among all), pos and n
    (place of the document within its language), subroot, root, witness (the digests of all
    siblings, lowest first) and the kept columns; digests are binary. Null values count as
    ``-`` in leaves; null languages form a tree of their own, the first, and null ids come first.
    Equal ids are ordered by leaf, so that repeated rows are leaves side by side. An empty
    table gives no rows. Languages may be many, and one may hold all rows.
    """
    columns = {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "node": leaf(), **kept}
    leaves = materialize(docs.select(*[c.alias(name) for name, c in columns.items()]), "merkle_leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("node")]
    placed = materialize(with_position(leaves, order, "_position"), "merkle_placed")
    langs = placed.groupBy("lang").agg(F.count("*").alias("n"), F.min("_position").alias("_first"))
    langs = materialize(with_position(langs, [F.col("lang").asc_nulls_first()], "tree"), "merkle_trees")
    own = langs.withColumnRenamed("lang", "_lang")
    nodes = placed.join(own, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("pos", F.col("_position") - F.col("_first"))
    levels, subroots = _grown(nodes.drop("_lang", "_position", "_first"), bits)

    n_trees = langs.agg(F.count("*")).scalar()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), n_trees.alias("n"), "node")
    upper, top = _grown(tops, bits)
    above = top.select("tree", F.lit(0).cast("long").alias("pos"), F.col("node").alias("root"), F.lit(b"").alias("upper"))
    for level in reversed(upper):
        named = level.withColumnRenamed("node", "subroot") if level is upper[0] else level.drop("node")
        above = _extended(named if level is upper[0] else named.drop("n"), above, bits)
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("n").alias("n_trees"), "subroot", "root", "upper")
    for level in reversed(levels):
        above = _extended(level if level is levels[0] else level.drop("node", "n"), above, bits)
    return above.withColumnsRenamed({"node": "leaf", "upper": "witness"})


def _folded(node: bytes, witness: bytes, places: list[tuple[int, int]]) -> bytes:
    """Root that a leaf and its siblings give at (position, size) in one tree after the other."""
    at = 0
    for pos, n in places:
        while n > 1:
            if pos ^ 1 < n:
                sibling = witness[at:at + _DIGEST]
                at += _DIGEST
                node = parent(sibling, node) if pos & 1 else parent(node, sibling)
            else:
                node = parent(node)
            pos, n = pos >> 1, (n + 1) >> 1
    return node


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        rows = zip(*[column[c] for c in ("presented", "witness", "pos", "n", "tree", "n_trees")], strict=True)
        folded = [_folded(node, witness, [(pos, n), (tree, trees)]) for node, witness, pos, n, tree, trees in rows]
        proofs = [hashlib.sha256(w.hex().encode()).hexdigest() for w in column["witness"]]
        texts = [pa.array([v.hex() for v in values], pa.string()) for values in (column["leaf"], column["subroot"], column["root"])]
        same = [f == r for f, r in zip(folded, column["root"], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *texts, pa.array(proofs, pa.string()), pa.array([f.hex() for f in folded], pa.string()), pa.array(same, pa.bool_())],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(found: DataFrame, presented: Column | None = None) -> DataFrame:
    """Check a digest against the root through each document's witness.

    ``found`` is a manifest; ``presented`` the digest (binary) to check, a column of it; null
    and by default the leaf itself. Returns a row per document: doc_id, leaf, subroot, root,
    proof_sha256 (of all siblings), folded_root (what the presented digest leads to), verified.
    """
    given = F.col("leaf") if presented is None else F.coalesce(presented, F.col("leaf"))
    rows = found.select("doc_id", "leaf", "subroot", "root", given.alias("presented"), "witness", "pos", "n", "tree", "n_trees")
    return rows.mapInArrow(_proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
