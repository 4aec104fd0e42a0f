"""Random forests grown level by level from counts of binned rows.

Every feature is cut into at most ``BINS`` bins, once: between all values if there are no more,
else at quantiles. A pass over the binned rows then grows one level of all trees: a task counts,
for each open node, drawn feature, bin and class, the rows that reach the node, each as often as
the tree's bootstrap drew it; counts are added per tree in Spark, where the best split of each
node is chosen as well. The driver holds the trees alone.

What a task holds or sends is bounded by the model (open nodes x drawn features x bins x classes),
work and stored bytes are in proportion to the rows. A draw follows from the row's content (of
equal rows in a block each has its own), so it does not depend on how rows lie in files.

The result is MLlib's model, read from trees stored in its form, so that scoring, importances,
storing and loading are MLlib's.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom import session

BINS = 32
_BLOCK = 1 << 16
_MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(keys: np.ndarray) -> np.ndarray:
    """64 random bits for each key (the finalizer of splitmix64)."""
    z = keys + _MIX[0]
    z ^= z >> np.uint64(30)
    z *= _MIX[1]
    z ^= z >> np.uint64(27)
    z *= _MIX[2]
    z ^= z >> np.uint64(31)
    return z


def _poisson() -> np.ndarray:
    """How often a bootstrap of all rows draws a row (Poisson, mean 1) for each 16 random bits."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(below, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _few(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Distinct values of each feature, one more than ``BINS`` where there are more."""
    found = [np.zeros(0)] * d
    for batch in batches:
        values = _matrix(batch, d)
        for j in range(d):
            if len(found[j]) <= BINS:
                found[j] = np.union1d(found[j], values[:, j])[:BINS + 1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), [len(f) for f in found])), pa.array(np.concatenate(found))], ["feature", "value"])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def thresholds(rows: DataFrame, d: int) -> list[np.ndarray]:
    """At most ``BINS`` - 1 rising cuts of each feature of ``rows`` (x array<double>)."""
    distinct: list[set[float]] = [set() for _ in range(d)]
    for r in rows.select("x").mapInArrow(partial(_few, d=d), "feature long, value double").distinct().collect():
        distinct[r.feature].add(r.value)
    many = [j for j in range(d) if len(distinct[j]) > BINS]
    columns = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in many])
    quantiles = columns.approxQuantile([f"x{j}" for j in many], [i / BINS for i in range(1, BINS)], 0.001) if many else []
    cuts = [np.array(sorted(values)) for values in distinct]
    cuts = [(c[:-1] + c[1:]) / 2 for c in cuts]
    for j, values in zip(many, quantiles, strict=True):
        cuts[j] = np.unique(values)
    return cuts


def _blocks(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks: bins (a byte a feature), class and key of each."""
    d, held = len(cuts), []

    def block() -> pa.RecordBatch:
        bins, classes, keys = (np.concatenate(parts) for parts in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        again = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
        keys[order[again]] += _mixed(_mixed(keys[:1]) + again.astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, classes, keys)], ["bins", "classes", "keys"])

    for batch in batches:
        values = _matrix(batch, d)
        bins = np.column_stack([np.searchsorted(cuts[j], values[:, j]) for j in range(d)]).astype(np.uint8)
        held.append((bins, batch.column("y").to_numpy(zero_copy_only=False).astype(np.uint16),
                     batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)))
        if sum(len(h[2]) for h in held) >= _BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def binned(df: DataFrame) -> tuple[DataFrame, list[np.ndarray], int]:
    """Blocks of the binned rows of ``features`` and ``label``, the cuts of each feature and the number of classes."""
    x = vector_to_array("features")
    rows = df.select(x.alias("x"), F.col("label").cast("int").alias("y"), F.xxhash64(*[c for c in df.columns if c != "features"], x).alias("key"))
    rows = session.materialize(rows, "forest-rows")
    found = rows.agg(F.max(F.size("x")).alias("d"), F.max("y").alias("top"), F.min("y").alias("low")).first()
    if found.d is None:
        raise ValueError("no rows to train on")
    if found.low < 0:
        raise ValueError("classes are numbered from 0")
    cuts = thresholds(rows, found.d)
    spread = rows.repartition(df.sparkSession.sparkContext.defaultParallelism)
    blocks = session.materialize(spread.mapInArrow(partial(_blocks, cuts=cuts), "bins binary, classes binary, keys binary"), "forest")
    return blocks, cuts, max(2, found.top + 1)


def _counted(batches: Iterator[pa.RecordBatch], trees: list[Growing], depth: int, d: int, classes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """For each tree the drawn rows by open node, drawn feature, bin and class."""
    table = _poisson()
    sums = [np.zeros(t.drawn.size * BINS * classes) for t in trees]
    for batch in batches:
        for bins, y, keys in zip(*(batch.column(c) for c in ("bins", "classes", "keys")), strict=True):
            bins, y = np.frombuffer(bins.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint16)
            keys = np.frombuffer(keys.as_buffer(), np.uint64)
            for i, tree in enumerate(trees):
                if i % 4 == 0:
                    bits = _mixed(_mixed(keys + np.uint64(seed)) + np.uint64(i)).view(np.uint16).reshape(-1, 4)
                if not tree.drawn.size:
                    continue
                times = table.take(bits[:, i % 4])
                row = np.flatnonzero(times)
                at, node = row * d, np.zeros(len(row), np.intp)
                for _ in range(depth):
                    beyond = bins.take(at + tree.feature.take(node)) > tree.cut.take(node)
                    node += node
                    node += 1
                    node += beyond
                place = tree.place.take(node - ((1 << depth) - 1))
                kept = np.flatnonzero(place >= 0)
                if len(kept) < len(place):
                    row, at, place = row.take(kept), at.take(kept), place.take(kept)
                counts, target = times.take(row).astype(float), y.take(row).astype(np.intp)
                slots = tree.drawn.shape[1]
                for s in range(slots):
                    cell = place * slots + s
                    code = (cell * BINS + bins.take(at + tree.drawn.ravel().take(cell))) * classes + target
                    sums[i] += np.bincount(code, counts, sums[i].size)
    for i, total in enumerate(sums):
        if total.size:
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total.tobytes()], pa.binary())], ["tree", "counts"])


def _gini(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and impurity of the class counts in the last axis."""
    n = counts.sum(-1)
    return n, 1 - (counts ** 2).sum(-1) / np.maximum(n, 1) ** 2


def _split(batches: Iterator[pa.RecordBatch], slots: int, classes: int, least: int) -> Iterator[pa.RecordBatch]:
    """Best split of each open node of each tree: slot, bin, gain, class counts on the left and in all."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for tree, counts in zip(batch.column("tree").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(counts.as_buffer())
            total[tree] = total[tree] + part if tree in total else part.copy()
    for tree, counts in total.items():
        left = counts.reshape(-1, slots, BINS, classes).cumsum(2)
        whole = left[:, 0, -1, :]
        n, impurity = _gini(whole)
        (a, low), (b, high) = _gini(left), _gini(whole[:, None, None, :] - left)
        all_rows = np.maximum(n, 1)[:, None, None]
        gain = impurity[:, None, None] - a / all_rows * low - b / all_rows * high
        gain[(a < least) | (b < least)] = -1
        best = gain.reshape(len(gain), -1).argmax(1)
        nodes = np.arange(len(best))
        chosen = np.column_stack([best // BINS, best % BINS, gain.reshape(len(gain), -1)[nodes, best],
                                  left.reshape(len(left), -1, classes)[nodes, best], whole])
        yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([chosen.tobytes()], pa.binary())], ["tree", "splits"])


class Growing:
    """A tree by heap number (children of i: 2 i + 1, 2 i + 2) and its open nodes on the deepest level.

    ``place`` has the open nodes' numbers on that level (-1: closed), ``drawn`` their features. Rows
    of closed nodes go left.
    """

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.feature, self.cut = np.zeros(size, np.intp), np.full(size, 255, np.uint8)
        self.gain, self.counts = np.full(size, -1.0), [None] * size
        self.open, self.depth = [0], depth

    def draw(self, level: int, d: int, slots: int, seed: list[int]) -> None:
        self.place = np.full(1 << level, -1, np.intp)
        self.place[[i - ((1 << level) - 1) for i in self.open]] = np.arange(len(self.open))
        order = np.random.default_rng([*seed, level]).random((len(self.open), d)).argsort(1)
        self.drawn = np.sort(order[:, :slots], 1)

    def split(self, chosen: np.ndarray, classes: int, level: int, least: int) -> None:
        """Take the splits of the open nodes; children that can be split are open."""
        children = []
        for node, features, (slot, cut, gain, *counts) in zip(self.open, self.drawn, chosen.tolist(), strict=True):
            left, whole = np.array(counts[:classes]), np.array(counts[classes:])
            self.counts[node] = whole
            if gain <= 0:
                continue
            self.feature[node], self.cut[node], self.gain[node] = features[int(slot)], int(cut), gain
            for child, part in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                self.counts[child] = part
                if level + 1 < self.depth and part.max() < part.sum() and part.sum() >= 2 * least:
                    children.append(child)
        self.open = children

    def nodes(self, cuts: list[np.ndarray]) -> list[tuple]:
        """Rows of MLlib's stored form, parents first; siblings that are leaves of one class are one leaf."""
        out: list[tuple] = []

        def inner(i: int) -> bool:
            if self.gain[i] <= 0:
                return False
            a, b = 2 * i + 1, 2 * i + 2
            return inner(a) | inner(b) or self.counts[a].argmax() != self.counts[b].argmax()

        def add(i: int) -> int:
            number, counts = len(out), self.counts[i]
            out.append(())
            n, impurity = _gini(counts)
            stats = (float(counts.argmax()), float(impurity), counts.tolist(), int(n))
            if inner(i):
                j, left, right = int(self.feature[i]), add(2 * i + 1), add(2 * i + 2)
                out[number] = (number, *stats, float(self.gain[i]), left, right, (j, [float(cuts[j][self.cut[i]])], -1))
            else:
                out[number] = (number, *stats, -1.0, -1, -1, (-1, [], -1))
            return number

        add(0)
        return out


_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
          "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def store(spark: SparkSession, path: str, head: dict, tree: dict, weights: list[float], trees: list[list[tuple]]) -> None:
    """Write trees in MLlib's stored form of an ensemble."""
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, json.dumps({**tree, "uid": f"dtc_{i}"}), w) for i, w in enumerate(weights)],
                          "treeID int, metadata string, weights double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [(i, node) for i, rows in enumerate(trees) for node in rows]
    spark.createDataFrame(nodes, _NODES).write.parquet(f"{path}/data")


class RandomForest:
    """Random forest classifier: bootstraps, a square root of the features at each node, Gini impurity."""

    def __init__(self, trees: int, depth: int, least: int, seed: int):
        if depth > 16:
            raise ValueError("nodes are numbered by level, up to 16 levels")
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed

    def fit(self, df: DataFrame) -> RandomForestClassificationModel:
        """The model of ``features`` (vector) and ``label`` (0, 1, ...); other columns only vary the draws."""
        spark = session.ship(df.sparkSession)
        blocks, cuts, classes = binned(df)
        d = len(cuts)
        slots = d if self.trees == 1 else math.ceil(math.sqrt(d))
        grown = [Growing(self.depth) for _ in range(self.trees)]
        for level in range(self.depth):
            for i, tree in enumerate(grown):
                tree.draw(level, d, slots, [self.seed, i])
            if not any(tree.open for tree in grown):
                break
            sent = [_Level(tree) for tree in grown]
            count = partial(_counted, trees=sent, depth=level, d=d, classes=classes, seed=self.seed)
            counted = blocks.mapInArrow(count, "tree long, counts binary").repartition(min(session.parallelism(spark), self.trees), "tree")
            split = counted.mapInArrow(partial(_split, slots=slots, classes=classes, least=self.least), "tree long, splits binary")
            for r in split.collect():
                tree = grown[r.tree]
                tree.split(np.frombuffer(r.splits).reshape(len(tree.open), -1), classes, level, self.least)
        return self._model(spark, [tree.nodes(cuts) for tree in grown], d, classes)

    def _model(self, spark: SparkSession, trees: list[list[tuple]], d: int, classes: int) -> RandomForestClassificationModel:
        """MLlib's model of the trees, through its stored form."""
        path, name = session.scratch_path(spark, "forest-model"), "org.apache.spark.ml.classification"
        about = {"timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__, "numFeatures": d, "numClasses": classes}
        settings = {"numTrees": self.trees, "maxDepth": self.depth, "minInstancesPerNode": self.least, "maxBins": BINS, "seed": self.seed,
                    "impurity": "gini", "featureSubsetStrategy": "auto", "subsamplingRate": 1.0, "bootstrap": True}
        tree = {"class": f"{name}.DecisionTreeClassificationModel", **about, "defaultParamMap": {},
                "paramMap": {k: settings[k] for k in ("maxDepth", "minInstancesPerNode", "maxBins", "seed", "impurity")}}
        head = {"class": f"{name}.RandomForestClassificationModel", **about, "uid": f"RandomForestClassifier_{time.time_ns():x}",
                "paramMap": settings, "defaultParamMap": {}, "numTrees": self.trees}
        store(spark, path, head, tree, [1.0] * len(trees), trees)
        return RandomForestClassificationModel.load(path)


class _Level:
    """What a task needs of a growing tree."""

    def __init__(self, tree: Growing):
        self.feature, self.cut, self.place, self.drawn = tree.feature, tree.cut, tree.place, tree.drawn
