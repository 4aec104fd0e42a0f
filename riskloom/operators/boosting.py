"""Boosted trees grown level by level from sums of binned rows.

The rows are binned as for the forests, once. A round draws its rows, takes their pseudo-residuals
as MLlib's gradient boosting does (log loss of labels -1 and 1; the first tree fits the labels
themselves) and fits a regression tree by variance: a pass over the rows grows one level. A task
adds rows, residuals and squares by open node, feature and bin. The driver adds what the tasks of
a small cluster send; beyond ``COLLECTED`` tasks the sums are added per feature in Spark, where each
node's best cut of that feature is found. The driver takes the best of the features that the node drew.

Between rounds the rows carry their margin. It is kept by Spark (memory, then disk) for one round
and written to the shared folder every ``WRITTEN`` rounds, so that a lost executor repeats a few
rounds at most. What a task sends is bounded by the model, work is in proportion to the rows.

Residuals are rounded to 2^-20, so that sums of up to 2^31 rows are exact and trees do not depend
on how rows lie in files. The result is MLlib's model, read from trees stored in its form.
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
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from riskloom import session
from riskloom.operators import forest
from riskloom.operators.forest import BINS

WRITTEN = 10
#: Tasks whose sums the driver adds itself, which takes one stage a level instead of two.
COLLECTED = 64
_UNIT = 1 << 20
_STATE = "bins binary, classes binary, keys binary, margins binary, drawn binary, residuals binary"
_SPLITS = "feature long, splits binary"


class Tree:
    """A regression tree by heap number (children of i: 2 i + 1, 2 i + 2) and its open nodes on the deepest level.

    ``stats`` has rows, sum and squares of the residuals. Rows of closed nodes go left.
    """

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.feature, self.cut = np.zeros(size, np.intp), np.full(size, 255, np.uint8)
        self.gain, self.stats = np.full(size, -1.0), [None] * size
        self.open, self.depth = [0], depth

    def place(self, level: int) -> np.ndarray:
        """Number of each node of a level among the open ones, after them all if it is closed."""
        place = np.full(1 << level, len(self.open), np.intp)
        place[[i - ((1 << level) - 1) for i in self.open]] = np.arange(len(self.open))
        return place

    def split(self, found: dict[int, np.ndarray], drawn: np.ndarray, level: int) -> None:
        """Take each open node's best cut of its drawn features: gain, bin, sums on the left and in all."""
        children = []
        for at, node in enumerate(self.open):
            feature = max(drawn[at].tolist(), key=lambda j: (found[j][at, 0], -j))
            gain, cut, *sums = found[feature][at].tolist()
            left, whole = np.array(sums[:3]), np.array(sums[3:])
            self.stats[node] = whole
            if gain * whole[0] <= 1e-12 * whole[2]:
                continue
            self.feature[node], self.cut[node], self.gain[node] = feature, int(cut), gain
            for child, part in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                self.stats[child] = part
                if level + 1 < self.depth and part[0] >= 2:
                    children.append(child)
        self.open = children

    def values(self) -> np.ndarray:
        """Mean residual of the leaf that each node of the last level is in."""
        first, out = (1 << self.depth) - 1, np.zeros(1 << self.depth)
        for i in range(len(out)):
            node = first + i
            while self.stats[node] is None:
                node = (node - 1) // 2
            out[i] = self.stats[node][1] / self.stats[node][0] if self.stats[node][0] else 0.0
        return out

    def nodes(self, cuts: list[np.ndarray]) -> list[tuple]:
        """Rows of MLlib's stored form, parents first."""
        out: list[tuple] = []

        def add(i: int) -> int:
            number, (n, total, squares) = len(out), self.stats[i].tolist()
            out.append(())
            mean = total / n if n else 0.0
            head = (number, mean, max(0.0, squares / n - mean ** 2) if n else 0.0, [n, total, squares], int(n))
            if self.gain[i] > 0:
                j, left, right = int(self.feature[i]), add(2 * i + 1), add(2 * i + 2)
                out[number] = (*head, float(self.gain[i]), left, right, (j, [float(cuts[j][self.cut[i]])], -1))
            else:
                out[number] = (*head, -1.0, -1, -1, (-1, [], -1))
            return number

        add(0)
        return out


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Number of each row's node on a level; bins by feature and row."""
    n = bins.shape[1]
    flat, row, node = bins.ravel(), np.arange(n), np.zeros(n, np.intp)
    for _ in range(levels):
        beyond = flat.take(feature.take(node) * n + row) > cut.take(node)
        node += node
        node += 1
        node += beyond
    return node - ((1 << levels) - 1)


def _begun(batches: Iterator[pa.RecordBatch], d: int, draw) -> Iterator[pa.RecordBatch]:
    """The forest's blocks with bins by feature and row, margins 0 and the rows of the first round."""
    for batch in batches:
        for bins, classes, keys in zip(*(batch.column(c) for c in ("bins", "classes", "keys")), strict=True):
            rows = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, d)
            y, keys = np.frombuffer(classes.as_buffer(), np.uint16), np.frombuffer(keys.as_buffer(), np.uint64)
            yield _state(np.ascontiguousarray(rows.T), y, keys, np.zeros(len(y)), draw, 0)


def _state(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, margins: np.ndarray, draw: tuple[int, float], number: int) -> pa.RecordBatch:
    """A block at the start of a round: the drawn rows and their residuals, in units of 2^-20."""
    seed, share = draw
    bits = forest._mixed(forest._mixed(keys + np.uint64(seed)) + np.uint64(number))
    drawn = np.flatnonzero(bits >> np.uint64(11) < np.uint64(share * (1 << 53))).astype(np.int32)
    sign = 2.0 * y.take(drawn) - 1
    residual = 4 * sign / (1 + np.exp(2 * sign * margins.take(drawn))) if number else sign
    columns = (bins, y, keys, margins, drawn, np.rint(residual * _UNIT).astype(np.int32))
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in columns], names)


def _advanced(batches: Iterator[pa.RecordBatch], d: int, tree: tuple, values: np.ndarray, depth: int, draw: tuple[int, float], number: int) -> Iterator[pa.RecordBatch]:
    """Blocks at the start of the next round: the tree's values added to the margins."""
    for batch in batches:
        for bins, classes, keys, margins in zip(*(batch.column(c) for c in ("bins", "classes", "keys", "margins")), strict=True):
            bins = np.frombuffer(bins.as_buffer(), np.uint8).reshape(d, -1)
            margins = np.frombuffer(margins.as_buffer()) + values.take(_walk(bins, *tree, depth))
            yield _state(bins, np.frombuffer(classes.as_buffer(), np.uint16), np.frombuffer(keys.as_buffer(), np.uint64), margins, draw, number)


def _counted(batches: Iterator[pa.RecordBatch], d: int, tree: tuple, place: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
    """For each feature rows, residuals and squares by open node and bin."""
    size = (int(place.max(initial=0)) + 1) * BINS
    sums = np.zeros((d, 3, size))
    for batch in batches:
        for bins, drawn, residuals in zip(*(batch.column(c) for c in ("bins", "drawn", "residuals")), strict=True):
            drawn = np.frombuffer(drawn.as_buffer(), np.int32)
            if not len(drawn):
                continue
            bins = np.frombuffer(bins.as_buffer(), np.uint8).reshape(d, -1).take(drawn, 1)
            residual = np.frombuffer(residuals.as_buffer(), np.int32).astype(float)
            squares, base = residual * residual, place.take(_walk(bins, *tree, level)) * BINS
            for j in range(d):
                code = base + bins[j]
                sums[j, 0] += np.bincount(code, minlength=size)
                sums[j, 1] += np.bincount(code, residual, size)
                sums[j, 2] += np.bincount(code, squares, size)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([s.tobytes() for s in sums], pa.binary())], ["feature", "sums"])


def _best(batches: Iterator[pa.RecordBatch], nodes: int) -> Iterator[pa.RecordBatch]:
    """Best cut of a feature for each open node: gain, bin, sums on the left and in all, in units of 1."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for feature, sums in zip(batch.column("feature").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(sums.as_buffer())
            total[feature] = total[feature] + part if feature in total else part.copy()
    for feature, sums in total.items():
        left = sums.reshape(3, -1, BINS)[:, :nodes].cumsum(2) / np.array([1, _UNIT, _UNIT ** 2])[:, None, None]
        whole = left[:, :, -1]
        right = whole[:, :, None] - left
        a, b, n = left[0], right[0], np.maximum(whole[0], 1)[:, None]
        gain = (left[1] ** 2 / np.maximum(a, 1) + right[1] ** 2 / np.maximum(b, 1) - (whole[1] ** 2)[:, None] / n) / n
        gain[(a < 1) | (b < 1)] = -1
        cut = gain.argmax(1)
        at = np.arange(nodes)
        chosen = np.column_stack([gain[at, cut], cut, left[:, at, cut].T, whole.T])
        yield pa.RecordBatch.from_arrays([pa.array([feature]), pa.array([chosen.tobytes()], pa.binary())], ["feature", "splits"])


class BoostedTrees:
    """Gradient boosting of regression trees for two classes.

    ``share`` of the rows are drawn for each tree and ``subset`` of the features for each node;
    each tree after the first counts ``step`` times.
    """

    def __init__(self, rounds: int, depth: int, seed: int, step: float = 0.1, share: float = 0.8, subset: float = 0.8):
        if depth > 16:
            raise ValueError("nodes are numbered by level, up to 16 levels")
        self.rounds, self.depth, self.seed = rounds, depth, seed
        self.step, self.share, self.subset = step, share, subset

    def fit(self, df: DataFrame) -> GBTClassificationModel:
        """The model of ``features`` (vector) and ``label`` (0 or 1); other columns only vary the draws."""
        spark = session.ship(df.sparkSession)
        blocks, cuts, classes = forest.binned(df)
        if classes > 2:
            raise ValueError("labels are 0 and 1")
        d, draw = len(cuts), (self.seed, self.share)
        tasks = spark.sparkContext.defaultParallelism
        state = blocks.coalesce(tasks).mapInArrow(partial(_begun, d=d, draw=draw), _STATE).persist(StorageLevel.MEMORY_AND_DISK)
        trees, before = [], None
        for number in range(self.rounds):
            tree = self._grown(spark, state, d, number)
            trees.append(tree)
            if before is not None:
                before.unpersist()
            before = state
            if number + 1 < self.rounds:
                values = tree.values() * (self.step if number else 1.0)
                advance = partial(_advanced, d=d, tree=(tree.feature, tree.cut), values=values, depth=self.depth, draw=draw, number=number + 1)
                state = state.mapInArrow(advance, _STATE)
                state = session.materialize(state, "boosted").coalesce(tasks) if (number + 1) % WRITTEN == 0 else state.persist(StorageLevel.MEMORY_AND_DISK)
        state.unpersist()
        return self._model(spark, [tree.nodes(cuts) for tree in trees], d)

    def _grown(self, spark: SparkSession, state: DataFrame, d: int, number: int) -> Tree:
        tree, slots = Tree(self.depth), math.ceil(self.subset * d)
        for level in range(self.depth):
            if not tree.open:
                break
            drawn = np.random.default_rng([self.seed, number, level]).random((len(tree.open), d)).argsort(1)[:, :slots]
            count = partial(_counted, d=d, tree=(tree.feature, tree.cut), place=tree.place(level), level=level)
            counted = state.select("bins", "drawn", "residuals").mapInArrow(count, "feature long, sums binary")
            best = partial(_best, nodes=len(tree.open))
            if spark.sparkContext.defaultParallelism > COLLECTED:
                found = counted.repartition(min(session.parallelism(spark), d), "feature").mapInArrow(best, _SPLITS).toArrow().to_batches()
            else:
                found = best(iter(counted.toArrow().to_batches()))
            pairs = [pair for b in found for pair in zip(b.column("feature").to_pylist(), b.column("splits"), strict=True)]
            tree.split({j: np.frombuffer(splits.as_buffer()).reshape(len(tree.open), -1) for j, splits in pairs}, drawn, level)
        return tree

    def _model(self, spark: SparkSession, trees: list[list[tuple]], d: int) -> GBTClassificationModel:
        """MLlib's model of the trees, through its stored form."""
        path = session.scratch_path(spark, "boosted-model")
        about = {"timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__, "numFeatures": d}
        settings = {"maxDepth": self.depth, "maxBins": BINS, "seed": self.seed, "subsamplingRate": self.share,
                    "featureSubsetStrategy": str(self.subset), "impurity": "variance"}
        tree = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about, "defaultParamMap": {},
                "paramMap": {k: settings[k] for k in ("maxDepth", "maxBins", "seed", "impurity")}}
        head = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", **about, "uid": f"GBTClassifier_{time.time_ns():x}",
                "paramMap": {**settings, "maxIter": self.rounds, "stepSize": self.step}, "defaultParamMap": {}, "numTrees": len(trees)}
        weights = [self.step if i else 1.0 for i in range(len(trees))]
        forest.store(spark, path, head, tree, weights, trees)
        return GBTClassificationModel.load(path)
