"""Toxicity of texts by a string-kernel support vector machine with landmarks.

The kernel of two words is the gap-weighted subsequence kernel of length three: every three
letters in order, spanning at most five, count decay**span. Punctuation within a word
is skipped and single letters in a row are one word, so "i.d.i-o.t" and "i d i o t" are
close to the plain word; other inserted characters cost a factor. Words are normalised by
the norm of a word of their length.

Training is on words that carry the label of their document; sentences are not split. A
toxic document counts by its most toxic word, found anew in each round (multiple-instance
learning); all words of clean documents count as clean, other words of toxic ones do not
train. The kernel does not cross words. Landmarks are the words that speak
most for toxic documents, besides frequent words of clean ones. With the landmarks' Nystroem
map the machine is linear in it, so a word's margin is a sum over its subsequences of one
table: no kernel is evaluated when texts are scored. A text's score is a logistic function,
fitted on the documents of the sample, of the two largest margins that a machine trained without
the document gives it; each class weighs as many documents as the training labels have of
it, whatever the sample's limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import text
from riskloom.session import materialize, parallelism

DECAY = 0.6
THRESHOLD = 0.3
SAMPLE_PER_CLASS = 2000
LANDMARKS = 96
#: Parts of the sample, each judged for calibration by a machine of the others.
FOLDS = 3
#: Weight of all distinct words of clean texts over that of all witnesses; a witness weighs no less than a clean word.
BALANCE = 20.0
_PATTERNS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
_FEATURES = 1 << 15
_CODE = np.zeros(256, np.int64)
_CODE[48:58] = 31
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:192] = 0
_CODE[192:256] = 27 + np.arange(64) % 4
_CONTINUED = np.zeros(256, bool)
_CONTINUED[128:192] = True


def _norms(longest: int = 64) -> np.ndarray:
    """Norm of a word of n different letters."""
    out = np.zeros(longest + 1)
    for _, span in _PATTERNS:
        out += np.maximum(0, np.arange(longest + 1) - span) * DECAY ** (2 * (span + 1))
    return np.sqrt(out)


_NORMS = _norms()


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes and word number of each letter, the words' start bytes, and the first
    word of each document. Continuation bytes are told apart by the letter they end."""
    starts, ends, first = text.words(data, offsets)
    codes = _CODE[data]
    follows = np.zeros(len(data), bool)
    follows[1:] = _CONTINUED[data[1:]]
    at = np.flatnonzero(follows)
    codes[at - 1] = np.where(codes[at - 1] > 26, 27 + (data[at].astype(np.int64) % 5), codes[at - 1])
    single = ends - starts == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1]
    joined[first[:-1][first[:-1] < len(starts)]] = False
    number = np.cumsum(~joined) - 1
    kept = np.flatnonzero(codes > 0)
    word = number[np.searchsorted(starts, kept, "right") - 1] if len(kept) else np.zeros(0, np.int64)
    heads = starts[~joined]
    return codes[kept], word, heads, np.searchsorted(heads, offsets)


def _subsequences(codes: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Word, subsequence and weight of every pattern within words."""
    for middle, span in _PATTERNS:
        n = len(codes) - span
        if n <= 0:
            continue
        inside = np.flatnonzero(word[:n] == word[span:])
        key = (codes[inside] << 10) | (codes[inside + middle] << 5) | codes[inside + span]
        yield word[inside], key, DECAY ** (span + 1)


def margins(codes: np.ndarray, word: np.ndarray, count: int, table: np.ndarray) -> np.ndarray:
    """Margin, without the bias, of each word: its subsequences' table sum over its norm."""
    total = np.zeros(count)
    for owner, key, weight in _subsequences(codes, word):
        total += np.bincount(owner, weight * table[key], minlength=count)
    return total / _lengths(codes, word, count)


def word_map(words: list[str]) -> np.ndarray:
    """Normalised subsequence vectors of words, one row each."""
    out = np.zeros((len(words), _FEATURES), np.float32)
    for row, word in zip(out, words, strict=True):
        data = np.frombuffer(word.encode(), np.uint8)
        codes, number, _, _ = spelled(data, np.array([0, len(data)]))
        for _, key, weight in _subsequences(codes, number):
            np.add.at(row, key, weight)
        norm = _NORMS[min(len(codes), len(_NORMS) - 1)]
        if norm > 0:
            row /= norm
    return out


def _two_largest(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The two largest margins of each document; 0 where it has no further word."""
    out = np.zeros((len(first) - 1, 2))
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        values = values.copy()
        for i in range(2):
            largest = np.maximum.reduceat(values, first[:-1][filled])
            out[filled, i] = np.maximum(largest, 0) if i else largest
            at = np.flatnonzero(values == np.repeat(largest, np.diff(np.append(first[:-1][filled], len(values)))))
            owner = np.searchsorted(first, at, "right") - 1
            values[at[np.unique(owner, return_index=True)[1]]] = -np.inf
        out[~np.isfinite(out)] = 0
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, cost: float = 4.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        a, c = x1[active], cost * weight[active]
        after = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        if np.allclose(after, w, atol=1e-9):
            break
        w = after
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray | float = 1.0) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; rows weigh their ``mass``."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (mass * (p - y)) + 0.05 * w
        step = np.linalg.solve((x1 * (mass * p * (1 - p))[:, None]).T @ x1 + 0.05 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, trains: Column, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Labelled training documents, at most ``per_class`` of each class, by a fixed order of ids.

    Columns toxic, text and mass: the training labels of the class that each row stands for.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(trains)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("_order", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("toxic") == t).orderBy("_order", "doc_id").limit(per_class) for t in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")
    share = known.groupBy(F.col("toxic").alias("_t")).agg(F.greatest(F.count("*") / per_class, F.lit(1.0)).alias("mass"))
    ids = ids.join(F.broadcast(share), F.col("toxic") == F.col("_t")).select("doc_id", "toxic", "mass")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.repartition(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.select("toxic", "text", "mass"), "toxicity_sample")


def _letters(codes: np.ndarray, word: np.ndarray, count: int) -> list[str]:
    """Each word's letter codes as characters."""
    raw = (codes + 96).astype(np.uint8).tobytes().decode("ascii")
    ends = np.cumsum(np.bincount(word, minlength=count)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Letter codes and word numbers of words written by ``_letters``, and the number of words."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    _, _, data, offsets = next(text.slices(column, 1 << 62))
    return data.astype(np.int64) - 96, np.repeat(np.arange(len(column)), np.diff(offsets)), len(column)


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each document that have a subsequence."""
    for batch in batches:
        for low, high, data, offsets in text.slices(batch.column("text")):
            codes, word, heads, first = spelled(data, offsets)
            words = _letters(codes, word, len(heads))
            toxic = batch.column("toxic").to_pylist()[low:high]
            found = [(t, w) for t, a, b in zip(toxic, first, first[1:], strict=False) for w in sorted(set(words[a:b])) if len(w) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string())], names=["toxic", "word"])


def _witnesses(batches: Iterator[pa.RecordBatch], table: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    """The word of largest margin of each document."""
    for batch in batches:
        for _, _, data, offsets in text.slices(batch.column("text")):
            codes, word, heads, first = spelled(data, offsets)
            words, margin = _letters(codes, word, len(heads)), margins(codes, word, len(heads), table) + bias
            margin[np.bincount(word, minlength=len(heads)) < 3] = -np.inf
            best = [a + int(margin[a:b].argmax()) for a, b in zip(first, first[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in best if np.isfinite(margin[i])], pa.string())], names=["word"])


def _features(codes: np.ndarray, word: np.ndarray, count: int, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Landmark features of words: sums of ``rows`` over subsequences; ``place`` 0 has none."""
    out = np.zeros((count, rows.shape[1]))
    for owner, key, weight in _subsequences(codes, word):
        at = place[key]
        owner, at = owner[at > 0], at[at > 0]
        if len(owner):
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[heads]] += weight * np.add.reduceat(rows[at], heads, axis=0)
    return out / _lengths(codes, word, count)[:, None]


def _lengths(codes: np.ndarray, word: np.ndarray, count: int) -> np.ndarray:
    """Norms of words; infinite for words without subsequences."""
    letters = np.bincount(word, minlength=count)
    norm = _NORMS[np.minimum(letters, len(_NORMS) - 1)]
    norm[letters >= len(_NORMS)] *= np.sqrt(letters[letters >= len(_NORMS)] / (len(_NORMS) - 1))
    return np.where(norm > 0, norm, np.inf)


def _normal(batches: Iterator[pa.RecordBatch], w: np.ndarray, place: np.ndarray, rows: np.ndarray, cost: float) -> Iterator[pa.RecordBatch]:
    """Sums of the normal equations over the words within the margin of the machine ``w``."""
    square, right, table = np.zeros((len(w), len(w))), np.zeros(len(w)), (rows @ w[:-1])[place]
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            margin = margins(*_coded(part.column("word")), table) + w[-1]
            positive = part.column("positive").to_numpy() * (margin < 1) * cost
            negative = part.column("negative").to_numpy() * (margin > -1) * cost
            active = positive + negative > 0
            positive, negative, part = positive[active], negative[active], part.filter(pa.array(active))
            codes, word, count = _coded(part.column("word"))
            x = np.hstack([_features(codes, word, count, place, rows), np.ones((count, 1))])
            square += (x * (positive + negative)[:, None]).T @ x
            right += (positive - negative) @ x
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([square.ravel(), right])], pa.list_(pa.float64()))], names=["sums"])


def _machine(words: DataFrame, w: np.ndarray, place: np.ndarray, rows: np.ndarray, rounds: int = 60, cost: float = 4.0) -> np.ndarray:
    """Squared-hinge machine over all rows (word, positive, negative) by Newton steps, starting at ``w``.

    Each step adds up one matrix per task; no word comes to the driver.
    """
    n = len(w)
    ridge = np.eye(n)
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        parts = words.mapInArrow(partial(_normal, w=w, place=place, rows=rows, cost=cost), "sums array<double>").collect()
        sums = np.sum(sorted(r["sums"] for r in parts), axis=0)
        after = np.linalg.solve(ridge + sums[:n * n].reshape(n, n), sums[n * n:])
        if np.allclose(after, w, atol=1e-8):
            break
        w = after
    return w


def _largest(batches: Iterator[pa.RecordBatch], table: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    """toxic, mass and the two largest margins of documents."""
    for batch in batches:
        for low, high, data, offsets in text.slices(batch.column("text")):
            codes, word, heads, first = spelled(data, offsets)
            best = _two_largest(margins(codes, word, len(heads), table) + bias, first)
            known = [batch.column(c).slice(low, high - low) for c in ("toxic", "mass")]
            yield pa.RecordBatch.from_arrays([*known, pa.array(best[:, 0]), pa.array(best[:, 1])], names=["toxic", "mass", "a", "b"])


def fit(sample: DataFrame, landmarks: int = LANDMARKS, rounds: int = 3, balance: float = BALANCE, folds: int = FOLDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Table, bias and logistic weights from (toxic, text, mass) of labelled documents.

    Every word of three letters or more trains; words stay in Spark. The logistic function is
    fitted on margins that machines give which were trained without the document, by ``folds``
    parts of the sample: margins of a machine's own training documents are too sure. The driver gets the
    landmarks, one matrix per task and Newton step, and two margins per document. Without
    examples of both classes the table is zero and every score is the share of toxic
    examples (0 without any).
    """
    counts = sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("mass").alias("mass")).collect()
    n, mass = ({r["toxic"]: r[c] for r in counts} for c in ("n", "mass"))
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        share = 1.0 if n_toxic else 0.0
        return np.zeros(_FEATURES), 0.0, np.array([0.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6))])
    machine = _trained(sample, landmarks, rounds, balance)
    if machine is None:
        return np.zeros(_FEATURES), 0.0, np.array([0.0, 0.0, math.log(mass[1] / mass[0])])
    part = F.pmod(F.xxhash64("text"), F.lit(folds))
    best = []
    for i in range(folds):
        other = _trained(sample.where(part != i), landmarks, rounds, balance)
        table, bias = other or (np.zeros(_FEATURES), 0.0)
        run = partial(_largest, table=table, bias=bias)
        best += sample.where(part == i).mapInArrow(run, "toxic int, mass double, a double, b double").collect()
    best = np.array(sorted(map(tuple, best)))
    return *machine, _logistic(best[:, 2:], best[:, 0], best[:, 1] / best[:, 1].mean())


def _trained(sample: DataFrame, landmarks: int, rounds: int, balance: float) -> tuple[np.ndarray, float] | None:
    """Table and bias of the machine of a sample; None if no word speaks for toxic documents."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    found = sample.mapInArrow(_sample_words, "toxic int, word string")
    spoken = found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    odds = (F.col("toxic") + 0.5) / (n_toxic + 1) * (n_clean + 1) / (F.col("clean") + 0.5)
    spoken = materialize(spoken.withColumn("speaks", F.col("toxic") / n_toxic * F.log(odds)), "toxicity_words")
    telling = spoken.where("toxic > 0").orderBy(F.desc("speaks"), "word").limit(2 * landmarks // 3).collect()
    taken = {r["word"] for r in telling}
    usual = spoken.where("clean > 0").orderBy(F.desc("clean"), "word").limit(landmarks).collect()
    usual = [r for r in usual if r["word"] not in taken][:landmarks - len(telling)]
    if not telling:
        return None
    codes, word, count = _coded(pa.array([r["word"] for r in telling + usual]))
    marks = np.zeros((count, _FEATURES))
    for owner, key, weight in _subsequences(codes, word):
        np.add.at(marks, (owner, key), weight)
    marks /= _lengths(codes, word, count)[:, None]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    used = np.flatnonzero(marks.any(axis=0))
    place = np.zeros(_FEATURES, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    rows = np.vstack([np.zeros(good.sum()), marks[:, used].T @ whiten])
    speaks = np.array([r["speaks"] if r["word"] in taken else 0.0 for r in telling + usual])
    y = np.where(speaks > 0, 1.0, -1.0)
    weight = np.where(speaks > 0, speaks / max(speaks[speaks > 0].mean() if (speaks > 0).any() else 1.0, 1e-9), 1.0)
    w = np.append(*_svm(_features(codes, word, count, place, rows), y, weight))
    clean = spoken.where("clean > 0").select("word", F.lit(0).cast("long").alias("mass"), F.lit(1.0).alias("negative"))
    tasks = parallelism(sample.sparkSession)
    for _ in range(rounds):
        run = partial(_witnesses, table=rows[place] @ w[:-1], bias=w[-1])
        witnesses = sample.where("toxic = 1").select("text").mapInArrow(run, "word string").groupBy("word").agg(F.count("*").alias("mass"))
        words = clean.unionByName(witnesses.withColumn("negative", F.lit(0.0)))
        words = materialize(words.groupBy("word").agg(F.sum("mass").alias("mass"), F.max("negative").alias("negative")).repartition(tasks, "word"), "toxicity_rows")
        scale = words.agg(F.greatest(F.sum("negative") / balance, F.count(F.when(F.col("mass") > 0, 1))) / F.sum("mass")).first()[0]
        w = _machine(words.withColumn("positive", F.col("mass") * scale), w, place, rows)
    return rows[place] @ w[:-1], float(w[-1])


def _scored(batches: Iterator[pa.RecordBatch], table: np.ndarray, bias: float, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for _, _, data, offsets in text.slices(batch.column("text")):
            codes, word, heads, first = spelled(data, offsets)
            largest = _two_largest(margins(codes, word, len(heads), table) + bias, first)
            scores.append(1 / (1 + np.exp(-np.clip(largest @ weights[:2] + weights[2], -30, 30))))
        score = np.concatenate(scores) if scores else np.zeros(0)
        at = batch.schema.get_field_index("text")
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*names, "score"])


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray]) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null text counts as empty, no word scores low."""
    table, bias, weights = model
    run = partial(_scored, table=table, bias=bias, weights=weights)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of the rows that are not held out.

    Takes doc_id and text, and labels' doc_id and toxic; other columns are ignored. Returns
    a row per input row: doc_id, held_out, score, predicted. Rows without doc_id are
    scored, too, and never train. Without labels of both classes see ``fit``.
    """
    model = fit(training_sample(docs, labels, ~held_out()))
    scored = score_texts(docs, model).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below THRESHOLD, with all their columns."""
    table, bias, weights = fit(training_sample(docs, labels, ~held_out()))
    run = partial(_kept, table=table, bias=bias, weights=weights)
    return docs.mapInArrow(run, docs.schema)


def _kept(batches: Iterator[pa.RecordBatch], table: np.ndarray, bias: float, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["text"])
        score = next(_scored(iter([rows]), table, bias, weights)).column("score").to_numpy()
        yield batch.filter(pa.array(score < THRESHOLD))
