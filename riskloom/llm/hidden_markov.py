"""Hidden Markov language model of words.

Tokens are lowered words and one end per text. A state emits a class, a class emits a word:
words that make up at least 1 / HEADS of the training tokens are classes of their own, all
others fall into SPELLINGS classes by their first and last letters. Within a class a word
has (count + 1) / (class tokens + class types + 1), one share being left for unknown words.
Counts of all words come from all training texts and stay distributed; only the state
model, whose size HEADS and SPELLINGS bound, is held by the driver.

Baum-Welch: each pass runs the scaled forward and backward recursions over every training
text in its partition and adds up expected counts by class and by transition; the driver
turns the sums into the next model. A text's score is its exact forward likelihood.

Texts are coded once as places in the dictionary of their block of texts; counts are joined
to these dictionaries, and a block's texts meet its dictionary in one shuffle. Later passes
read class codes and need no shuffle of texts or words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import text
from riskloom.session import materialize

STATES = 8
HEADS = 4096
SPELLINGS = 2048
PASSES = 3
START_TEXTS = 512
BLOCK_BYTES = 8 << 20
CHUNK_TOKENS = 1 << 18
_BLOCKS = ("block long, kind int, code int, word long, spelling int, n_train long, doc_id long, held_out boolean, "
           "n_words long, words binary")


class Model(NamedTuple):
    """First-state, transition (from, to) and emission (class, state) probabilities."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low = data.astype(np.uint64)
    low[(data >= 65) & (data <= 90)] += np.uint64(32)
    parts = (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1)
    key = np.zeros(len(starts), np.uint64)
    for part in parts:
        key = key * np.uint64(257) + low[part]
    return (text.mix(key) % np.uint64(SPELLINGS)).astype(np.int32)


def packed(places: np.ndarray) -> bytes:
    """The low halves of all places, then the high ones, which are mostly zero and compress."""
    return np.concatenate([places & 0xFFFF, places >> 16]).astype(np.uint16).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(raw, np.uint16).reshape(2, -1).astype(np.int32)
    return low | high << 16


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: their dictionary (kind 0) and their words as places in it (kind 1)."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("code", pa.int32()), ("word", pa.int64()), ("spelling", pa.int32()),
                        ("n_train", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()),
                        ("words", pa.binary())])

    def rows(block: int, kind: int, n: int, **columns) -> pa.RecordBatch:
        given = {"block": pa.array(np.full(n, block, np.int64)), "kind": pa.array(np.full(n, kind, np.int32)), **columns}
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    block = 0
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([h for h, _, _, _, _ in held])
        words, at, place, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # places of frequent words are small
        words, at, place = words[order], at[order], np.argsort(order)[place]
        spelling = np.concatenate([s for _, s, _, _, _ in held])[at]
        counts = np.concatenate([c for _, _, c, _, _ in held])
        ids = pa.concat_arrays([d for _, _, _, d, _ in held])
        out = np.concatenate([o for _, _, _, _, o in held])
        trains = np.repeat(~out, counts)
        n_train = np.bincount(place[trains], minlength=len(words)).astype(np.int64)
        yield rows(block, 0, len(words), code=pa.array(np.arange(len(words), dtype=np.int32)), word=pa.array(words.view(np.int64)),
                   spelling=pa.array(spelling), n_train=pa.array(n_train))
        cuts = np.cumsum(counts)[:-1]
        raw = pa.array([packed(p) for p in np.split(place, cuts)], pa.binary())
        yield rows(block, 1, len(counts), doc_id=ids, held_out=pa.array(out), n_words=pa.array(counts), words=raw)

    first = True
    for batch in batches:
        if first:
            block, first = batch.column("part")[0].as_py() << 32, False
        ids, out = batch.column("doc_id"), np.array(batch.column("held_out").to_pylist(), bool)
        for low, high, data, offsets in text.slices(batch.column("text")):
            starts, ends, index = text.words(data, offsets)
            hashes = text.span_hash(text.prefix_hash(data, lowered=True), starts, ends)
            held.append((hashes, _spelling(data, starts, ends), np.diff(index), ids.slice(low, high - low), out[low:high]))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from flush()
                held, size, block = [], 0, block + 1
    if held:
        yield from flush()


def _classed(batches: Iterator[pa.RecordBatch], sizes: np.ndarray, end_class: int, end_log: float, unit: float) -> Iterator[pa.RecordBatch]:
    """From blocks sorted dictionary first: class codes and the sums that need no states.

    ``sizes`` has what the counts of each class's words are divided by; 0 for a word that is a class.
    """
    block, pieces, ready = None, [], False
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
            part = batch.slice(low, high - low)
            if blocks[low] != block:
                block, pieces, ready = blocks[low], [], False
            if kinds[low] == 0:
                pieces.append([part.column(c).to_numpy() for c in ("class", "c")])
                continue
            if not ready:
                columns = [np.concatenate(c) for c in zip(*pieces, strict=True)] if pieces else [np.zeros(0)] * 2
                classes, c = columns[0].astype(np.uint16), columns[1]
                size = sizes[classes]
                within = np.where(size > 0, np.log10((c + 1) / np.maximum(size, 1)), 0.0)
                base, known, ready = np.log10(c + 1) - unit, c > 0, True
            out = []
            for raw in part.column("words").to_pylist():
                words = unpacked(raw)
                out.append((len(words) + 1, int(known[words].sum()) + int(end_log > 0), float(base[words].sum()) + end_log - unit,
                            float(within[words].sum()), np.append(classes[words], np.uint16(end_class)).tobytes()))
            columns = zip(*out, strict=True)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), *[pa.array(list(v), t) for v, t in zip(columns, types, strict=True)]],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes"])


def _chunks(raws: list[bytes]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Sequences by falling length, in groups of about CHUNK_TOKENS tokens."""
    sequences = [np.frombuffer(r, np.uint16).astype(np.int64) for r in raws]
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    group, size = [], 0
    for i in order:
        group.append(i)
        size += len(sequences[i])
        if size >= CHUNK_TOKENS:
            yield group, [sequences[j] for j in group]
            group, size = [], 0
    if group:
        yield group, [sequences[j] for j in group]


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens ordered by place, then sequence, and where each place begins."""
    sizes = np.array([len(s) for s in sequences])
    place = np.concatenate([np.arange(n) for n in sizes])
    flat = np.concatenate(sequences)[np.argsort(place, kind="stable")]
    active = np.bincount(place)
    return flat, np.concatenate([[0], np.cumsum(active)])


def forward(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log likelihood of each sequence, longest first."""
    flat, cut = _by_time(sequences)
    total = np.zeros(len(sequences))
    now = None
    for t in range(len(cut) - 1):
        n = cut[t + 1] - cut[t]
        now = (model.first if now is None else now[:n] @ model.move) * model.emit[flat[cut[t]:cut[t + 1]]]
        scale = now.sum(1)
        now /= scale[:, None]
        total[:n] += np.log(scale)
    return total


def expected(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected first-state, transition and emission counts, and the log likelihood."""
    flat, cut = _by_time(sequences)
    emitted = model.emit[flat]
    states = np.empty_like(emitted)
    scales = np.empty(len(flat))
    for t in range(len(cut) - 1):
        a, b = cut[t], cut[t + 1]
        now = (np.broadcast_to(model.first, (b - a, len(model.first))) if t == 0 else states[cut[t - 1]:cut[t - 1] + b - a] @ model.move) * emitted[a:b]
        scales[a:b] = now.sum(1)
        states[a:b] = now / scales[a:b, None]
    moves = np.zeros_like(model.move)
    after = np.zeros((0, len(model.first)))  # emission times backward value, scaled, of the next place
    for t in range(len(cut) - 2, -1, -1):
        a, b = cut[t], cut[t + 1]
        n = len(after)
        moves += states[a:a + n].T @ after
        back = np.ones((b - a, len(model.first)))
        back[:n] = after @ model.move.T
        after = emitted[a:b] * back / scales[a:b, None]
        states[a:b] *= back
    counts = np.stack([np.bincount(flat, states[:, s], minlength=len(model.emit)) for s in range(states.shape[1])], 1)
    return states[:cut[1]].sum(0), moves * model.move, counts, float(np.log(scales).sum())


def _statistics(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Expected counts of a partition: a row per class, then transitions and first states."""
    classes, states = model.emit.shape
    total = np.zeros((classes + states + 1, states))
    for batch in batches:
        for _, sequences in _chunks(batch.column("classes").to_pylist()):
            first, moves, counts, _ = expected(sequences, model)
            total[:classes] += counts
            total[classes:classes + states] += moves
            total[-1] += first
    used = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, s]) for s in range(states)]],
                                     names=["item", *[f"s{s}" for s in range(states)]])


def maximised(total: np.ndarray, classes: int) -> Model:
    """The model of summed expected counts; a little is added to every count."""
    emit, moves, first = total[:classes] + 0.01, total[classes:-1] + 0.1, total[-1] + 0.1
    return Model(first / first.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def starting(sequences: list[np.ndarray], classes: int, states: int) -> Model:
    """Start values: groups of some texts by their class frequencies, states that tend to stay."""
    emit = np.full((classes, states), 1.0 / classes)
    share = np.full(states, 1.0 / states)
    if sequences:
        rows = np.stack([np.sqrt(np.bincount(s, minlength=classes) / len(s)) for s in sequences])
        centres = [rows[np.argmin(rows @ rows.mean(0))]]
        while len(centres) < states:
            centres.append(rows[np.argmin(np.max(rows @ np.array(centres).T, 1))])
        centres = np.array(centres)
        for _ in range(10):
            near = np.argmax(rows @ centres.T, 1)
            sums = np.stack([rows[near == s].sum(0) for s in range(states)])
            centres = np.where(sums.any(1)[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None], centres)
        overall = np.bincount(np.concatenate(sequences), minlength=classes) + 0.1
        for s in range(states):
            own = [sequences[i] for i in np.flatnonzero(near == s)]
            counts = np.bincount(np.concatenate(own), minlength=classes) if own else np.zeros(classes)
            mixed = counts / max(1, counts.sum()) + 0.1 * overall / overall.sum()
            emit[:, s] = mixed / mixed.sum()
        share = (np.bincount(near, minlength=states) + 1.0) / (len(sequences) + states)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    return Model(share, move / move.sum(1, keepdims=True), emit)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.array(batch.column("within").to_pylist(), float)
        for group, sequences in _chunks(batch.column("classes").to_pylist()):
            score[group] += forward(sequences, model) / math.log(10)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], names=[*names, "score"])


def train(coded: DataFrame, classes: int, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over all rows of ``coded`` (classes: class codes of a text as u16)."""
    sample = coded.select("classes").orderBy(F.xxhash64("classes"), "classes").limit(START_TEXTS).collect()
    model = starting([np.frombuffer(r["classes"], np.uint16).astype(np.int64) for r in sample], classes, states)
    fields = [f"s{s}" for s in range(states)]
    for _ in range(passes if sample else 0):
        found = coded.select("classes").mapInArrow(partial(_statistics, model=model), "item long, " + ", ".join(f"{f} double" for f in fields))
        total = np.zeros((classes + states + 1, states))
        for row in found.groupBy("item").agg(*[F.sum(f).alias(f) for f in fields]).collect():
            total[row["item"]] = [row[f] for f in fields]
        model = maximised(total, classes)
    return model


def score_texts(docs: DataFrame, held_out: str = "held_out", states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Scores of all rows by a model of the rows for which column ``held_out`` is false.

    Takes doc_id, text and the flag. Returns doc_id, held_out, n_tokens (words and one end),
    n_known (tokens that occur in training), train_tokens, base_score and score: log10
    probabilities by smoothed token counts and by the hidden Markov model.

    Null text counts as empty: one end token. A null flag means false. Repeated rows train
    and are scored each for itself. Without training texts the classes are equally likely
    in every state. An empty table gives an empty result.
    """
    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), "text")
    blocks = materialize(rows.mapInArrow(_coded, _BLOCKS), "blocks")
    texts, dictionary = blocks.where("kind = 1"), blocks.where("kind = 0")
    counts = dictionary.groupBy("word").agg(F.sum("n_train").alias("c"), F.min("spelling").alias("spelling"))
    counts = materialize(counts, "counts")
    n_texts = texts.where("not held_out").count()
    seen = counts.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (seen["n"] or 0) + n_texts, seen["v"] + (n_texts > 0)
    often = F.col("c") * HEADS >= F.lit(max(n, 1))
    heads = sorted((-r["c"], r["word"]) for r in counts.where(often & (F.col("c") > 0)).collect())
    head_rows = [(word, i) for i, (_, word) in enumerate(heads)]
    head = docs.sparkSession.createDataFrame(head_rows, "word long, head int")
    counts = counts.join(F.broadcast(head), "word", "left")
    tails = counts.where("head is null").groupBy("spelling").agg(F.sum("c").alias("n_class"), F.count(F.when(F.col("c") > 0, 1)).alias("v_class"))
    classes = len(heads) + SPELLINGS + 1
    sizes = np.zeros(classes)
    for r in tails.collect():  # a row per spelling class at most
        sizes[len(heads) + r["spelling"]] = r["n_class"] + r["v_class"] + 1
    counts = counts.select("word", "c", F.coalesce("head", F.col("spelling") + len(heads)).cast("int").alias("class"))
    entries = dictionary.select("block", "code", "word").join(counts, "word").select("block", F.lit(0).alias("kind"), "code", "class", "c")
    both = texts.select("block", "kind", "doc_id", "held_out", "words").unionByName(entries, allowMissingColumns=True)
    both = both.repartition("block").sortWithinPartitions("block", "kind", "code")
    run = partial(_classed, sizes=sizes, end_class=classes - 1, end_log=math.log10(n_texts + 1), unit=math.log10(n + v + 1))
    coded = both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary")
    coded = materialize(coded, "classes")
    model = train(coded.where("not held_out"), classes, states, passes)
    scored = coded.mapInArrow(partial(_scored, model=model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
