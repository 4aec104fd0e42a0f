"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed into the phrases of its LZ78 dictionary (each the longest known phrase and
one more character). Phrases are hashed as UTF-32 spans; a fingerprint is the least hash
of each of SLOTS classes of the phrase set, cut to 16 bits, so the share of equal slots of two fingerprints
estimates the overlap of their dictionaries, as a compressor would see it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import text as hashing
from riskloom.session import materialize

SLOTS = 128
_EMPTY = np.uint16(0xFFFF)
_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double, part int, edge string, text string")


class Parse:
    """An LZ78 parse that can be copied and continued."""

    def __init__(self, phrases: dict[str, None] | None = None, open_phrase: str = ""):
        self.phrases = {} if phrases is None else phrases
        self.open = open_phrase

    def feed(self, text: str) -> Parse:
        phrases, phrase = self.phrases, self.open
        for c in text:
            phrase += c
            if phrase not in phrases:
                phrases[phrase] = None
                phrase = ""
        self.open = phrase
        return self

    def copy(self) -> Parse:
        return Parse(self.phrases.copy(), self.open)

    def slots(self) -> np.ndarray:
        """Low bits of the least 32-bit hash of the phrases in each of SLOTS classes."""
        out = np.full(SLOTS, 1 << 32, np.int64)
        phrases = list(self.phrases)
        if self.open and not phrases:
            phrases = [self.open]
        if phrases:
            data = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint8)
            ends = 4 * np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
            hashes = hashing.span_hash(hashing.prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends)
            place = (hashes >> np.uint64(32)).astype(np.int64) % SLOTS
            np.minimum.at(out, place, (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64))
        return np.where(out < 1 << 32, np.minimum(out & 0xFFFF, 0xFFFE), 0xFFFF).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that either fingerprint uses; 1 for two empty ones."""
    used = (a != _EMPTY) | (b != _EMPTY)
    return float((a == b)[used].mean()) if used.any() else 1.0


def written(slots: np.ndarray) -> bytes:
    return slots.astype("<u2").tobytes()


def fingerprint(text: str) -> np.ndarray:
    """Slots of a whole text."""
    return Parse().feed(text).slots()


def _both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Slots of a text and of its edited text, and the edited text; the stem is parsed once."""
    half = len(text) // 2
    stem, tail = text[:len(text) - half], following[:half]
    parse = Parse().feed(stem)
    edited = parse.copy().feed(tail).slots()
    return parse.feed(text[len(stem):]).slots(), edited, stem + tail


def _row(doc_id: int | None, text: str, both: tuple[np.ndarray, np.ndarray, str], following: np.ndarray) -> tuple:
    slots, edited, edited_text = both
    return (doc_id, len(text), hashlib.sha256(edited_text.encode()).hexdigest(), written(slots), written(edited),
            likeness(slots, edited), likeness(slots, following), None, None, None)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
                        ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema=schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of a part in doc_id order; its first and last document come out as edges."""
    ready: tuple | None = None  # a document with its slots, which waits for those of the next
    last: tuple | None = None  # a document that waits for the next one's text
    for batch in batches:
        out = []
        for part, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "text")], strict=True):
            text = text or ""
            if last is None:
                out.append((*[None] * 7, part, "first", text))
            else:
                both = _both(last[1], text)
                if ready is not None:
                    out.append(_row(*ready, both[0]))
                ready = (last[0], last[1], both)
            last = (doc_id, text, part)
        if out:
            yield _table(out)
    if last is not None:
        out = [(last[0], *[None] * 6, last[2], "last", last[1])]
        if ready is not None:
            out.append(_row(*ready, fingerprint(last[1])))
        yield _table(out)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "following")], strict=True)
        yield _table([_row(d, text, _both(text, following), fingerprint(following)) for d, text, following in rows]).select(_COLUMNS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The edited text replaces the last floor(n_chars / 2) characters by as many first
    characters of the next document's text (or all of it, where that is shorter), in
    ascending doc_id order; the last document is followed by the first. Takes doc_id and
    text; other columns are ignored. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Null text counts as empty; two empty fingerprints have likeness 1. Rows without doc_id
    come last; equal doc_ids are ordered by text. A single document follows itself. An
    empty table gives an empty result.

    Texts are shuffled once, by ranges of doc_id; each task streams its range. The last
    document of a range and the first of the next meet in a small second step, with two
    rows for each task of the first.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    found = materialize(rows.mapInArrow(_parts, _SCHEMA), "fingerprints")
    edges = found.where("edge is not null")
    parts = sorted(r["part"] for r in edges.where("edge = 'first'").select("part").collect())
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = edges.where("edge = 'last'").select("part", "doc_id", "text")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    pairs = last.join(F.broadcast(following), "part").join(first, "next").select("doc_id", "text", "following")
    ends = pairs.mapInArrow(_edges, ", ".join(_SCHEMA.split(", ")[:7]))
    everything = found.where("edge is null").select(*_COLUMNS).unionByName(ends)
    return everything.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})
